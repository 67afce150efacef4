"""Running sums over an order that one task needn't hold."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a group that one task sums up.
LARGE = 1_000_000
#: Stretches of the order, where a group has more; as many more as keep a stretch of the largest group at LARGE rows.
STRETCHES = 64


def largest_group(df: DataFrame, by: Sequence[str], large: int | None = None) -> int:
    """Rows of the largest group, or a bound of it: all rows, if those are at most `large`."""
    n = df.count()
    if n <= (LARGE if large is None else large) or not by:
        return n
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def window(by: Sequence[str], *more: str):
    keys = [*by, *more]
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _cuts_below(value: Column, cuts: Sequence) -> Column:
    """How many of the cuts, in rising order, are below value: first among every k-th one, then among the k that follow, with k about the root of their number."""
    below = lambda cs: F.size(F.filter(cs, lambda c: c < value))
    k = max(1, math.isqrt(len(cuts)))
    listed = F.array(*map(F.lit, cuts))
    whole = below(F.array(*map(F.lit, cuts[k - 1 :: k]))) * k if k > 1 else F.lit(0)
    return whole + below(F.slice(listed, whole + 1, F.lit(k))) if k > 1 else below(listed)


def sums_before(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), large: int | None = None, stretches: int | None = None, largest: int | None = None) -> DataFrame:
    """df with, for each column of `sums`, the sum over all rows of the group that come before, under the name it maps to. `order`, a number or a text, must be unique in a group. df is read several times; `largest` is largest_group() of it, if known.

    Groups of up to `large` rows are summed by a window each. If one has more, the order is cut at quantiles into stretches, which are summed on their own: a window runs within a stretch of a group, another over the few totals of its stretches. So a group as large as the table is still dealt to many tasks, however its values lie; the sums are the same."""
    by, large = list(by), LARGE if large is None else large  # LARGE as it is now
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    largest = largest_group(df, by, large) if largest is None else largest
    if largest <= large:
        w = before(window(by).orderBy(order))
        return df.withColumns({name: F.coalesce(F.sum(c).over(w), F.lit(0)) for c, name in sums.items()})
    value = F.col(order)
    if df.schema[order].dataType.typeName() == "string":  # seven bytes as a number, which doesn't fall where the text rises
        value = F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    stretches = stretches or max(STRETCHES, math.ceil(largest / max(1, large)))
    cuts = sorted({*df.agg(F.percentile_approx(value, [i / stretches for i in range(1, stretches)], 100 * stretches)).first()[0]})
    placed = df.withColumn("_part", _cuts_below(value, cuts))
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    across, within = before(window(by).orderBy("_part")), before(window(by, "_part").orderBy(order))
    bases = totals.select(*[F.col(c).alias(f"_g_{c}") for c in [*by, "_part"]], *[F.coalesce(F.sum(f"_t_{c}").over(across), F.lit(0)).alias(f"_b_{c}") for c in sums])
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*by, "_part"]]  # null is a group, too
    out = placed.join(bases, same)
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_b_{c}")).alias(name) for c, name in sums.items()])


def numbered(df: DataFrame, order: str, name: str, large: int | None = None) -> DataFrame:
    """df with the number of each row in an order, a unique number or text, from 0 on. df is read several times."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return sums_before(one, order, {"_one": name}, large=large).drop("_one").withColumn(name, F.col(name).cast("long"))


def order_number(text: Column) -> Column:
    """The first 60 bits of sha256 of a text: a number that orders texts by chance."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
