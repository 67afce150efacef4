"""Joins, filters and limits over manifests: what a generation or evaluation run asks of its tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.running import numbered, order_number
from ..functions.scalars import derive_seed, sample_id
from ..sources.shared import kept


def unseen(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key isn't in existing; of rows that repeat a key in new, one."""
    return new.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def last_wins(left: DataFrame, manifest: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the last manifest row for its key; nulls without one."""
    last = manifest.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_m"))
    return left.join(last, key, "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in columns])


def restricted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list of ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def first_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """At most n rows of each group, the first in order: a cap that is the feature."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def best_per(rows: DataFrame, by: Sequence[str], score: str, order: str) -> DataFrame:
    """The row with the highest score of each group, of ties the first in order, a number; groups without a score give none."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(F.col(score), -F.col(order)))
    return rows.filter(F.col(score).isNotNull()).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def shuffled_take(rows: DataFrame, by: Sequence[str], key: str, seed: int, n: int) -> DataFrame:
    """n rows of each group in the order of a hash of seed and key, with their rank: a sampling operator whose draw depends on nothing else."""
    drawn = rows.withColumn("_o", order_number(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))))
    return first_per(drawn, by, ["_o", key], n).drop("_o")


def placed(identities: DataFrame, identity: str, order: str) -> DataFrame:
    """(identity, place): the identities' numbers in order of `order`, from 0 on. Repeated pairs count once."""
    return numbered(kept(identities.select(F.col(identity).alias("identity"), F.col(order).alias("_o")).distinct(), "identities"), "_o", "place").drop("_o")


def work_items(identities: DataFrame, identity: str, order: str, per_identity: int, modality: str, attacks: Sequence[tuple[str, float]], master_seed: int) -> DataFrame:
    """(sample_id, identity, sub, counter, dispatch_seed, attack, seed): each identity per_identity times, numbered in order of identity and sub.

    `order`, a number or a text, is unique for an identity, and its place is one number however often it is repeated. The attack is drawn by the dispatch seed's place in the running weights of the sorted names."""
    items = placed(identities, identity, order).select("identity", (F.col("place") * per_identity).alias("_base"), F.explode(F.sequence(F.lit(0), F.lit(per_identity - 1))).alias("sub"))
    items = items.withColumn("counter", F.col("_base") + F.col("sub")).withColumn("dispatch_seed", derive_seed(F.lit(master_seed), F.lit(modality), F.lit("_dispatch"), F.col("counter")))
    names = sorted(attacks)
    total, upto, attack = sum(w for _, w in names), 0.0, None
    for name, w in names[:-1]:
        upto += w / total
        limit = F.col("dispatch_seed") < F.lit(int(upto * 2**32))
        attack = F.when(limit, F.lit(name)) if attack is None else attack.when(limit, F.lit(name))
    attack = F.lit(names[-1][0]) if attack is None else attack.otherwise(F.lit(names[-1][0]))
    items = items.withColumn("attack", attack)
    return items.select(sample_id(F.lit(modality), F.col("attack"), F.col("counter")).alias("sample_id"), "identity", "sub", "counter", "dispatch_seed", "attack", derive_seed(F.lit(master_seed), F.lit(modality), F.col("attack"), F.col("counter")).alias("seed"))


def key_pairs(keys: DataFrame) -> DataFrame:
    """(session, code, pos, down_t, up_t) from (session, code, pos, phase, t): an up, at pos, pairs with the event right before it of the same code if that is a down, so that a repeated down replaces the one before and an up alone is dropped."""
    w = Window.partitionBy("session", "code").orderBy("pos")
    seen = keys.withColumns({"_phase": F.lag("phase").over(w), "_t": F.lag("t").over(w)})
    return seen.filter((F.col("phase") == "up") & (F.col("_phase") == "down")).select("session", "code", "pos", F.col("_t").alias("down_t"), F.col("t").alias("up_t"))
