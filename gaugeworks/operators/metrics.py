"""Error rates of scored sets: (score, label 0 bona fide or 1 attack, attack_type). A row is taken for an attack when score >= threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import LARGE, largest_group, sums_before, window
from ..functions.scalars import ratio
from ..sources.shared import kept


def _count(condition) -> F.Column:
    return F.sum(condition.cast("long"))


def rates(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by, score, fpr, fnr for each different score as the threshold. Rows are counted by score (with their weights, if a column is named) before anything is sorted; only that table is read again."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    number = lambda label: F.sum(F.when(F.col("label") == label, w).otherwise(F.lit(0).cast("long")))
    counts = kept(scored.groupBy(*by, "score").agg(number(0).alias("n0"), number(1).alias("n1")), "counts")
    largest = largest_group(counts, by)
    before = sums_before(counts, "score", {"n0": "below0", "n1": "below1"}, by, largest=largest)
    totals = {"all0": F.sum("n0"), "all1": F.sum("n1")}
    if largest <= LARGE:
        both = before.withColumns({n: c.over(window(by)) for n, c in totals.items()})  # in the tasks that summed up
    else:
        grouped = counts.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
        both = before.join(grouped, by) if by else before.crossJoin(grouped)
    one = F.lit(1).cast("long")
    fpr = (F.col("all0") - F.col("below0")).cast("double") / F.greatest("all0", one)
    return both.select(*by, "score", fpr.alias("fpr"), (F.col("below1").cast("double") / F.greatest("all1", one)).alias("fnr"))


def eer(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by, eer, threshold: at the lowest score with the least |fpr - fnr|, (fpr + fnr) / 2; no interpolation. A difference of 1 never counts: then, and without rows, 0.5 and no threshold."""
    by = list(by)
    diff = F.abs(F.col("fpr") - F.col("fnr"))
    best = F.min_by(F.struct(((F.col("fpr") + F.col("fnr")) / 2).alias("eer"), F.col("score").alias("threshold")), F.struct(diff.alias("d"), F.col("score").alias("s")))
    found = rates(scored, by, weight).groupBy(*by).agg(F.min(diff).alias("_least"), best.alias("_best"))
    hit = F.col("_least") < 1
    return found.select(*by, F.coalesce(F.when(hit, F.col("_best.eer")), F.lit(0.5)).alias("eer"), F.when(hit, F.col("_best.threshold")).alias("threshold"))


def apcer_by_species(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Part of each species' attacks that pass as bona fide. Attacks without a species count for none."""
    attacks = scored.filter((F.col("label") == 1) & F.col("attack_type").isNotNull())
    return attacks.groupBy(*by, "attack_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") < threshold).cast("double")).alias("apcer"))


def error_rates(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """by, apcer (of the worst species), bpcer and acer, their mean; 0 where there are no rows."""
    by = list(by)
    species = scored.groupBy(*by, F.when(F.col("label") == 1, F.col("attack_type")).alias("species"), (F.col("label") == 0).alias("bona")).agg(F.count(F.lit(1)).alias("n"), _count(F.col("score") < threshold).alias("low"))
    apcer = F.max(F.when(F.col("species").isNotNull(), F.col("low").cast("double") / F.col("n")))
    high, n = F.sum(F.when(F.col("bona"), F.col("n") - F.col("low"))), F.sum(F.when(F.col("bona"), F.col("n")))
    out = species.groupBy(*by).agg(F.coalesce(apcer, F.lit(0.0)).alias("apcer"), ratio(high, n).alias("bpcer"))
    return out.withColumn("acer", (F.col("apcer") + F.col("bpcer")) / 2)


def threshold_at_apcer(scored: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, apcer: of least score - 1, all scores and greatest score + 1, the highest whose worst species stays within the target.

    A species' rate doesn't fall as the threshold rises. It stays within the target up to the first score at which the attacks so far, that score's included, are too many a part; the least of these scores is the threshold, and without any the greatest score + 1. So running counts by species suffice, and no candidate is compared with other rows. Rows are counted by score first. A negative target is an error; without rows there is no row, and no threshold."""
    if target < 0:
        raise ValueError("the target must not be negative")
    by = list(by)
    counts = kept(scored.groupBy(*by, F.when(F.col("label") == 1, F.col("attack_type")).alias("species"), "score").agg(F.count(F.lit(1)).alias("n")), "counts")
    largest, typed = largest_group(counts, by), F.col("species").isNotNull()
    if largest <= LARGE:  # a group's counts fit a task: windows alone
        each, whole = window([*by, "species"]), window(by)
        upto = sums_before(counts, "score", {"n": "below"}, [*by, "species"], largest=largest).withColumn("all", F.sum("n").over(each))
        over = typed & ((F.col("below") + F.col("n")).cast("double") / F.col("all") > target)
        fixed = upto.withColumn("threshold", F.coalesce(F.min(F.when(over, F.col("score"))).over(whole), F.max("score").over(whole) + 1))
        low = F.sum(F.when(F.col("score") < F.col("threshold"), F.col("n")).otherwise(F.lit(0))).cast("double") / F.sum("n")
        rated = fixed.groupBy(*by, "species").agg(F.first("threshold").alias("threshold"), low.alias("rate"))
        # without any typed attack the rate is 0 everywhere
        out = rated.groupBy(*by).agg(F.first("threshold").alias("threshold"), F.coalesce(F.max(F.when(typed, F.col("rate"))), F.lit(0.0)).alias("apcer"))
        return out.filter(F.col("threshold").isNotNull())
    attacks = counts.filter(typed)
    totals = attacks.groupBy(*by, "species").agg(F.sum("n").alias("all"))
    upto = sums_before(attacks, "score", {"n": "below"}, [*by, "species"]).join(totals, [*by, "species"])
    over = (F.col("below") + F.col("n")).cast("double") / F.col("all") > target
    limits = upto.filter(over).groupBy(*by).agg(F.min("score").alias("limit"))
    ends = counts.groupBy(*by).agg((F.max("score") + 1).alias("end"))
    fixed = (ends.join(limits, by, "left") if by else ends.crossJoin(limits)).select(*by, F.coalesce("limit", "end").alias("threshold")).filter(F.col("threshold").isNotNull())
    rated = attacks.join(fixed, by) if by else attacks.crossJoin(fixed)
    low = F.sum(F.when(F.col("score") < F.col("threshold"), F.col("n")).otherwise(F.lit(0))).cast("double") / F.sum("n")
    worst = rated.groupBy(*by, "species").agg(low.alias("apcer")).groupBy(*by).agg(F.max("apcer").alias("apcer"))
    out = fixed.join(worst, by, "left") if by else fixed.crossJoin(worst)
    return out.select(*by, "threshold", F.coalesce("apcer", F.lit(0.0)).alias("apcer"))


def rates_at(scored: DataFrame, thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    """error_rates() with each group's own threshold: thresholds has by and threshold. Groups without one get nulls."""
    by = list(by)
    joined = scored.join(thresholds.select(*by, "threshold"), by, "left")
    joined = joined.withColumn("score", F.col("score") - F.col("threshold"))
    rated = error_rates(joined.filter(F.col("threshold").isNotNull()), 0.0, by)
    return scored.select(*by).distinct().join(rated, by, "left")


def accuracy(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    right = ((F.col("score") >= threshold) == (F.col("label") == 1)).cast("double")
    return scored.groupBy(*by).agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def each_species_with_bona_fide(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, label, species, weight): for each species its attacks and all bona fide rows, counted by score, as the input of eer(..., by=[*by, "species"], weight="weight"). With seeds in `by`, eer_over_seeds() of that has the species' mean and deviation."""
    by = list(by)
    rows = scored.filter((F.col("label") == 0) | ((F.col("label") == 1) & F.col("attack_type").isNotNull()))
    counts = kept(rows.groupBy(*by, "score", "label", F.when(F.col("label") == 1, F.col("attack_type")).alias("species")).agg(F.count(F.lit(1)).alias("weight")), "counts")
    own = counts.filter("label = 1")
    species = own.select(*by, "species").distinct()
    bona = counts.filter("label = 0").drop("species")
    paired = bona.join(species, by) if by else bona.crossJoin(species)  # a row per species and score
    return paired.select(own.columns).unionByName(own)


def eer_over_seeds(eers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the eers of several seeds."""
    return eers.groupBy(*by).agg(F.avg("eer").alias("eer_mean"), F.stddev_pop("eer").alias("eer_std"), F.count(F.lit(1)).alias("n_seeds"))
