"""Sweep cells: aggregates over seeds, comparisons and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.running import sums_before
from ..sources.shared import kept
from . import metrics

CELL = ["capacity", "data_level"]


def aggregated(cells: DataFrame, metric: str = "eer", order: str = "file") -> DataFrame:
    """Mean and population deviation over the seeds of each cell; the sizes are those of the first file by name. A cell without the metric is an error."""
    value = F.when(F.col(metric).isNull(), F.raise_error(F.lit("a cell has no metric")).cast("double")).otherwise(F.col(metric))
    return cells.withColumn("_v", value).groupBy(*CELL).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.count(F.lit(1)).alias("n_seeds"), F.min_by("n_train", order).alias("n_train"), F.min_by("n_val", order).alias("n_val"))


def compared(baseline: DataFrame, other: DataFrame, band: float = 0.03, collapse: float = 0.001) -> DataFrame:
    """A row per cell of either side: delta, verdict (collapsed, delta_exceeds_band, ok, or which side is missing) and whether the sizes differ."""
    a = baseline.select(*CELL, F.col("mean").alias("baseline_mean"), F.struct("n_train", "n_val").alias("_a"))
    b = other.select(*CELL, F.col("mean").alias("other_mean"), F.struct("n_train", "n_val").alias("_b"))
    both = a.join(b, CELL, "full_outer")
    delta = F.col("other_mean") - F.col("baseline_mean")
    verdict = (
        F.when(F.col("_b").isNull(), "baseline_only").when(F.col("_a").isNull(), "other_only").when(F.col("other_mean") <= collapse, "collapsed").when(F.abs(delta) > band, "delta_exceeds_band").otherwise("ok")
    )
    return both.select(*CELL, "baseline_mean", "other_mean", delta.alias("delta"), verdict.alias("verdict"), F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("scale_mismatch"))


def passed(comparison: DataFrame) -> DataFrame:
    """One row: passes if all shared cells are ok and there is one."""
    shared = ~F.col("verdict").isin("baseline_only", "other_only")
    n, ok = F.count_if(shared), F.count_if(F.col("verdict") == "ok")
    return comparison.agg(n.alias("n_shared"), ok.alias("n_ok"), ((n > 0) & (n == ok)).alias("passed"))


def fires(mean_a: Column, std_a: Column, mean_b: Column, std_b: Column, step: float = 0.05) -> Column:
    """Whether an axis matters: the means differ by step at least and the bands of one deviation don't meet."""
    gap = F.abs(mean_a - mean_b)
    return (gap >= step) & (gap > std_a + std_b)


def diagnosis(capacity_fires: Column, data_fires: Column) -> Column:
    return F.when(capacity_fires & data_fires, "both").when(capacity_fires, "capacity-limited").when(data_fires, "data-limited").otherwise("physics-limited")


def decision_band(eer: Column) -> Column:
    return F.when(eer < 0.30, "proceed").when(eer <= 0.45, "iterate").otherwise("rethink")


def curve_verdict(curve: DataFrame) -> DataFrame:
    """Whether fine-tuning helps: the eer without real rows against that with most. curve: (n_real, eer, skipped); without a row for 0, or with nothing beyond, no verdict."""
    done = curve.filter(~F.col("skipped"))
    ends = done.agg(F.max(F.when(F.col("n_real") == 0, F.col("eer"))).alias("base"), F.max("n_real").alias("top_n"), F.max_by("eer", "n_real").alias("top"))
    delta = F.col("top") - F.col("base")
    verdict = F.when(F.col("base").isNull() | (F.col("top_n") <= 0) | F.col("top").isNull(), F.lit(None)).when(delta < 0, "helps").when(delta == 0, "no change").otherwise("hurts")
    return ends.select("base", "top_n", "top", delta.alias("delta"), verdict.alias("verdict"))


def oversized_skipped(curve: DataFrame, pool: Column) -> DataFrame:
    """A size beyond the pool is skipped, never cut down to it."""
    return curve.withColumn("skipped", F.col("n_real") > pool)


#: Hex digits by which nested_curve() counts its rows.
DIGITS = 4


def nested_curve(pool: DataFrame, key: str, sizes: Sequence[int], seed: int, threshold: float = 0.5) -> DataFrame:
    """(n_real, skipped, eer, threshold, apcer, bpcer, acer) of nested subsets of the pool (key, label, score, attack_type): the first n rows in an order drawn by seed and key. A size beyond the pool is a skipped row without figures, never cut down. Rows of one key follow each other by label, score and class, so that a size that cuts them has one result; SQL that orders by the key alone leaves it open.

    Nothing but a few rows is put in order. Rows are counted by the first digits of their digests, which tells for each size the bucket where it ends. All rows of other buckets lie inside or outside as a whole, and are only counted; those of the buckets where a size ends are numbered. The pool is read twice, and neither stored nor shuffled."""
    spark, sizes, classes = pool.sparkSession, sorted({int(n) for n in sizes}), ["label", "score", "attack_type"]
    digest = F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string")), 256)
    buckets = kept(pool.groupBy(F.substring(digest, 1, DIGITS).alias("_b")).agg(F.count(F.lit(1)).alias("n")), "buckets")  # at most 16 ** DIGITS rows
    upto = buckets.withColumn("upto", F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    usable = [n for n in sizes if n <= total]
    ends = [upto.filter(F.col("upto") >= n).orderBy("_b").select("_b", (F.col("upto") - F.col("n")).alias("before")).first() if n > 0 else ("", 0) for n in usable]
    marked = pool.select(digest.alias("_d"), *classes).withColumn("_b", F.substring("_d", 1, DIGITS))
    rest = F.to_json(F.array(*[F.col(c).cast("string") for c in classes]), {"ignoreNullFields": "false"})
    # how many sizes end before a row's bucket; the row's place in the order, where one ends in it
    before_it = sum(((F.lit(b) < F.col("_b")).cast("int") for b, _ in ends), F.lit(0))
    there = F.col("_b").isin([b for b, _ in ends])
    counts = kept(marked.groupBy(before_it.alias("_s"), F.when(there, F.col("_b")).alias("_b"), F.when(there, F.concat_ws("|", "_d", rest)).alias("_o"), *classes).agg(F.count(F.lit(1)).alias("n")), "counts")
    number = F.array(*[F.lit(n) for n in usable]).cast("array<long>")
    whole = counts.filter("_o is null").select(F.explode(F.slice(number, F.col("_s") + 1, F.lit(len(usable)))).alias("n_real"), *classes, F.col("n").alias("weight"))
    bases = spark.createDataFrame(sorted({(b, before) for b, before in ends}), "_b string, before long")
    placed = sums_before(kept(counts.filter("_o is not null").join(F.broadcast(bases), "_b"), "cut"), "_o", {"n": "_p"}, ["_b"])  # a row per size at most
    inside = F.least(F.col("n"), F.col("n_real") - F.col("before") - F.col("_p"))
    split = placed.withColumn("n_real", F.explode(number)).withColumn("weight", inside).filter("weight > 0").select("n_real", *classes, "weight")
    nested = kept(whole.unionByName(split).groupBy("n_real", *classes).agg(F.sum("weight").alias("weight")), "nested")
    low = F.sum(F.when(F.col("score") < threshold, F.col("weight")).otherwise(0))
    by_class = nested.groupBy("n_real", "label", "attack_type").agg(low.alias("low"), F.sum("weight").alias("n"))
    apcer = F.coalesce(F.max(F.when((F.col("label") == 1) & F.col("attack_type").isNotNull(), F.col("low") / F.col("n"))), F.lit(0.0))
    bona = F.col("label") == 0
    bpcer = F.coalesce(F.try_divide(F.sum(F.when(bona, F.col("n") - F.col("low"))), F.sum(F.when(bona, F.col("n")))), F.lit(0.0))
    rates = by_class.groupBy("n_real").agg(apcer.alias("apcer"), bpcer.alias("bpcer")).withColumn("acer", (F.col("apcer") + F.col("bpcer")) / 2)
    done = metrics.eer(nested, ["n_real"], "weight").join(rates, "n_real")
    every = spark.createDataFrame([(n, n > total) for n in sizes], "n_real long, skipped boolean")
    return every.join(done, "n_real", "left")


def finished(spark, root: str, schema: str) -> DataFrame:
    """Cells below root; none if there are none yet."""
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_grid(rows: DataFrame, grid: DataFrame, root: str, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The grid's cells (by, eer, threshold, apcer, bpcer, acer, n) below root. Only cells that aren't there are worked out, all in one grouped plan, and written a partition each, replacing what a lost run may have left of them; so a run that was stopped goes on, and each cell is there once. A cell without rows stays open."""
    spark, by = rows.sparkSession, list(by)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    schema = f"eer double, threshold double, apcer double, bpcer double, acer double, n long, {kinds}"
    todo = grid.select(*by).distinct().join(finished(spark, root, schema).select(*by), by, "left_anti")
    open_ = kept(rows.join(todo, by, "left_semi"), "grid")
    cells = metrics.eer(open_, by).join(metrics.error_rates(open_, threshold, by), by).join(open_.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    cells.select("eer", "threshold", "apcer", "bpcer", "acer", "n", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)
    return finished(spark, root, schema)
