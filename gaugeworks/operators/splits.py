"""Splits that keep identities apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.running import numbered, order_number, sums_before
from ..functions.scalars import split_sizes
from ..sources.shared import kept


def subject_disjoint(rows: DataFrame, subject: str, fraction: float, salt: str) -> DataFrame:
    """(subject, n, split): whole subjects in order of a hash go to `test` until that has fraction of the rows, at least one; the others, and rows without a subject, to `train`."""
    counts = kept(rows.groupBy(subject).agg(F.count(F.lit(1)).alias("n")), "subjects")
    total = counts.agg(F.sum("n").alias("all"))
    laid = sums_before(counts.filter(F.col(subject).isNotNull()).withColumn("_order", order_number(F.concat_ws("|", F.lit(salt), F.col(subject).cast("string")))), "_order", {"n": "_before"})
    target = F.greatest(F.lit(1).cast("long"), F.floor(F.col("all") * fraction))
    placed = laid.crossJoin(F.broadcast(total)).select(subject, "n", F.when(F.col("_before") < target, "test").otherwise("train").alias("split"))  # one row
    return placed.unionByName(counts.filter(F.col(subject).isNull()).select(subject, "n", F.lit("train").alias("split")))


def subject_disjoint_permuted(rows: DataFrame, subject: str, position: str, fraction: float, seed: int) -> DataFrame:
    """As subject_disjoint(), but in the order of numpy's permutation of the subjects as they first appear. The subjects stay in tables: they are numbered in order of appearance, and the permutation, numbers of the size of the subjects' count, is made in one task and joined by number."""
    counts = kept(rows.filter(F.col(subject).isNotNull()).groupBy(subject).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_first")), "subjects")
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    # subjects that appear together are numbered among themselves
    among = F.row_number().over(Window.partitionBy("_first").orderBy(subject)) - 1
    first = counts.groupBy("_first").agg(F.count(F.lit(1)).alias("_k"))
    starts = sums_before(first, "_first", {"_k": "_start"}).select("_first", "_start")
    placed = counts.withColumn("_among", among).join(starts, "_first").select(subject, "n", (F.col("_start") + F.col("_among")).cast("long").alias("_i"))
    size = counts.count()

    def permuted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            order = np.random.default_rng(seed).permutation(size)
            for k in range(0, size, 1 << 20):
                yield pd.DataFrame({"_turn": np.arange(k, min(size, k + (1 << 20))), "_i": order[k : k + (1 << 20)]})

    turns = rows.sparkSession.range(1, numPartitions=1).mapInPandas(permuted, "_turn long, _i long")
    laid = sums_before(kept(placed.join(turns, "_i"), "subjects"), "_turn", {"n": "_before"})
    target = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_all") * fraction))
    return laid.crossJoin(F.broadcast(total)).select(subject, "n", F.when(F.col("_before") < target, "test").otherwise("train").alias("split"))  # one row


def identity_splits(ids: DataFrame, identity: str, train: float, dev: float, salt: str) -> DataFrame:
    """(identity, split): identities in order of the first 60 bits of a hash, cut at sizes rounded half to even; the rest is test."""
    listed = kept(ids.select(identity).filter(F.col(identity).isNotNull()).distinct().withColumn("_order", order_number(F.concat_ws("|", F.lit(salt), F.col(identity).cast("string")))), "identities")
    sizes = listed.agg(F.count(F.lit(1)).alias("_n")).select(split_sizes(F.col("_n"), train, dev).alias("_s"))
    split = F.when(F.col("_p") < F.col("_s.n_train"), "train").when(F.col("_p") < F.col("_s.n_train") + F.col("_s.n_dev"), "dev").otherwise("test")
    return numbered(listed, "_order", "_p").crossJoin(F.broadcast(sizes)).select(identity, split.alias("split"))  # one row


def with_split(rows: DataFrame, splits: DataFrame, identity: str) -> DataFrame:
    """rows with their identity's split; a row whose identity has none fails the job."""
    joined = rows.join(splits.select(identity, F.col("split").alias("_split")), identity, "left")
    missing = F.raise_error(F.concat(F.lit("no split for identity "), F.coalesce(F.col(identity).cast("string"), F.lit("null")))).cast("string")
    return joined.select(*rows.columns, F.when(F.col("_split").isNull(), missing).otherwise(F.col("_split")).alias("split"))


def guarded(rows: DataFrame, label: str, split: str, part: str = "test") -> DataFrame:
    """rows, or an error when they run if that part has fewer than two classes."""
    classes = rows.filter(F.col(split) == part).agg((F.count_distinct(label) < 2).alias("_few"))
    checked = classes.select(F.when(F.col("_few"), F.raise_error(F.lit(f"the {part} part has one class"))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return rows.crossJoin(F.broadcast(checked)).filter("_ok is null or _ok").drop("_ok")  # one row
