"""Sharding: rendezvous hashing of stable record keys over weighted shards. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table

#: Rows that one group of slots should hold.
SLOT_ROWS = 50_000


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard) of the shard with the highest score -weight / ln(u), u a uniform number in (0, 1) hashed from key and shard.

    Each shard's score depends on the key as text, its own number and its own weight only. So a further shard takes just the records in which it wins, each shard gets its weight's part of the keys, and a key's type makes no difference. A null key is a key like others."""
    scores, key = [], key.cast("string")
    for s, w in enumerate(weights, first):
        if w <= 0:
            raise ValueError("a weight must be above 0")
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(s), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(s).alias("shard")))
    return F.array_max(F.array(*scores))


def shard(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """docs with two more columns: the shard of each row's key, and its shard with one more shard of grown_weight. No shuffle."""
    best, more = fresh(docs, "_best", "_more")
    n = len(weights)
    return (
        docs.withColumn(best, rendezvous(F.col(key), weights))
        .withColumn(more, rendezvous(F.col(key), [grown_weight], n))
        .withColumn(shard_col, F.col(best)["shard"])
        .withColumn(grown_col, F.when(F.col(more)["score"] > F.col(best)["score"], F.lit(n)).otherwise(F.col(best)["shard"]))
        .drop(best, more)
    )


def slots(sharded: DataFrame, rows: int, key: str = "doc_id", order: Sequence[str] = (), shard_col: str = "shard", n_shards: int = 16) -> DataFrame:
    """sharded with slot: 0, 1, ... within each shard, without gaps.

    A shard's rows are dealt into cells by a hash of the key, so that no task numbers a whole shard; a cell's first slot is the sum of the counts of the cells before it. Counting reads the key and the columns of `order` only. Rows are dealt and ordered by key and `order`: those that repeat one key share a cell only if they are equal in these, and then they are interchangeable."""
    cells = max(16, math.ceil(rows / n_shards / SLOT_ROWS))
    cell, count, base, rank = fresh(sharded, "_cell", "_count", "_base", "_rank")
    dealt = sharded.withColumn(cell, F.pmod(F.xxhash64(F.lit(-1), F.col(key).cast("string"), *order), F.lit(cells)))
    sums = (
        dealt.groupBy(shard_col, cell)
        .agg(F.count(F.lit(1)).alias(count))
        .withColumn(base, F.sum(count).over(Window.partitionBy(shard_col).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)))
        .select(shard_col, cell, F.coalesce(F.col(base), F.lit(0)).alias(base))
    )
    numbered = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(shard_col, cell).orderBy(key, *order)))
    return numbered.join(sums, [shard_col, cell]).withColumn("slot", (F.col(base) + F.col(rank) - 1).cast("long")).drop(cell, base, rank)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law `key`: doc_id and the number of shards decide.

    Null text: size 1, checksum 0. A repeated doc_id goes to one shard, each row with a slot of its own. No rows: no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = slots(shard(narrow), docs.count(), order=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
