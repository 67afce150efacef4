"""Line dedup by levelled sorted runs of line hashes. DataFrame functions only.

Documents come in batches of rising doc_id. The hashes of the lines seen so far lie in runs: tables in the shared folder, dealt to buckets and sorted by hash. A batch's lines are merge-anti-joined with the runs, bucket by bucket, without a shuffle of the runs; those that are new become a run of level 0. When a level has FANOUT runs, their buckets are merged into one run of the next level.

What a batch drops follows from the runs as they stood, and from the batch itself: lines whose key a run has, and those whose key a smaller doc_id of the batch has."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, removed, sha256_hex, shared_dir, table

#: Bytes of text in a batch, and the least number of batches.
BATCH_BYTES, LEAST_BATCHES = 1 << 40, 4
FANOUT = 2
#: Bytes of a bucket of the run that holds all keys, and of a key in it.
BUCKET_BYTES, KEY_BYTES = 256 << 20, 16
MIN_CHARS = 10
BLANK = " \t\n\x0b\x0c\r"
#: Parts of the documents, by number, that batches are made of.
QUANTILES = 1024


#: Lets a scan of buckets that are one sorted file each say so, which saves the sort before a join.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


def bucket_count(spark: SparkSession, keys: int) -> int:
    """Buckets for so many keys, each of at most BUCKET_BYTES on average: a multiple of the shuffle partitions, so that a bucket is written by one task and is one file, within what Spark allows."""
    dealt, most = int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, dealt * max(1, min(math.ceil(keys * KEY_BYTES / BUCKET_BYTES / dealt), most // dealt)))


class Run:
    """A table with columns h1 and h2 among others, in buckets of these, sorted by them."""

    def __init__(self, rows: DataFrame, buckets: int) -> None:
        self.spark, self.schema, self.name = rows.sparkSession, rows.schema, f"line_run_{uuid.uuid4().hex}"
        self.path = shared_dir(self.spark, "line-run")
        try:
            rows.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.path).saveAsTable(self.name)
        except BaseException:
            self.remove()
            raise

    def rows(self) -> DataFrame:
        """In its buckets: a join on h1 and h2 with what is dealt alike needs no shuffle of it."""
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """As plain rows: a join deals them anew, so that adaptive execution may split a skewed key of the other side."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.path)


class Runs:
    """Levelled runs. A key is new in one of them only; a run of level 0 holds all keys of its batch, with `seen` for those that older runs have."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = buckets or bucket_count(spark, 0)

    def all(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _new(run: Run) -> DataFrame:
        rows = run.rows()
        return (rows.filter(~F.col("seen")) if "seen" in rows.columns else rows).select("h1", "h2")

    def absorb(self, keys: DataFrame) -> Run:
        """Marks which of the keys (h1, h2 and others; each key once) the runs have, adds the others as a run, compacts full levels, and returns the marked keys. Whoever takes them removes them, where compaction has not made them superfluous."""
        with sorted_scans(self.spark):
            return self._absorbed(keys)

    def _absorbed(self, keys: DataFrame) -> Run:
        marked, seen = keys, F.lit(False)
        for i, run in enumerate(self.all()):
            marked = marked.join(self._new(run).withColumn(f"in_{i}", F.lit(True)), ["h1", "h2"], "left")
            seen = seen | F.coalesce(f"in_{i}", F.lit(False))
        taken = Run(marked.select(*keys.columns, seen.alias("seen")), self.buckets)
        run, level = taken, 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return taken
            merged = self._new(self.levels[level][0])
            for r in self.levels[level][1:]:  # keys differ: this merges two sorted runs
                merged = merged.join(self._new(r), ["h1", "h2"], "full_outer")
            run = Run(merged, self.buckets)
            for r in self.levels[level]:
                if r is not taken:
                    r.remove()
            self.levels[level], level = [], level + 1

    def remove(self) -> None:
        for r in self.all():
            r.remove()


def _bounds(docs: DataFrame, batch_bytes: int, least: int) -> list[int]:
    """Ids that part the documents into batches of at most about batch_bytes, `least` at least."""
    quantiles = F.percentile_approx("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 10 * QUANTILES)
    size, at = docs.agg(F.sum(F.octet_length("text")), quantiles).first()
    n = min(QUANTILES, max(least, math.ceil((size or 0) / batch_bytes)))
    return sorted({at[i * QUANTILES // n - 1] for i in range(1, n)}) if at else []


def dropped_lines(docs: DataFrame, batch_bytes: int = BATCH_BYTES, least_batches: int = LEAST_BATCHES) -> DataFrame:
    """(doc_id, version, place) of the lines of docs (doc_id, version, text) that a smaller doc_id holds; places count from 1. Lines whose key is shorter than MIN_CHARS code points stay out.

    A line that very many documents share is one row of a batch's keys after partial aggregation; the join that brings the first document of a shared key back to the lines is a skewed one which adaptive execution splits. Keys are told apart by 128 bits of hash. Buckets follow from the number of lines, which the job that writes them counts. Only what is returned is left in the shared folder, also when a job fails."""
    spark = docs.sparkSession
    cuts = _bounds(docs, batch_bytes, least_batches)
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("doc_id") > c).cast("int")

    def hashes(key: Column) -> Column:
        # the first argument seeds the hash, so these are two independent ones
        return F.when(F.char_length(key) >= MIN_CHARS, F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")))

    # step by step, as a lambda evaluates its argument wherever it stands
    hashed = F.split("text", "\n", -1)
    for f in (lambda line: F.btrim(line, F.lit(BLANK)), ascii_lower, hashes):
        hashed = F.transform(hashed, f)
    lines, drops = shared_dir(spark, "lines"), shared_dir(spark, "dropped-lines")
    schema = "doc_id long, version long, lines array<struct<h1: long, h2: long>>, batch int"
    counted, runs = Observation(), None
    try:
        parts = docs.select("doc_id", "version", hashed.alias("lines"), batch.alias("batch"))
        parts.observe(counted, F.sum(F.size("lines")).alias("lines")).write.partitionBy("batch").parquet(lines)
        runs = Runs(spark, buckets=bucket_count(spark, counted.get["lines"] or 0))
        for b in range(len(cuts) + 1):
            own = spark.read.schema(schema).parquet(lines).filter(F.col("batch") == b).select("doc_id", "version", F.posexplode("lines").alias("place", "h")).filter("h is not null")
            own = own.select("doc_id", "version", (F.col("place") + 1).alias("place"), "h.h1", "h.h2")
            taken = runs.absorb(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
            try:
                shared = taken.files().filter("seen or hi > lo").select("h1", "h2", F.when(~F.col("seen"), F.col("lo")).alias("lo"))
                found = own.join(shared, ["h1", "h2"]).filter("lo is null or doc_id > lo")
                found.select("doc_id", "version", "place").write.mode("append").parquet(drops)
            finally:
                if taken not in runs.all():
                    taken.remove()
    finally:
        if runs:
            runs.remove()
        removed(spark, lines)
    return spark.read.schema("doc_id long, version long, place int").parquet(drops)


def dedup(docs: DataFrame, batch_bytes: int = BATCH_BYTES, least_batches: int = LEAST_BATCHES, text_col: str = "text") -> DataFrame:
    """docs with its texts less the dropped lines, and n_lines and n_dropped (by these names plus underscores where docs has them).

    Lines are parted by \\n. A null or empty text is one empty line, which is kept; null stays null. Rows that repeat a doc_id are one document: none of them drops the others' lines. Rows without doc_id keep all their lines and drop nobody's."""
    n_lines, n_dropped, version, places, lines, kept = fresh(docs, "n_lines", "n_dropped", "_version", "_places", "_lines", "_kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(version, F.xxhash64(text))
    parts = keyed.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(version).alias("version"), text.alias("text"))
    # a set: repeated rows say the same
    found = dropped_lines(parts, batch_bytes, least_batches).groupBy("doc_id", F.col("version").alias(version)).agg(F.collect_set("place").alias(places))
    joined = keyed.join(found, ["doc_id", version], "left").withColumn(lines, F.split(text, "\n", -1))
    joined = joined.withColumn(kept, F.when(F.col(places).isNotNull(), F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(places))))
    left = F.array_join(F.transform(kept, lambda i: F.element_at(F.col(lines), i)), "\n")
    return joined.select(
        *[F.when(F.col(kept).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.when(F.col(kept).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias(n_dropped),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the long lines that a document of smaller doc_id holds; see dedup() for nulls, ties and repeated rows. No documents: no rows."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i, x, lower_ascii AS k FROM (
    SELECT doc_id, i, ls[i] AS x, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (first < doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (first IS NULL OR first >= doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""
