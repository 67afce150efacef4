"""Line dedup against a plain loop."""

import hashlib
import random

from pyspark.sql import functions as F

from gaugeworks.llm import line_dedup
from gaugeworks.llm.entry import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(docs):
    """{(doc_id, text): (n_lines, n_dropped, kept)}"""
    first = {}
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                first[key(line)] = min(d, first.get(key(line), d))
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 10 or first[key(x)] == d]
        out[d, t] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def sample(seed, n=120):
    rng = random.Random(seed)
    common = ["A line that is shared", "  a LINE that is shared\t", "short", "", "   ", "nine char", "ten  chars", "ÄÖÜ is not folded here", "äöü is not folded here", "x" * 3000, "\x0btabbed line of text\r"]
    return [(rng.randrange(60), "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own line {rng.randrange(200)} here" for _ in range(rng.randrange(8)))) for _ in range(n)]


def run(spark, docs, **kw):
    frame = spark.createDataFrame([(d, t, "own") for d, t in docs], "doc_id long, text string, N_LINES string")
    return line_dedup.dedup(frame, **kw).collect()


def test_against_brute_force(spark):
    docs = [*sample(1), (None, "A line that is shared"), (None, None), (70, None), (71, ""), (72, "A line that is shared\n" * 40)]
    want = brute(docs)
    for least, size in ((1, 1 << 40), (4, 1 << 40), (1, 3000)):
        rows = run(spark, docs, least_batches=least, batch_bytes=size)
        assert len(rows) == len(docs)
        for r, _ in zip(rows, docs, strict=True):
            assert r["N_LINES"] == "own"
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_lines_"], r["n_dropped"], r["text"] or "") for r in rows)
        assert got == sorted((d if d is not None else -1, *want[d, t]) for d, t in docs)


def test_null_stays_null(spark):
    assert run(spark, [(1, None)])[0]["text"] is None


def test_runs_are_compacted_by_levels(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    shape, seen = [], []
    for b in range(4):
        taken = runs.absorb(spark.range(b * 5, b * 5 + 10).select(F.col("id").alias("h1"), F.col("id").alias("h2")).groupBy("h1", "h2").agg(F.lit(b).alias("b")))
        seen.append(sorted(r["h1"] for r in taken.files().filter("seen").collect()))
        shape.append([len(x) for x in runs.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1]]
    assert seen == [[], *[list(range(b * 5, b * 5 + 5)) for b in (1, 2, 3)]]
    (last,) = runs.all()
    assert sorted((r["h1"], r["h2"]) for r in last.rows().collect()) == [(i, i) for i in range(25)]
    runs.remove()


def test_runs_are_joined_without_a_shuffle_of_them(spark):
    runs = line_dedup.Runs(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for b in range(3):
            runs.absorb(spark.range(b * 100, b * 100 + 150).select(F.xxhash64("id").alias("h1"), F.hash("id").cast("long").alias("h2")).groupBy("h1", "h2").agg(F.lit(b).alias("b")))
        keys = spark.range(500).select(F.xxhash64("id").alias("h1"), F.hash("id").cast("long").alias("h2")).groupBy("h1", "h2").agg(F.lit(9).alias("b"))
        joined = keys
        for i, r in enumerate(runs.all()):
            joined = joined.join(runs._new(r).withColumn(f"in_{i}", F.lit(True)), ["h1", "h2"], "left")
        with line_dedup.sorted_scans(spark):
            plan = joined._jdf.queryExecution().executedPlan().toString()
        assert len(runs.all()) == 2 and plan.count("SortMergeJoin") == 2
        assert plan.count("Exchange hashpartitioning") == 1  # that of the keys' aggregation
        assert plan.count("Sort [") == 1  # of the keys; runs are sorted files
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.remove()


def test_buckets_grow_with_the_keys(spark):
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a_bucket = line_dedup.BUCKET_BYTES // line_dedup.KEY_BYTES
    assert [line_dedup.bucket_count(spark, n * a_bucket) for n in (0, 1, dealt, dealt + 1, 10 * dealt)] == [dealt, dealt, dealt, 2 * dealt, 10 * dealt]
    assert line_dedup.bucket_count(spark, 10**15) == 100_000
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", dealt - 1)
    try:
        assert line_dedup.bucket_count(spark, 0) == dealt - 1
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_more_buckets_than_shuffle_partitions(spark, monkeypatch):
    """Same results; a bucket of a run is one file however many there are."""
    monkeypatch.setattr(line_dedup, "BUCKET_BYTES", 200)
    docs, files = sample(2), []
    whole = line_dedup.Run.__init__

    def watched(self, rows, buckets):
        whole(self, rows, buckets)
        names = [f.rsplit("_", 1)[1] for f in self.spark.read.parquet(self.path).inputFiles()]
        files.append((buckets, len(names) == len(set(names))))

    monkeypatch.setattr(line_dedup.Run, "__init__", watched)
    got = sorted((r["doc_id"], r["n_lines_"], r["n_dropped"], r["text"]) for r in run(spark, docs))
    want = brute(docs)
    assert got == sorted((d, *want[d, t]) for d, t in docs)
    assert all(n > 4 and n % 4 == 0 and single for n, single in files)


def test_a_failed_batch_leaves_no_tables(spark, monkeypatch):
    kept, tables = line_dedup.Run.files, lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    calls = []

    def breaks(self):
        calls.append(self)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return kept(self)

    monkeypatch.setattr(line_dedup.Run, "files", breaks)
    before = tables()
    try:
        run(spark, sample(3))
    except RuntimeError as e:
        assert str(e) == "lost"
    assert len(calls) == 3 and tables() == before


def test_no_rows(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf, same, tables):
    same(QUERIES["op9_line_dedup"](spark, sf), ORACLE_SQL["op9_line_dedup"])
    docs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    want = {d: v for (d, _), v in brute(docs).items()}
    for r in QUERIES["op9_line_dedup"](spark, sf).collect():
        n, dropped, kept = want[r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
