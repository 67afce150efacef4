"""Rendezvous hashing: weights, growth, slots."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import sharding
from gaugeworks.llm.entry import QUERIES


def test_growth_moves_rows_into_the_new_shard_only(spark):
    rows = sharding.shard(spark.range(20_000).withColumnRenamed("id", "doc_id")).collect()
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 16 for r in moved)
    assert abs(len(moved) / len(rows) - 1 / 17) < 0.01
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.range(20_000).withColumnRenamed("id", "doc_id"), weights=(1.0,) * 17).collect()}
    assert grown == {r["doc_id"]: r["grown_shard"] for r in rows}


def test_weights_are_shares(spark):
    weights = (1.0, 2.0, 5.0)
    counts = Counter(r["shard"] for r in sharding.shard(spark.range(30_000).withColumnRenamed("id", "doc_id"), weights=weights).collect())
    for s, w in enumerate(weights):
        assert abs(counts[s] / 30_000 - w / 8) < 0.015
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("x"), [0.0])


def test_placement_is_stable(spark):
    frame = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("kept").alias("_best"))
    one = {r["doc_id"]: r["shard"] for r in sharding.shard(frame).collect()}
    two = {r["doc_id"]: r["shard"] for r in sharding.shard(frame.repartition(7).filter("doc_id % 3 = 0")).collect()}
    assert all(one[k] == v for k, v in two.items())
    assert {r["_best"] for r in sharding.shard(frame).collect()} == {"kept"}


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, SHARD string").write.parquet(f"{path}/documents.parquet")
    return QUERIES["op6_sharding"](spark, str(path))


def check(rows, texts):
    """texts: doc_id to text, where ids are unique."""
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
        if r["doc_id"] in texts:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_nulls_repeats_and_clashes(spark, tmp_path):
    rows = [(i, f"text {i} ü", "own") for i in range(300)] + [(400, None, "own"), (401, "", "own"), (None, "no id", "own")] + [(402, "same", "own")] * 3
    out = write(spark, tmp_path, rows).collect()
    assert len(out) == len(rows)
    check(out, {d: t for d, t, _ in rows})
    assert len({r["shard"] for r in out if r["doc_id"] == 402}) == 1


def test_no_rows(spark, tmp_path):
    assert write(spark, tmp_path, []).collect() == []


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 3)
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    out = sharding.slots(sharding.shard(docs), 2000).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query(spark, sf, tables):
    rows = QUERIES["op6_sharding"](spark, sf).collect()
    texts = dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check(rows, texts)


def test_no_python_on_the_executors(spark, sf):
    for name in ("op6_sharding", "op9_line_dedup", "op10_fingerprints"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_shards_are_those_of_the_highest_score(spark):
    """Scores worked out anew, by a library's hash."""
    import math
    import struct

    import xxhash

    def score(key, s, weight=1.0):
        h = xxhash.xxh64(str(key).encode(), seed=xxhash.xxh64(struct.pack("<i", s), seed=42).intdigest()).intdigest()
        return -weight / math.log(((h >> 11) + 0.5) * 2.0**-53), s

    for kind in ("int", "long", "string"):
        for r in sharding.shard(spark.range(300).select(F.col("id").cast(kind).alias("doc_id"))).collect():
            assert r["shard"] == max(score(r["doc_id"], s) for s in range(16))[1]
            assert r["grown_shard"] == max(score(r["doc_id"], s) for s in range(17))[1]
