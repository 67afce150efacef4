"""Consistent weighted sampling: law, edits and order of the documents."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from gaugeworks.llm import fingerprints
from gaugeworks.llm.entry import QUERIES


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    terms = a.keys() | b.keys()
    return sum(min(a[t], b[t]) for t in terms) / sum(max(a[t], b[t]) for t in terms)


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(2)
    pairs = []
    for share in (0.1, 0.4, 0.7, 0.95):
        a = [f"w{rng.randrange(40)}" for _ in range(200)]
        b = [x if rng.random() < share else f"v{rng.randrange(40)}" for x in a]
        pairs.append((a, b))
    rows = [(i * 2 + j, w) for i, p in enumerate(pairs) for j, words in enumerate(p) for w in words]
    bags = spark.createDataFrame(rows, "k long, word string").groupBy("k", F.xxhash64("word").alias("term")).agg(F.count("*").alias("w"))
    prints = {r["k"]: r["p"] for r in fingerprints.signatures(bags, ["k"], {"w": "p"}, samples=600).collect()}
    for i, (a, b) in enumerate(pairs):
        got = sum(x == y for x, y in zip(prints[i * 2], prints[i * 2 + 1], strict=True)) / 600
        assert abs(got - jaccard(a, b)) < 0.09
    assert len({len(p) for p in prints.values()}) == 1


def test_error_of_each_pair_at_the_querys_setting(spark):
    """Every pair keeps to the binomial law of SAMPLES samples; pairs have words of their own."""
    rng = random.Random(6)
    pairs = []
    for i in range(150):
        a = [f"{i}w{rng.randrange(40)}" for _ in range(120)]
        pairs.append((a, [x if rng.random() < i % 10 / 10 else f"{i}v{rng.randrange(40)}" for x in a]))
    rows = [(i * 2 + j, w) for i, p in enumerate(pairs) for j, words in enumerate(p) for w in words]
    bags = spark.createDataFrame(rows, "k long, word string").groupBy("k", F.xxhash64("word").alias("term")).agg(F.count("*").alias("w"))
    prints = {r["k"]: r["p"] for r in fingerprints.signatures(bags, ["k"], {"w": "p"}).collect()}
    n = fingerprints.SAMPLES
    off = []
    for i, (a, b) in enumerate(pairs):
        want = jaccard(a, b)
        got = sum(x == y for x, y in zip(prints[i * 2], prints[i * 2 + 1], strict=True)) / n
        off.append(abs(got - want) / max((want * (1 - want) / n) ** 0.5, 1 / n))
    assert {len(p) for p in prints.values()} == {n}
    assert max(off) < 5 and sum(x > 2 for x in off) < 0.1 * len(off)


def edited(docs):
    """[(doc_id, text, edited, next text)] in falling order of doc_id, of one doc_id by text."""
    order = sorted(docs, key=lambda x: x[1])
    order.sort(key=lambda x: -x[0])
    out = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        out.append((d, t, t[: len(t) - n] + after[:n], after))
    return out


def docs_with_hard_cases():
    rng = random.Random(4)
    docs = [(i * 3, " ".join(rng.choice(["ab", "ć", "ef", "東京", "\n"]) for _ in range(rng.randrange(30)))) for i in range(40)]
    return [*docs, (7, ""), (7, ""), (8, "same text here"), (10, "same text here"), (300, "long " * 4000)]


def test_next_document_whatever_the_groups(spark, monkeypatch):
    docs = docs_with_hard_cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((d, t, after) for d, t, _, after in edited(docs))
    for size, limit, stretch in ((200, 10**6, 4096), (200, 10**6, 3), (1000, 2, 1), (1 << 21, 10**6, 4096)):
        monkeypatch.setattr(fingerprints, "GROUPS_BROADCAST", limit)
        monkeypatch.setattr(fingerprints, "STRETCH", stretch)
        monkeypatch.setattr(fingerprints, "grouped_by_id", lambda d, s=size, f=fingerprints.grouped_by_id: f(d, s))
        rows = fingerprints.with_next(frame).collect()
        monkeypatch.undo()
        assert sorted((r["doc_id"], r["text"], r["next_text"]) for r in rows) == want


def write(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, TERM string, part string").write.parquet(f"{tmp_path}/documents.parquet")
    return QUERIES["op10_fingerprints"](spark, str(tmp_path))


def test_rows(spark, tmp_path):
    docs = docs_with_hard_cases()
    rows = write(spark, tmp_path, [(d, t if t or i % 2 else None, "x", "y") for i, (d, t) in enumerate(docs)]).collect()
    want = sorted((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in edited(docs))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    prints = {}
    for r in rows:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[8] == prints[10] and len(prints[7]) == 1
    assert all(r["near_edited"] == 1 for r in rows if r["fingerprint"] == r["edited_fingerprint"])


def test_one_document_and_none(spark, tmp_path):
    (row,) = write(spark, tmp_path / "one", [(5, "a b c d e f", None, None)]).collect()
    assert (row["near_next"], row["edited_sha256"]) == (1.0, hashlib.sha256(b"a b c d a b").hexdigest())
    assert write(spark, tmp_path / "none", []).collect() == []


def test_query(spark, sf, tables):
    docs = [(d, t or "") for d, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()]
    want = {d: (len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, after) for d, t, e, after in edited(docs)}
    rows = QUERIES["op10_fingerprints"](spark, sf).collect()
    assert len(rows) == len(docs)
    off = []
    for r in rows:
        n, h, t, e, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, h)
        off += [abs(r["near_edited"] - jaccard(t.split() or [""], e.split() or [""])), abs(r["near_next"] - jaccard(t.split() or [""], after.split() or [""]))]
    assert sum(off) / len(off) < 0.08
