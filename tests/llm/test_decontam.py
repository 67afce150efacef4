"""Decontamination against a search word by word."""

import hashlib
import pickle
import random
import re
import time
import tracemalloc

import numpy as np

from gaugeworks.llm import decontam
from gaugeworks.llm.entry import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        k = min(window, len(b))
        for i in range(len(b) - k + 1 if b else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == b[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def random_text(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(rng.randrange(n)))


def test_windows_against_brute_force():
    rng = random.Random(5)
    vocabulary = ["a", "b", "AB", "é", "Éa", "x1", "東京", "zz"]
    for window in (1, 2, 3, 10):
        for _ in range(60):
            items = [(f"i{i}", random_text(rng, 14, vocabulary)) for i in range(rng.randrange(5))]
            windows = decontam.Windows(items, window)
            text = random_text(rng, 60, vocabulary)
            n, spans, found = windows.search(text)
            assert (n, sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True)), found) == brute(text, items, window)


def test_shifts_never_skip_a_match():
    rng = random.Random(6)
    patterns = sorted({bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(3, 20))) for _ in range(80)})
    blob, starts = b"".join(patterns), np.cumsum([0, *map(len, patterns[:-1])])
    search = decontam.WuManber(blob, starts, np.array([len(p) for p in patterns]))
    text = bytes(rng.choice(b"abcd ") for _ in range(4000))
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    assert sorted((i, patterns[p]) for i, p in search.find(text)) == want


def test_a_full_bucket_is_bisected():
    """Items of one template share a block: the search doesn't grow with their number."""
    tail = "common tail of nine words that all items share"
    text = " ".join(f"{k:06d} {tail}" for k in range(0, 3000, 3))
    took = []
    for n in (1000, 8000):
        windows = decontam.Windows([(f"i{k}", f"{k:06d} {tail}") for k in range(n)])
        began = time.process_time()
        _, spans, found = windows.search(text)
        took.append(time.process_time() - began)
        assert found == sorted(f"i{k}" for k in range(0, min(n, 3000), 3))
    assert took[1] < 3 * took[0] + 0.2


def test_equal_beginnings_of_one_length_and_of_many():
    head = "one two three four five six seven eight nine"
    items = [(f"i{k}", f"{head} {'x' * (k % 7)}{k}") for k in range(3000)]
    windows = decontam.Windows(items)
    text = " ".join(f"{head} {'x' * (k % 7)}{k}" for k in range(0, 4000, 7)) + f" {head} xx {head}"
    began = time.process_time()
    _, spans, found = windows.search(text)
    assert time.process_time() - began < 1
    assert found == sorted(f"i{k}" for k in range(0, 3000, 7))


def test_stretches_of_a_long_item_have_all_its_windows():
    rng = random.Random(9)
    for n, most, window in ((0, 50, 10), (7, 50, 10), (10, 1, 10), (500, 50, 10), (500, 400, 3), (501, 10**6, 10)):
        words = [f"w{rng.randrange(1000)}".encode() for _ in range(n)]
        parts = list(decontam._stretches(words, most, window))
        windows = {tuple(words[i : i + window]) for i in range(max(1, n - window + 1))}
        assert {tuple(p[i : i + window]) for p, _ in parts for i in range(max(1, len(p) - window + 1))} == windows
        assert all(size == sum(len(w) + 1 for w in p) for p, size in parts)


def test_table_is_compact():
    rng = random.Random(10)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10))) for _ in range(150_000))
    assert 900_000 < len(text) < 1_100_000
    tracemalloc.start()
    windows = decontam.Windows([("one", text[:500_000]), ("two", text[500_000:])])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 25 * len(text) and len(pickle.dumps(windows)) < 25 * len(text)  # 8 MB of text: less than 200 MB
    assert windows.search(text[1000:2000])[2] == ["one"]


def test_merged_spans():
    assert decontam.merged([0, 3, 8, 9], [2, 5, 9, 12]) == [0, 5, 8, 12]


def test_frames_in_blocks_with_nulls_and_clashes(spark):
    rng = random.Random(8)
    vocabulary = ["one", "two", "Three", "four", "fünf"]
    items = [(f"q{i}", random_text(rng, 20, vocabulary)) for i in range(12)] + [("same", "one two"), ("same2", "ONE two!"), ("empty", ""), ("none", None)]
    docs = [(i, random_text(rng, 80, vocabulary), "own") for i in range(40)] + [(40, None, "own"), (41, "", "own"), (42, "one two", "own"), (42, "one two", "own")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, N_WORDS string")
    want = {(d, *brute(t, items, 10)) [:3] + (tuple(brute(t, items, 10)[2]),) for d, t, _ in docs}
    for block_bytes in (decontam.BLOCK_BYTES, 300):
        out = decontam.hits(frame, benchmark, block_bytes=block_bytes)
        rows = out.withColumn("n_hit", decontam.n_hit("hit_spans")).collect()
        assert len(rows) == len(docs)
        assert {(r["doc_id"], r["n_words_"], r["n_hit"], tuple(r["hit_items"])) for r in rows} == want
    kept = {r["doc_id"] for r in decontam.clean(frame, benchmark).collect()}
    assert kept == {d for d, t, _ in docs if not brute(t, items, 10)[1]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontam.hits(docs, none).first()["hit_items"] == []
    assert decontam.hits(docs.limit(0), none).collect() == []


def test_query(spark, sf, same, tables):
    same(QUERIES["op5_decontamination"](spark, sf), ORACLE_SQL["op5_decontamination"])
    items = tables.execute("SELECT item_id::VARCHAR, text FROM benchmark").fetchall()
    texts = dict(tables.execute("SELECT doc_id, text FROM documents WHERE length(text) < 3000").fetchall())
    for r in QUERIES["op5_decontamination"](spark, sf).filter("contaminated").collect()[:5]:
        if r["doc_id"] in texts:
            n, hit, found = brute(texts[r["doc_id"]], items, 10)
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
