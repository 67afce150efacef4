"""Periodic runs against a plain search of every period."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from gaugeworks.llm import periodic_runs as pr


def brute(words, least=24, times=3):
    """Every period, every maximal stretch; the smallest period of each."""
    n, best = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                best.setdefault((i, j + p - i), p)  # smaller periods come first
            i = j + 1
    return sorted((i, n, p) for (i, n), p in best.items())


def loopy(rng, n, letters):
    """Words with loops inside loops and copies of earlier parts."""
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3 or not out:
            out += [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
        elif kind < 0.6:
            part = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            out += part * rng.randrange(2, 12) + part[: rng.randrange(len(part) + 1)]
        elif kind < 0.8:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(80)]
        else:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(1, 50)] * rng.randrange(2, 5)
    return out[:n]


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "".join(map(chr, range(200, 500)))])
def test_runs_are_those_of_a_plain_search(letters):
    rng = random.Random(len(letters))
    for k in range(150):
        words = loopy(rng, rng.randrange(1, 400), letters)
        ids = np.array([ord(w) for w in words])
        assert pr.runs(ids) == brute(words), (k, words)
        assert pr.runs(ids, 6) == brute(words, 6), (k, words)
        assert pr.runs(ids, 3, 4) == brute(words, 3, 4), (k, words)


def test_short_and_uniform_sequences():
    assert pr.runs(np.empty(0, np.int64)) == []
    assert pr.runs(np.zeros(23, np.int64)) == []
    assert pr.runs(np.zeros(24, np.int64)) == [(0, 24, 1)]
    assert pr.runs(np.arange(100)) == []
    assert pr.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    fibonacci = "a", "ab"
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert pr.runs(np.frombuffer(fibonacci[1].encode(), np.uint8)) == brute(fibonacci[1])


def test_factors_order_and_extend():
    rng = random.Random(1)
    for _ in range(40):
        words = loopy(rng, 120, "ab")
        f = pr.Factors(np.array([ord(w) for w in words]))
        text = "".join(words)
        assert f.order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        a, b = np.array([rng.randrange(len(text)) for _ in range(300)]), np.array([rng.randrange(len(text) + 1) for _ in range(300)])
        a[a == b] = (a[a == b] + 1) % len(text)
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        keep = a != b
        assert f.ahead(a[keep], b[keep]).tolist() == [common(text[i:], text[j:]) for i, j in zip(a[keep], b[keep], strict=True)]
        assert f.back(a[keep] - 1, b[keep] - 1).tolist() == [common(text[:i][::-1], text[:j][::-1]) for i, j in zip(a[keep], b[keep], strict=True)]
        lpf, source = pr.longest_previous(f)
        for i in range(len(text)):
            assert lpf[i] == max((common(text[i:], text[j:]) for j in range(i)), default=0)
            assert lpf[i] == 0 or (source[i] < i and text[source[i] :].startswith(text[i : i + lpf[i]]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {k for i, m, p in found for k in range(i + p, i + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (
        len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{i},{m},{p}\n" for i, m, p in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest(),
    )


def row(r):
    return r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]


def test_frames(spark, monkeypatch):
    """Odd texts, repeated rows, further columns with the same names, batches of few words."""
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "a " * 24, "a " * 23, "x y " * 30, "a b\x1cc " * 20, *(" ".join(loopy(rng, rng.randrange(300), "abé")) for _ in range(40))]
    rows = [(i, t, "own") for i, t in enumerate(texts)] * 2 + [(None, "a b " * 20, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PERIOD string")
    for size in (50, 10**6):
        monkeypatch.setattr(pr, "BATCH_WORDS", size)
        out = pr.detect(docs, id_col="doc_id", change=pr.looped).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r["PERIOD"] == "own"
            want = expected(r["doc_id"], r["text"]) if r["doc_id"] is not None else (1, 0, 40, 2, 20000)
            got = (r["n_runs"], r["start"], r["length"], r["period_"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])
            assert got[: len(want)] == want, r


def test_no_rows(spark):
    assert pr.detect(spark.createDataFrame([], "text string")).collect() == []


def test_query(spark, sf, tables):
    from gaugeworks.llm.entry import QUERIES

    texts = dict(tables.execute("SELECT doc_id, text FROM documents WHERE length(text) < 8000").fetchall())
    rows = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(rows) == tables.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert sum(r["n_runs"] > 0 for r in rows.values()) > 10
    for i, t in texts.items():
        assert row(rows[i]) == expected(i, t)
