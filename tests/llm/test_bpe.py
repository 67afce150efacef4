"""Byte-level BPE against the tiktoken library, and its round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
HARD = ["", " ", "a", "  two  spaces\n\n\tand tabs ", "naïve café — 東京タワー 🙂👩‍👩‍👧", "it's I'll DON'T", "0123456789" * 40, "x" * 5000, "ab" * 3000, "\u0000\u0001�", "<|endoftext|>", "\r\n   ", "zażółć gęślą jaźń " * 30, "aaaa" * 700 + " " * 900]


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe.load(PATH, PATTERN)


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_tiktokens(ours, theirs):
    encode = ours.encoder()
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("ab cé\n1,<ü東") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        ids = encode(t)
        assert list(ids) == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(ours, theirs, text):
    assert list(ours.encoder()(text)) == theirs.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(3000))
    assert sorted(h.index) == list(range(3000))
    assert all(h.get(f"other{i}".encode()) == -1 for i in range(3000))
    assert bpe.PerfectHash([]).get(b"x") == -1
    assert bpe.PerfectHash([b"one"]).get(b"one") == 0


def test_frames(spark, theirs):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate([*HARD, None])], "id int, text string, N_TOKENS string")
    out = {r["id"]: r for r in bpe.digests(docs, PATH, PATTERN, ids_col="packed").collect()}
    for i, t in enumerate([*HARD, None]):
        ids = theirs.encode_ordinary(t or "")
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (out[i]["N_TOKENS"], out[i]["n_tokens_"]) == ("own", len(ids))
        assert bytes(out[i]["packed"]) == data
        assert out[i]["ids_sha256"] == hashlib.sha256(data).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert {r["id"]: bytes(r["decoded"]) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate([*HARD, None])}


def test_no_rows(spark):
    assert bpe.digests(spark.createDataFrame([], "text string"), PATH, PATTERN).collect() == []


def test_query(spark, sf, tables, theirs):
    from gaugeworks.llm.entry import QUERIES

    texts = dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op1_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
