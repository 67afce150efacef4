"""Token counts against the tokenizers library."""

import random
import sys

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"
HARD = [
    "", " ", "  ", "\n", " \n ", "a", "it's I'll DON'T we've 'sure 'r 're 'rest 'v 'l 'll ''s .'s x''re' '", "'", "' s", " 's", "l'l", "'l 'le 'lll", "a  'd\n'm\t'x", "  two  spaces\n\n\tand tabs ",
    "naïve café — 東京タワー 🙂👩‍👩‍👧", "0123456789" * 40, "x" * 5000, "ab" * 3000, "\u0000\u0001\x1c\x85\xa0  b", SPECIAL, f"a {SPECIAL} b{SPECIAL}{SPECIAL} ", "<|endoftext|", "<|<|endoftext|>|>",
    "\r\n   ", "zażółć gęślą jaźń " * 30, "aaaa" * 700 + " " * 900, "-" * 700 + "=" * 300, "Ա՘֋", "ՙa¼²١Ⅷ",
]


@pytest.fixture(scope="module")
def ours():
    return tc.Transducer(tc.Vocabulary(open(PATH, encoding="utf-8").read()))


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def _random_text(rng, n=200):
    return "".join(rng.choice([*"ab cé\n1,'srevlmtd<ü東  ", "'re", "the ", " 's", SPECIAL, "\t"]) for _ in range(rng.randrange(n)))


def test_hard_and_random_texts(ours, theirs):
    rng = random.Random(3)
    for t in HARD + [_random_text(rng) for _ in range(1500)]:
        assert ours.count(t) == theirs(t), t


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(ours, theirs, text):
    assert ours.count(text) == theirs(text)


def test_every_character(ours, theirs):
    """In one text of all characters, each next to letters, digits, signs and white space."""
    chars = [chr(c) for c in range(0x80, sys.maxunicode + 1, 7) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x2000)]
    for i in range(0, len(chars), 500):
        text = "".join(f"a{c}a1{c}1 {c}!{c}" for c in chars[i : i + 500])
        assert ours.count(text) == theirs(text), i


def test_many_texts_side_by_side(ours, theirs, monkeypatch):
    rng = random.Random(6)
    texts = [_random_text(rng, 900) for _ in range(300)] + HARD
    want = [theirs(t) for t in texts]
    for lane, few in ((1, 1), (3, 16), (256, 16), (10**6, 1)):
        monkeypatch.setattr(tc, "LANE", lane)
        monkeypatch.setattr(tc, "FEW", few)
        assert ours.counts(texts) == want
    assert ours.counts([]) == []


def test_tokens_apart(ours):
    """By the edges of two tokens, as by BPE of their bytes."""
    v, rng = ours.vocabulary, random.Random(7)
    assert v.proper
    same = [v.number[x] for x in (b"a", b"aa", b"aaa", b"aaaa", b" ", b"  ", b"   ", b"--", b"-", b"----", b"......") if x in v.number]
    pairs = [(a, b) for a in same for b in same] + [(rng.randrange(len(v.bytes_of)), rng.randrange(len(v.bytes_of))) for _ in range(20000)]
    for a, b in pairs:
        if len(v.bpe(v.bytes_of[a])) == len(v.bpe(v.bytes_of[b])) == 1:
            assert v.apart(a, b) == (v.bpe(v.bytes_of[a] + v.bytes_of[b]) == [a, b])


def test_forgotten_states(ours, theirs, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    rng = random.Random(4)
    for _ in range(50):
        t = _random_text(rng)
        assert ours.count(t) == theirs(t)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_maps_compose_in_any_order(ours, theirs, size):
    rng = random.Random(size)
    for t in [t[:600] for t in HARD] + [_random_text(rng) for _ in range(100)]:
        pieces = ours.cuts(t, size)
        assert "".join(pieces) == t
        assert all(len(p) >= size for p in pieces[:-1])
        maps = [tc.Map.unpacked(ours.chunk(p).packed()) for p in pieces] or [tc.Map("")]
        while len(maps) > 1:  # associative: neighbours are joined at random
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [tc.Map.composed(ours, *maps[i : i + 2])]
        state, n = maps[0].applied(ours, ours.start)
        assert n + ours.ending(state) == theirs(t), t


def test_states_are_finite(ours):
    """A word of one letter leads into a circle of states: a million letters make no more of them."""
    for letter in "aø東-":
        ours.forget()
        ours.count(letter * 2000)
        seen = ours.edges.size
        ours.count(letter * 20000)
        assert ours.edges.size == seen


def test_frames(spark, theirs):
    rng = random.Random(5)
    words = ["the", "naïve", "1984", "don't", SPECIAL, "東京", "\n\n", "  ", "x" * 300]
    long = [" ".join(rng.choice(words) for _ in range(3000)), "x" * 30000, "東" * 5000, f"{SPECIAL} " * 900, "a b" * 9000]
    texts = [*HARD, *long, *long, None]
    docs = spark.createDataFrame([(i, t, "own", i) for i, t in enumerate(texts)], "id int, text string, N_TOKENS string, place int").repartition(3)
    out = {r["id"]: r for r in tc.counts(docs, PATH, chunk=1000, limit=5).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        n = theirs(t or "")
        assert (out[i]["N_TOKENS"], out[i]["place"], out[i]["n_tokens_"], out[i]["over_limit"], out[i]["n_bytes"]) == ("own", i, n, n > 5, len((t or "").encode())), t
        assert out[i]["text"] == t


def test_repeated_rows(spark, theirs):
    docs = spark.createDataFrame([(1, "a b " * 900)] * 3 + [(1, "c")] * 2, "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in tc.counts(docs, PATH, chunk=500, keep_text=False).collect()) == [1, 1] + [theirs("a b " * 900)] * 3


def test_no_rows(spark):
    assert tc.counts(spark.createDataFrame([], "text string"), PATH).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="supported"):
        tc.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_query(spark, sf, tables, theirs):
    from gaugeworks.llm.entry import QUERIES

    texts = dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op13_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), theirs(t), theirs(t) > 512)
