"""WARC: what is written comes back, and what is broken is told."""

import gzip
import hashlib
import io
import random
import zlib

import pytest

from gaugeworks.llm import warc
from gaugeworks.llm.entry import ORACLE_SQL, QUERIES


def test_records_come_back_one_by_one():
    rng = random.Random(1)
    payloads = [b"", b"x", b"\r\n\r\n", bytes(rng.randrange(256) for _ in range(300_000)), b"a" * 2_000_000]
    data = b"".join(warc.record(i, f"http://h/{i} \x01é", p, None, False) for i, p in enumerate(payloads)) + warc.record(9, None, payloads[3], 3, True)
    rows = list(warc.read_archive(io.BytesIO(data), with_payload=True))
    assert [r["payload"] for r in rows[:-1]] == payloads
    assert [r["payload_digest"] for r in rows[:-1]] == [hashlib.sha1(p).hexdigest() for p in payloads]
    assert rows[0]["url"] == "http://h/0%20%01é"
    last = rows[-1]
    assert (last["record_type"], last["refers_to"], last["payload_bytes"], last["payload_digest"]) == ("revisit", 3, 300_000, hashlib.sha1(payloads[3]).hexdigest())
    assert gzip.decompress(warc.record(0, None, b"one member", None, False)).startswith(b"WARC/1.0\r\n")


def broken():
    good = warc.record(1, "u", b"payload of a page" * 50, None, False)
    plain = gzip.decompress(good)
    yield "cut off", good[:-20]
    yield "digest", gzip.compress(plain.replace(b"payload of", b"Payload of", 1))
    yield "too short", gzip.compress(plain.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1))
    yield "too long", gzip.compress(plain + b"more")
    yield "no record", gzip.compress(b"hello\r\n\r\n")
    yield "no header end", gzip.compress(b"WARC/1.0\r\nx: y")
    yield "payload digest", gzip.compress(plain.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"))


@pytest.mark.parametrize(("name", "data"), list(broken()))
def test_broken_archives_are_told(name, data):
    with pytest.raises((warc.Corrupt, zlib.error)):
        list(warc.read_archive(io.BytesIO(data)))


def test_empty_archive():
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def expected(pages):
    """[(page_id, bytes, digest, type, refers_to)]"""
    top = {}
    for p, _, h in pages:
        if p is not None:
            top[h] = max(p, top.get(h, p))
    out = []
    for p, _, h in pages:
        data = (h or "").encode()
        again = len(data) >= 1000 and p != top.get(h)
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again and top.get(h) is not None else "response", top.get(h) if again else None))
    return out


def test_frames(spark, tmp_path):
    long, other = "é" * 600, "b" * 999
    pages = [(1, "http://a/1", long), (2, None, long), (3, "http://a/3", long), (3, "http://a/3", long), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "z" * 300_000)]
    spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, _DIGEST string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["op3_warc"](spark, str(tmp_path)).collect()
    order = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows), key=order) == sorted(expected(pages), key=order)


def test_archives_are_rolled(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "encode(concat(repeat(sha2(cast(id AS string), 512), 20)), 'UTF-8') AS payload", "cast(NULL AS long) AS _refers_to").coalesce(2)
    folder = f"file://{tmp_path}/archives"
    files = warc.write(pages, folder, roll_bytes=5000)
    assert files.agg({"records": "sum"}).first()[0] == 40
    assert files.count() == len(list((tmp_path / "archives").glob("part-*.warc.gz"))) >= 4
    want = {r["page_id"]: bytes(r["payload"]) for r in pages.collect()}
    for archives in (files, warc.listed(spark, folder)):
        rows = warc.read(archives, with_payload=True).collect()
        assert len(rows) == 40 and {r["page_id"]: bytes(r["payload"]) for r in rows} == want


def test_a_second_attempt_in_another_order_neither_loses_nor_doubles(spark, tmp_path):
    """Two attempts of one partition, side by side, that cut their rows elsewhere; the first is the longer one."""
    rng = random.Random(3)
    rows = [(i, f"u{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))), None) for i in range(60)]
    folder = f"file://{tmp_path}/archives"
    first = warc.archive(rows, folder, "part-000000-00000007", roll_bytes=3000)
    begun = [next(first), next(first)]
    second = list(warc.archive(rng.sample(rows, 60), folder, "part-000000-00000009", roll_bytes=9000))
    begun += list(first)
    assert len(begun) > len(second) and sum(n for _, n in second) == 60
    for taken in (begun, second):
        read = warc.read(spark.createDataFrame(taken, "path string, records long")).collect()
        assert sorted(r["page_id"] for r in read) == list(range(60))


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op3_warc"](spark, str(tmp_path)).collect() == []


def test_query(spark, sf, same):
    same(QUERIES["op3_warc"](spark, sf), ORACLE_SQL["op3_warc"])
