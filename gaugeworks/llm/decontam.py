"""Benchmark decontamination: Wu-Manber search of all windows of benchmark words in every document."""

from __future__ import annotations

import hashlib
import math
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, removed, shared_dir, slices, table

WINDOW = 10
#: Bytes of benchmark text whose tables are sent to the executors at once; a larger benchmark is searched for in blocks of this size.
BLOCK_BYTES = 8 << 20
#: Bytes of other characters become spaces, A-Z become a-z; bytes of 0x80 and more belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class WuManber:
    """Patterns of one class of lengths: stretches of `blob` from `starts` on, of `lengths`.

    m: the shortest pattern's length. table: for each hash of a block of `block` bytes within the patterns' first m bytes, how far its last place is from m at least; other blocks let the search move by m - block + 1. Blocks that share a hash share the smaller shift, which skips nothing. buckets: the patterns in the order of the hash of the block that ends at m, then of that of their first m bytes; within: of equal ones, in the order of length, then of the whole pattern's hash. So a bucket, however large, is searched by bisection for the text's own bytes."""

    def __init__(self, blob: bytes, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.blob = blob
        self.m = m = int(lengths.min())
        # enough bytes that a block of other text is seldom one of the patterns'
        self.block = b = min(m, max(2, math.ceil(math.log(2 * m * len(starts), 8))))
        self.far = far = min(255, m - b + 1)
        near = np.full(len(blob) + 1, far, np.uint8)  # by where a block ends in blob
        for j in range(max(b, m - far + 1), m + 1):
            near[starts + j] = np.minimum(near[starts + j], m - j)
        ends = np.flatnonzero(near < far)
        self.mask = (1 << max(8, (4 * len(ends)).bit_length())) - 1
        self.table = bytearray([far]) * (self.mask + 1)
        for end, shift in zip(ends.tolist(), near[ends].tolist(), strict=True):
            h = crc32(blob[end - b : end]) & self.mask
            if shift < self.table[h]:
                self.table[h] = shift
        ends = list(zip(starts.tolist(), lengths.tolist(), strict=True))
        bucket = np.fromiter(((crc32(blob[s + m - b : s + m]) & self.mask) << 32 | crc32(blob[s : s + m]) for s, _ in ends), np.uint64, len(ends))
        within = np.fromiter((n << 32 | crc32(blob[s : s + n]) for s, n in ends), np.uint64, len(ends))
        order = np.lexsort((within, bucket))
        self.buckets, self.within, self.order = array("Q", bucket[order].tobytes()), array("Q", within[order].tobytes()), array("I", order.tolist())
        self.starts, self.lengths = array("I", starts.tolist()), array("I", lengths.tolist())

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, number of the pattern) of all occurrences, overlapping ones too."""
        m, b, table, mask, buckets, within, blob, at, n = self.m, self.block, self.table, self.mask, self.buckets, self.within, self.blob, self.m, len(text)
        while at <= n:
            h = crc32(text[at - b : at]) & mask
            step = table[h]
            if step:
                at += step
                continue
            begin = at - m
            bucket = h << 32 | crc32(text[begin:at])
            k = bisect_left(buckets, bucket)
            stop = k if k == len(buckets) or buckets[k] != bucket else bisect_right(buckets, bucket, k)
            while k < stop:  # each length that the bucket has
                length = within[k] >> 32
                whole = length << 32 | crc32(text[begin : begin + length])
                for i in range(bisect_left(within, whole, k, stop), stop):
                    if within[i] != whole:
                        break
                    p = self.order[i]
                    start = self.starts[p]
                    if text.startswith(blob[start : start + length], begin):
                        yield begin, p
                k = bisect_left(within, length + 1 << 32, k, stop)
            at += 1


class Windows:
    """The windows of some benchmark items, ready to be searched for: about ten bytes of arrays for each byte of the items' text."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> None:
        self._fill(((item, words_of(text)) for item, text in items), window)

    @classmethod
    def of_words(cls, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> Windows:
        made = cls.__new__(cls)
        made._fill(items, window)
        return made

    def _fill(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        blob, starts, lengths, owner, names = bytearray(), [], [], [], []
        for item, words in items:
            if not words:
                continue
            k = min(window, len(words))
            spaces = len(blob) + np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
            blob += b" " + b" ".join(words) + b" "
            starts.append(spaces[: len(words) - k + 1])
            lengths.append(spaces[k:] + 1 - starts[-1])
            owner.append(np.full(len(starts[-1]), len(names)))
            names.append(item)
        self.names, self.searches, self.classes = names, [], []
        if not names:
            return
        blob = bytes(blob)
        starts, lengths, owner = (np.concatenate(x).astype(np.int64) for x in (starts, lengths, owner))
        first, owners = self._distinct(blob, starts, lengths, owner)
        # short windows would keep the shifts of the others small
        kind = np.digitize(lengths[first], (12, 32))
        for c in np.unique(kind):
            at = np.flatnonzero(kind == c)
            self.searches.append(WuManber(blob, starts[first[at]], lengths[first[at]]))
            of = [owners[i] for i in at.tolist()]
            self.classes.append((array("I", np.cumsum([0, *map(len, of)]).tolist()), array("I", np.concatenate(of).tolist())))

    @staticmethod
    def _distinct(blob: bytes, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """One of each set of equal windows, and the items that have it."""
        text = lambda i: blob[starts[i] : starts[i] + lengths[i]]
        h = np.fromiter((int.from_bytes(hashlib.blake2b(blob[s : s + n], digest_size=8).digest(), "little") for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)), np.uint64, len(starts))
        order = np.argsort(h, kind="stable")
        first, owners = [], []
        for same in np.split(order, np.flatnonzero(np.diff(h[order])) + 1):
            while len(same):  # hashes may meet, texts decide
                here = np.array([True]) if len(same) == 1 else np.array([text(i) == text(same[0]) for i in same])
                first.append(same[0])
                owners.append(np.unique(owner[same[here]]))
                same = same[~here]
        return np.array(first), owners

    def search(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Number of words, [first, end, ...] of the hit words in rising order, and the items."""
        words = words_of(text)
        if not words:
            return 0, [], []
        data = b" " + b" ".join(words) + b" "
        found: dict[int, int] = {}
        items: set[int] = set()
        for search, (edge, owner) in zip(self.searches, self.classes, strict=True):
            for start, p in search.find(data):
                found[start] = max(found.get(start, 0), search.lengths[p])
                items.update(owner[edge[p] : edge[p + 1]])
        spans: list[int] = []
        at = word = 0
        for start, length in sorted(found.items()):
            word += data.count(b" ", at, start)
            at = start
            last = word + data.count(b" ", start, start + length) - 1
            if spans and word <= spans[-1]:
                spans[-1] = max(spans[-1], last)
            else:
                spans += [word, last]
        return len(words), spans, sorted({self.names[i] for i in items})


def merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for first, end in sorted(zip(a[::2] + b[::2], a[1::2] + b[1::2], strict=True)):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def _stretches(words: list[bytes], most: int, window: int = WINDOW) -> Iterator[tuple[list[bytes], int]]:
    """A long item's words in overlapping stretches of about `most` bytes that have all its windows between them, with their bytes."""
    begin = 0
    while True:
        end, size = begin, 0
        while end < len(words) and (size < most or end - begin < window):
            size += len(words[end]) + 1
            end += 1
        yield words[begin:end], size
        if end >= len(words):
            return
        begin = end - window + 1


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The benchmark's windows in tables of a bounded size, one after the other. Items come to the driver one by one; null ids count as "null". A longer item is spread over several tables."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text.alias("text")).distinct()
    sc = benchmark.sparkSession.sparkContext
    block, held = [], 0
    for r in rows.toLocalIterator():
        for words, size in _stretches(words_of(r["text"]), block_bytes):
            if block and held + size > block_bytes:
                yield sc.broadcast(Windows.of_words(block))
                block, held = [], 0
            if words:
                block.append((r["item"], words))
                held += size
    if block:
        yield sc.broadcast(Windows.of_words(block))


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with n_words, hit_spans (first and end of each run of hit words) and hit_items (sorted as strings), by these names plus underscores where docs has them; without the text unless keep_text. No shuffle.

    A benchmark of more than block_bytes is searched for block by block: rows with what is found so far are written to the shared folder and read for the next block, so that workers hold one block's table only."""
    n_words, spans, items = fresh(docs, "n_words", "hit_spans", "hit_items")
    out = docs.withColumns({n_words: F.lit(0).cast("long"), spans: F.array().cast("array<int>"), items: F.array().cast("array<string>")})
    whole = out.schema
    spark = docs.sparkSession

    def searched(rows: DataFrame, table_: Broadcast, drop: bool) -> DataFrame:
        schema = StructType([f for f in whole.fields if not (drop and f.name == text_col)])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = table_.value
            for batch in slices(batches):
                at = {n: batch.schema.get_field_index(n) for n in (text_col, n_words, spans, items)}
                counts, all_spans, all_items = [], [], []
                for text, s, i in zip(batch.column(at[text_col]), batch.column(at[spans]).to_pylist(), batch.column(at[items]).to_pylist(), strict=True):
                    n, s2, i2 = windows.search(text.as_py())
                    counts.append(n)
                    all_spans.append(merged(s, s2) if s and s2 else s or s2)
                    all_items.append(sorted({*i, *i2}) if i and i2 else i or i2)
                for name, values in ((n_words, counts), (spans, all_spans), (items, all_items)):
                    batch = batch.set_column(at[name], name, pa.array(values, batch.schema.field(at[name]).type))
                yield batch.select(schema.names)

        return rows.mapInArrow(search, schema)

    tables = blocks(benchmark, block_bytes)
    table_ = next(tables, None) or spark.sparkContext.broadcast(Windows([]))
    path = None
    while (after := next(tables, None)) is not None:
        before, path = path, shared_dir(spark, "searched")
        searched(out, table_, False).write.parquet(path)
        table_.unpersist()
        if before:
            removed(spark, before)
        out, table_ = spark.read.schema(whole).parquet(path), after
    return searched(out, table_, not keep_text)


def clean(docs: DataFrame, benchmark: DataFrame, max_hits: int = 0) -> DataFrame:
    """Rows of docs with at most max_hits hit words; same columns. A null or empty text has none."""
    spans = fresh(docs, "n_words", "hit_spans", "hit_items")[1]
    return hits(docs, benchmark).filter(n_hit(spans) <= max_hits).select(*docs.columns)


def n_hit(spans: str):
    """Sum of end - first: the odd places minus the even ones."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("long")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all windows of all benchmark items.

    Null or empty text: no words, not contaminated. Items without words have no window. Equal windows of several items count for each of them; a repeated row is searched again. An empty benchmark: nothing is hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", n_hit("hit_spans").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("hit_items", ","), "UTF-8"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


#: DuckDB: windows of the items' lengths, joined with all windows of those lengths in the documents.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
