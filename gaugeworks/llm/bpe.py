"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash finds pre-tokens that are in the vocabulary as a whole; the others are merged by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from .common import fresh, slices, table, with_fields

#: Pre-tokens whose ids a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 300_000
#: Longer pre-tokens aren't remembered.
LONG = 64


class PerfectHash:
    """Minimal perfect hash of a set of keys by displacement: a key's first hash gives a bucket, the bucket's displacement d the slot (a + d * b) mod n of each of its keys. Buckets are placed from the fullest down. Slots hold the keys, so that others are told apart."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.n_buckets = max(1, n // 2)  # two keys each: an eighth of the keys is alone in a bucket and fits any slot that is left
        seed = 0
        while not self._place(keys, seed):
            seed += 1
        self.seed = seed

    def _place(self, keys: list[bytes], seed: int) -> bool:
        n = self.n
        hashes = [self._parts(k, seed) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, (g, _, _) in enumerate(hashes):
            buckets.setdefault(g, []).append(i)
        self.displacement = np.zeros(self.n_buckets, np.int64)
        slots: list[int] = [-1] * n
        taken = bytearray(n)
        free = 0
        for g, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # any free slot will do
                while taken[free]:
                    free += 1
                self.displacement[g] = -free - 1
                taken[free] = 1
                slots[free] = members[0]
                continue
            for d in range(1 << 20):
                at = [(hashes[i][1] + d * hashes[i][2]) % n for i in members]
                if len({*at}) == len(at) and not any(taken[x] for x in at):
                    break
            else:
                return False
            self.displacement[g] = d
            for x, i in zip(at, members, strict=True):
                taken[x] = 1
                slots[x] = i
        self.keys = [keys[i] for i in slots]
        self.index = slots
        self.displacement = self.displacement.tolist()
        return True

    def _parts(self, key: bytes, seed: int) -> tuple[int, int, int]:
        h = xxh3_64_intdigest(key, seed)
        return (h & 0xFFFFF) % self.n_buckets, (h >> 20) & 0x3FFFFF, ((h >> 42) % (self.n - 1) + 1) if self.n > 1 else 1

    def get(self, key: bytes) -> int:
        """Position of key in the list given, or -1."""
        if not self.n:
            return -1
        g, a, b = self._parts(key, self.seed)
        d = self.displacement[g]
        slot = -d - 1 if d < 0 else (a + d * b) % self.n
        return self.index[slot] if self.keys[slot] == key else -1


class Bpe:
    """A vocabulary of byte strings with ranks, which are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        known = list(ranks)
        self.ids = [ranks[t] for t in known]
        self.whole = PerfectHash(known)
        self.ranks = ranks

    @staticmethod
    def load(path: str, pattern: str) -> Bpe:
        """The vocabulary of a file. It is built anew each time, in half a second, so that the driver holds none between."""
        with open(path, "rb") as f:
            return Bpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        i = self.whole.get(piece)
        return (self.ids[i],) if i >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The pair of neighbours with the lowest rank is joined first, of equal ranks the leftmost: a heap of (rank, place) over a linked list of parts. Entries whose parts have changed since are skipped."""
        ranks, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if mid == 0 or mid >= n or end[mid] != stop:  # a part is gone, or has grown
                continue
            end[i] = stop
            end[mid] = 0
            if stop < n:
                before[stop] = i
                if (r := ranks(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks(piece[j:stop])) is not None:
                heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encoder(self):
        """A function from text to an array of ids; it remembers common pre-tokens."""
        import regex

        find = regex.compile(self.pattern).findall
        encode = self.encode_piece

        class Known(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = encode(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= LONG:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[piece] = ids
                return ids

        known = Known()
        return lambda text: array("I", chain.from_iterable(map(known.__getitem__, find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def packed(ids: array) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, np.uint32).astype("<u4", copy=False).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def _worker_state(broadcast, made: dict = {}):  # noqa: B006 the dict is the worker's memory between tasks
    bpe = broadcast.value
    if made.get("of") is not bpe:
        made |= {"of": bpe, "encode": bpe.encoder()}
    return bpe, made["encode"]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the ids of each whole text as packed bytes (4 a token). Null: no ids. The vocabulary is read on the driver and broadcast (its size is fixed)."""
    shared = docs.sparkSession.sparkContext.broadcast(Bpe.load(vocabulary, pattern))
    schema = with_fields(docs, (out_col, "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, enc = _worker_state(shared)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids = [packed(enc(x.as_py() or "")) for x in texts]
            yield batch.append_column(out_col, pa.array(ids, pa.binary()))

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(Bpe.load(vocabulary, pattern))
    schema = with_fields(encoded, (out_col, "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index(ids_col))
            yield batch.append_column(out_col, pa.array([bpe.decode(unpacked(x.as_py() or b"").tolist()) for x in ids], pa.binary()))

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs, without the text unless keep_text, with n_tokens, ids_sha256 and decoded_sha256 (by these names plus underscores where docs has them), and the packed ids if ids_col names a column for them. The text is encoded and decoded again in one step, so that bytes needn't travel."""
    shared = docs.sparkSession.sparkContext.broadcast(Bpe.load(vocabulary, pattern))
    names = fresh(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    schema = with_fields(docs, *zip(names, ("long", "string", "string"), strict=True), *([(ids_col, "binary")] if ids_col else []))
    if not keep_text:
        schema = StructType([f for f in schema.fields if f.name != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, enc = _worker_state(shared)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            counts, hashes, back, all_ids = [], [], [], []
            for x in texts:
                ids = enc(x.as_py() or "")
                data = packed(ids)
                counts.append(len(ids))
                if ids_col:
                    all_ids.append(data)
                hashes.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            for name, values, kind in zip(names, (counts, hashes, back), (pa.int64(), pa.string(), pa.string()), strict=True):
                batch = batch.append_column(name, pa.array(values, kind))
            if ids_col:
                batch = batch.append_column(ids_col, pa.array(all_ids, pa.binary()))
            yield batch.select(schema.names)

    return docs.mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the 50k vocabulary and decoded again.

    Null text counts as empty: 0 tokens, digests of nothing. Texts of any length are encoded whole."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)
