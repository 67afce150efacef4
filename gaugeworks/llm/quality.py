"""Quality classifier: supervised subword embeddings.

A document's vector is the average of the learned vectors of its features: each word and the character n-grams of each word. A word that repeats the one before is read as the empty word, which no text has otherwise. Features are hashed to a fixed number of vectors. A softmax layer gives the class. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.

The learned vectors are kept as whole numbers, so that a text's sum is exact: its score is the same wherever the text is cut on the way, and whatever stands beside it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BASE, Scratch, byte_values, fresh, mix, slices, table, with_fields, word_hashes

#: Labelled rows to learn from, and bytes of their features: those with the smallest hashes of doc_id, if there are more.
TRAIN_ROWS, TRAIN_BYTES = 5000, 64 << 20
BUCKETS = 1 << 18
DIM = 8
#: Rows gone through in gradient descent, and rows of a step: fewer rows are gone through more often.
VISITS, BATCH = 30_000, 16
#: Learning rates of the layer and of the vectors. A vector's gradient has the feature's part of a text as a factor, a few thousandths.
RATE, VECTOR_RATE = 0.2, 50.0
NGRAMS = (2, 3, 4)
THRESHOLD = 0.3
#: Bytes of text that are looked at together.
SEGMENT = 1 << 19
VALUES = byte_values(False)
#: Stands for a repeated word.
SAME = np.uint64(0)
#: Of a vector as whole numbers.
SCALE = 1 << 20


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % np.uint64(BUCKETS)).astype(np.int32)


class Words:
    """The words of some pieces of texts: `codes` of the words in order, `text` that each is of; and for each different word the features from `start` on in `ids`. `which` says of which text a piece is, `before` is the (text, hash) of the last word before the pieces."""

    def __init__(self, which: list[int], pieces: list[bytes], before: tuple[int, int] | None = None) -> None:
        data = np.frombuffer(b" ".join(pieces), np.uint8)
        ends = np.cumsum([len(s) + 1 for s in pieces])
        h, s, e = word_hashes(data, VALUES)
        self.text = np.asarray(which, np.int64)[np.searchsorted(ends, s, "right")]
        self.last = before
        if len(h):
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (self.text[1:] == self.text[:-1])
            same[0] = before == (int(self.text[0]), int(h[0]))
            self.last = int(self.text[-1]), int(h[-1])
            h, e = np.where(same, SAME, h), np.where(same, s, e)
        self.codes, unique = pd.factorize(h)
        first = np.zeros(len(unique), np.int64)
        first[self.codes[::-1]] = np.arange(len(h))[::-1]
        self._features(data, unique, s[first], e[first])

    def _features(self, data: np.ndarray, unique: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        size = e - s + 2  # with a mark at either end
        begin = np.concatenate(([0], np.cumsum(size)))
        text = np.zeros(int(begin[-1]), np.uint64)
        inner = np.ones(len(text), bool)
        inner[begin[:-1]] = inner[begin[1:] - 1] = False
        source = np.repeat(s - begin[:-1] - 1, size) + np.arange(len(text))
        text[inner] = VALUES[data[source[inner]]]
        text[begin[:-1]], text[begin[1:] - 1] = 1, 2
        owner = np.repeat(np.arange(len(size)), size)
        left = np.repeat(begin[1:], size) - np.arange(len(text))  # bytes from here to the word's end
        ids, owners = [_buckets(unique.astype(np.uint64))], [np.arange(len(unique))]
        for n in NGRAMS:
            if len(text) < n:
                continue
            h = np.full(len(text) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h + text[j : len(text) - n + 1 + j]) * np.uint64(BASE)
            whole = left[: len(h)] >= n
            ids.append(_buckets(h[whole]))
            owners.append(owner[: len(h)][whole])
        owners_ = np.concatenate(owners)
        order = np.argsort(owners_, kind="stable")
        self.ids = np.concatenate(ids)[order]
        self.count = np.bincount(owners_, minlength=len(unique))
        self.start = np.concatenate(([0], np.cumsum(self.count)))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts as bytes, those above SEGMENT cut at blanks, in groups of about SEGMENT: (which text, bytes)."""
    which, group, held = [], [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while at < len(data) or not at:
            end = len(data)
            if end - at > SEGMENT:
                cut = max(data.rfind(b, at, at + SEGMENT) for b in (b" ", b"\n"))
                end = cut if cut > at else end
            if held + end - at > SEGMENT and group:
                yield which, group
                which, group, held = [], [], 0
            which.append(i)
            group.append(data[at:end])
            held += end - at
            at = max(end, 1)
    if group:
        yield which, group


def _words(texts: list[str | None]) -> Iterator[Words]:
    """The words of the texts, piece by piece; a word that repeats the last of the piece before is known as such."""
    last = None
    for which, group in _pieces(texts):
        w = Words(which, group, last)
        last = w.last
        if len(w.codes):
            yield w


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and how often it has each."""
    ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for w in _words([text]):
        ids.append(w.ids)
        counts.append(np.repeat(np.bincount(w.codes, minlength=len(w.count)), w.count))
    found, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    return found.astype(np.int32), np.bincount(inverse, np.concatenate(counts)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


class Model:
    """vectors: whole numbers, SCALE times the learned ones."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.vectors, self.weights, self.bias = vectors, weights, bias

    def probabilities(self, sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Of label 1, for texts with these sums of vectors and numbers of features."""
        hidden = sums / (np.maximum(totals, 1) * float(SCALE))[:, None]
        return _softmax(hidden @ self.weights + self.bias)[:, 1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        sums, totals = np.zeros((len(texts), DIM), np.int64), np.zeros(len(texts), np.int64)
        for w in _words(texts):
            own = np.add.reduceat(self.vectors[w.ids], w.start[:-1], axis=0, dtype=np.int64)
            edges = np.flatnonzero(np.diff(w.text, prepend=-1))
            at = w.text[edges]  # each text once
            sums[at] += np.add.reduceat(own[w.codes], edges, axis=0)
            totals[at] += np.add.reduceat(w.count[w.codes], edges)
        return np.array([self.probabilities(sums[i : i + 1], totals[i : i + 1])[0] for i in range(len(texts))])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], visits: int = VISITS, rate: float = RATE, vector_rate: float = VECTOR_RATE, batch: int = BATCH, seed: int = 7) -> Model:
    """Stochastic gradient descent on the cross entropy of the averaged model, `batch` rows (features, counts, label) a step, the rates falling to 0. Without rows all scores are 0.5."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    epochs = math.ceil(visits / len(rows)) if rows else 0
    steps, step = max(1, epochs * math.ceil(len(rows) / batch)), 0
    parts = [(n / n.sum()).astype(np.float32) if len(n) else n for _, n, _ in rows]
    labels = np.array([y for *_, y in rows], np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            left, step = np.float32(1 - step / steps), step + 1
            hidden = np.stack([parts[i] @ vectors[rows[i][0]] if len(parts[i]) else np.zeros(DIM, np.float32) for i in at])
            g = _softmax(hidden @ weights + bias)
            g[np.arange(len(at)), labels[at]] -= 1
            back = g @ weights.T * np.float32(vector_rate) * left
            weights -= np.float32(rate) * left * (hidden.T @ g)
            bias -= np.float32(rate) * left * g.sum(axis=0)
            for i, b in zip(at, back, strict=True):
                vectors[rows[i][0]] -= parts[i][:, None] * b
    return Model(np.rint(np.clip(vectors, -1000, 1000) * SCALE).astype(np.int32), weights.astype(float), bias.astype(float))


def in_fold(doc_id: Column, fold: int = 0, folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text is `fold` modulo `folds`; a null id is in none."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Learns from labelled rows outside the held-out fold: at most train_rows, of at most train_bytes of features; a row that would pass the bound is left out.

    The texts are turned into features on the executors, into a table in the shared folder; of that, only the sample's come to the driver. Null labels and ids are left out; a document with several labels counts for each, one with several texts for each, a repeated row once."""
    sample = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).select("doc_id", F.col(label_col).cast("int").alias("y")).distinct()
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                ids, ys, texts = (batch.column(c).slice(i, 64) for c in range(3))
                found = [sparse(t.as_py()) for t in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": ids.cast(pa.int64()), "y": ys, "ids": pa.array([f.tobytes() for f, _ in found], pa.binary()), "counts": pa.array([n.tobytes() for _, n in found], pa.binary())})

    key = ["doc_id", "y", "print"]
    work = Scratch(docs.sparkSession, "features")
    found = work.stored(joined.mapInArrow(run, "doc_id long, y int, ids binary, counts binary"), "rows").withColumn("print", F.xxhash64("ids", "counts"))
    sizes = found.groupBy(*key).agg(F.max(F.octet_length("ids") + F.octet_length("counts")).alias("size"))
    taken, held = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), *key).limit(train_rows).collect():
        if held + r["size"] > train_bytes:  # also a first row: no single text may pass the bound
            continue
        held += r["size"]
        taken.append((r["doc_id"], r["y"], r["print"]))
    if not taken:
        work.remove()
        return train([])
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, y int, print long")
    got = found.join(F.broadcast(chosen), key).groupBy(*key).agg(F.first("ids").alias("ids"), F.first("counts").alias("counts"))
    # sorted by Spark, and read one part after the other, so that the driver holds the rows once
    rows = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32), r["y"]) for r in got.repartitionByRange(16, *key).sortWithinPartitions(*key).toLocalIterator()]
    work.remove()
    return train(rows)


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with the probability of label 1, from the whole text and nothing else; without the text unless keep_text. The model is of a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs, (out_col, "double"))
    if not keep_text:
        schema = StructType([f for f in schema.fields if f.name != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            batch = batch.append_column(out_col, pa.array(shared.value.score(texts.to_pylist()), pa.float64()))
            yield batch if keep_text else batch.select([n for n in batch.schema.names if n != text_col])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score threshold at least; same columns."""
    (score,) = fresh(docs, "score")
    return scored(docs, fit(docs, labels), out_col=score).filter(F.col(score) >= threshold).drop(score)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' quality.

    Null or empty text: the score of no features, the learned bias. Equal texts score alike. Null doc_id: not held out. Without labels: 0.5 for all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), keep_text=False)
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
