"""Periodic runs of words: stretches that repeat with a short period.

All documents of a batch are one sequence of numbers, in which no two documents share a symbol.

1. Prefix doubling ranks all factors of 1, 2, 4, ... words; the last ranks are the suffix array. The ranks of all lengths give the longest common extension of any two places, to the right and to the left, in as many steps as there are lengths: the LCP.
2. The longest previous factor of each place (LPF) is the larger of its LCPs with its neighbours in the suffix array among the places before it, which are found by deleting places from a linked list, from the last one down.
3. The LPF array gives the LZ blocks: from a block's start, the longest factor seen before, or one new word.
4. Main: a run that touches the border between two blocks, of lengths u and v, and repeats its period p three times has p <= (u + v) / 2, as otherwise the earlier block would have gone on. For each border and such p, extensions in both directions from places p apart, one pair on each side of the border, give the maximal stretch with period p. The number of these pairs is linear in the words.
5. A run strictly inside a block lies in the block's earlier copy too, and is copied from there; runs are kept in buckets by start for this."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import fresh, slices, table, with_fields

#: Words that are worked on together; a longer text is a batch of its own.
BATCH_WORDS = 400_000


class Factors:
    """Ranks of the factors of 2**k symbols for each k, as far as any factor occurs twice: equal factors have equal ranks, and ranks sort as factors do."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        _, first, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - counts)[first].astype(np.int32)
        self.levels = [rank]
        order = np.argsort(rank, kind="stable")
        h, group = 1, rank[order]
        while True:
            same = np.empty(n, bool)
            same[:1] = False
            same[1:] = group[1:] == group[:-1]
            open_ = same.copy()
            open_[:-1] |= same[1:]
            at = np.flatnonzero(open_)  # places in the order whose suffix isn't alone in its group
            if not len(at):
                break
            suffix = order[at]
            then = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)].astype(np.int64) + 1, 0)
            key = group[at].astype(np.int64) * (n + 1) + then
            by = np.argsort(key, kind="stable")
            order[at] = suffix[by]
            key = key[by]
            starts = np.empty(len(at), bool)
            starts[:1] = True
            starts[1:] = key[1:] != key[:-1]
            group[at] = np.maximum.accumulate(np.where(starts, at, 0))
            rank = rank.copy()
            rank[order[at]] = group[at]
            self.levels.append(rank)
            h *= 2
        self.order = order
        self.n = n

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that begins at a and at b. It's shorter than the longest length ranked, so one step of each length below that covers it."""
        a, b = a.copy(), b.copy()
        begin, n = a.copy(), self.n
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            inside = np.maximum(a, b) + (1 << k) <= n
            ok = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            a += ok * (1 << k)
            b += ok * (1 << k)
        return a - begin

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends at a and at b (-1: none)."""
        a, b = a.copy(), b.copy()
        begin = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            ok = (np.minimum(a, b) + 1 >= step) & (rank[np.maximum(a + 1 - step, 0)] == rank[np.maximum(b + 1 - step, 0)])
            a -= ok * step
            b -= ok * step
        return begin - a


def longest_previous(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, a previous place with that factor, -1 where there is none)."""
    n = factors.n
    neighbours = np.full((2, n + 1), n, np.int64)  # of each place in the order; n: none
    neighbours[0, factors.order[1:]], neighbours[1, factors.order[:-1]] = factors.order[:-1], factors.order[1:]
    left, right = neighbours.tolist()
    for s in range(n - 1, -1, -1):  # all later places are gone from the list; what is left of this one's entries is what it had then
        b, a = left[s], right[s]
        right[b] = a
        left[a] = b
    here = np.arange(n)
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for side in (np.array(left[:n], np.int64), np.array(right[:n], np.int64)):
        have = np.flatnonzero(side < n)
        length = factors.ahead(side[have], here[have])
        better = length > best[have]
        best[have[better]], source[have[better]] = length[better], side[have[better]]
    return best, source


def blocks(lpf: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks."""
    steps, out, i, n = np.maximum(lpf, 1).tolist(), [], 0, len(lpf)
    while i < n:
        out.append(i)
        i += steps[i]
    return np.array(out, np.int64)


def runs(symbols: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches with smallest period p and length >= max(least, times * p), by start and period. times must be 3 or more."""
    n = len(symbols)
    if n < max(least, times):
        return []
    factors = Factors(symbols)
    lpf, source = longest_previous(factors)
    start = blocks(lpf)
    size = np.diff(start, append=n)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> period
    for i, j, p in zip(*_at_borders(factors, start, size, least, times), strict=True):
        if p < found.get((i, j), n + 1):
            found[i, j] = p
    starts: dict[int, list[tuple[int, int]]] = {}
    for (i, j), p in found.items():
        starts.setdefault(i, []).append((j, p))
    ends = sorted(starts)
    for b, m in zip(start.tolist(), size.tolist(), strict=True):
        if m < least + 2:
            continue
        shift = b - int(source[b])
        at = bisect_left(ends, b - shift + 1)
        while at < len(ends) and (i := ends[at] + shift) < b + m - least:
            for j, p in starts[i - shift]:
                if j + shift < b + m and (i, j + shift) not in found:  # ends before the block's last word
                    found[i, j + shift] = p
                    if i not in starts:
                        starts[i] = []
                        insort(ends, i)
                    starts[i].append((j + shift, p))
            at += 1
    return sorted((i, j - i, p) for (i, j), p in found.items())


def _at_borders(factors: Factors, start: np.ndarray, size: np.ndarray, least: int, times: int) -> tuple[list, list, list]:
    """(start, end, period) of the stretches that touch a border of blocks; a period may be a multiple of the smallest one. The end of the sequence counts as a border."""
    n = factors.n
    border = np.append(start[1:], n)
    most = (size + np.append(size[1:], 0)) // 2
    # a run's words after its first period occurred before, so a block that begins there ends with the run or later: two blocks cover them
    use = most * 2 >= least - least // times
    border, most = border[use], np.minimum(most[use], n // times)
    out: tuple[list, list, list] = ([], [], [])
    total = np.cumsum(most)
    for part in np.split(np.arange(len(border)), np.flatnonzero(np.diff(total // BATCH_WORDS)) + 1):
        if not len(part):
            continue
        b = np.repeat(border[part], most[part])
        p = np.arange(len(b)) - np.repeat(np.cumsum(most[part]) - most[part], most[part]) + 1
        for a, c in ((b, b + p), (b - p, b)):  # the pair on the right of the border, and that on the left
            ok = (a >= 0) & (c <= n)
            aa, cc, pp = a[ok], c[ok], p[ok]
            g = factors.back(aa - 1, cc - 1)
            f = factors.ahead(aa, cc)
            length = f + g + pp
            hit = length >= np.maximum(least, times * pp)
            for to, x in zip(out, (aa - g, cc + f, pp), strict=True):
                to.extend(x[hit].tolist())
    return out


def looped(n: int, doc_id: int) -> np.ndarray | None:
    """Of a tenth of the documents (by crc32 of doc_id), the end is replaced by a loop of its own words: the places of their n words. None for the others."""
    h = crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def found_in(docs: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """runs() of each list of words, all worked on at once."""
    numbers, total = [], 0
    for words in docs:
        known = {w: i for i, w in enumerate(dict.fromkeys(words), total)}
        numbers.append(np.array(list(map(known.__getitem__, words)), np.int64))
        total += len(known)
    begin = np.cumsum([0, *map(len, docs)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for start, length, period in runs(np.concatenate(numbers) if numbers else np.empty(0, np.int64), least, times):
        d = int(np.searchsorted(begin, start, side="right")) - 1
        out[d].append((start - int(begin[d]), length, period))
    return out


def described(words: list[bytes], all_runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run of the greatest exponent, and digests of all runs and of the words less each run's repeats."""
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in all_runs:
        keep[start + period : start + length] = bytes(length - period)
    best: tuple = (None, None, None, None)
    if all_runs:
        start, length, period = max(all_runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in all_runs)
    return len(all_runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(compress(words, keep))).hexdigest()


#: Columns that detect() adds, and their types.
ADDED = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def detect(docs: DataFrame, text_col: str = "text", id_col: str | None = None, change: Callable[[int, int], np.ndarray | None] | None = None, least: int = 24, times: int = 3, keep_text: bool = True) -> DataFrame:
    """docs, without the text unless keep_text, with the columns of ADDED (by these names plus underscores where docs has them).

    Words are what lies between space and \\t to \\r; a null or empty text has none, no runs, and nulls for the best one. `change(n, id)` gives the places of the words to look at instead of 0 to n - 1, or None for these; without an id nothing is changed. Texts are whole and stay in their task; a batch's arrays take about 4 bytes a word for each doubling up to its longest repeat, and some 100 besides."""
    names = fresh(docs, *ADDED)
    out_docs = docs if keep_text else docs.drop(text_col)
    schema = with_fields(out_docs, *zip(names, ADDED.values(), strict=True))

    def rows(batch: pa.RecordBatch, at: int, docs: list[list[bytes]]) -> pa.RecordBatch:
        part = batch.slice(at, len(docs))
        found = [described(w, r) for w, r in zip(docs, found_in(docs, least, times), strict=True)]
        for i, (name, kind) in enumerate(zip(names, ADDED.values(), strict=True)):
            part = part.append_column(name, pa.array([f[i] for f in found], pa.int64() if kind == "long" else pa.string()))
        return part.select(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids = batch.column(batch.schema.get_field_index(id_col)) if id_col else None
            waiting: list[list[bytes]] = []
            size = begin = 0
            for i, x in enumerate(texts):
                words = (x.as_py() or "").encode().split()
                key = ids[i].as_py() if ids is not None else None
                if change is not None and key is not None and (places := change(len(words), key)) is not None:
                    words = [words[k] for k in places.tolist()]
                if waiting and size + len(words) > BATCH_WORDS:
                    yield rows(batch, begin, waiting)
                    waiting, size, begin = [], 0, i
                waiting.append(words)
                size += len(words)
            if waiting:
                yield rows(batch, begin, waiting)

    return docs.mapInArrow(run, schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods in all documents, a tenth of which loops (see looped()). Null text: no words, no runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, id_col="doc_id", change=looped, keep_text=False)
