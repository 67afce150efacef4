"""Phrases whose words stand together more often than apart.

1. Sketches: a word's or phrase's hash names a cell; a cell's sum bounds the counts of what falls into it from above. One scan fills the sketches of words and pairs, one more each that of phrases of one word more, whose parts (without the last word, without the first) must pass the sketch before. Tasks send the cells that they touch; each block of cells is summed in one task, row by row; what comes back is one bit a cell, whether its sum reaches the least count.
2. Each task goes through its documents in shards. A shard's phrases in cells that pass are compiled into a pyahocorasick automaton of its own, which then scans the shard and counts all, also overlapping, matches. (Its single words, which are parts of candidates but none themselves, are counted as they are hashed.) A shard is its words with one space between and a lone dot where a piece ends; patterns begin and end with a space, which is the guard: a match begins and ends with a word, and none has a dot, so none crosses a piece. An automaton is bounded by its shard, each document is scanned once however many candidates there are, and nothing is broadcast but the bits.
3. Spark adds up the counts of the shards; thresholds and scores work on the exact sums.

Words and phrases are told apart by hashes of 64 bits within a shard."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, byte_values, mix, slices, stored, table, word_hashes

#: Bytes of text in a shard (a longer text is a shard of its own), and cells that a task gathers before it sends them.
SHARD_BYTES, GATHERED = 8 << 20, 4 << 20
#: A sketch has about a cell for so many bytes of text, within these powers of two. A full sketch lets more pass, never less.
BYTES_A_CELL, LEAST_BITS, MOST_BITS = 8, 16, 28
#: A sketch is summed in so many blocks, as a power of two.
BLOCKS = 9
#: What parts pieces: fixed values.
PARTS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(UPPER.encode() + PARTS, LOWER.encode() + b"." * len(PARTS))
_VALUES = byte_values(False)
_DOT = word_hashes(np.frombuffer(b".", np.uint8), _VALUES)[0][0]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str) -> bytes:
    """Lower-cased words and lone dots where pieces end, one space between all."""
    return b" ".join(text.encode().translate(_TABLE).replace(b".", b" . ").split())


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, its normal texts with dots between) of columns text and language, about SHARD_BYTES at a time."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches):
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            data = normal(text.as_py() or "")
            if data:
                waiting.setdefault(lang.as_py(), []).append(data)
                size += len(data) + 3
            if size >= SHARD_BYTES:
                yield from ((k, b" . ".join(v)) for k, v in waiting.items())
                waiting, size = {}, 0
    yield from ((k, b" . ".join(v)) for k, v in waiting.items())


class Phrases:
    """Hashes of the words and phrases of a normal text, and which places pass the sketches `heavy` of 1, 2, ... words."""

    def __init__(self, lang: str, data: bytes, heavy: list[np.ndarray], bits: int) -> None:
        words, self.start, self.end = word_hashes(np.frombuffer(data, np.uint8), _VALUES)
        seed = word_hashes(np.frombuffer(lang.encode() or b" ", np.uint8), _VALUES, np.zeros(256, bool))[0][0]
        self.bits, self.word = bits, words != _DOT
        self.hashes, self.passing = [mix(words ^ seed)], []
        for known in heavy:
            inside = self.likely()
            at = np.flatnonzero(inside)
            cells = self.cells(at)
            inside[at] = known[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 1
            self.passing.append(inside)

    def likely(self) -> np.ndarray:
        """Whether the phrase of one word more than those that passed may pass too; from here on, hashes[-1] is of these."""
        if not self.passing:
            return self.word.copy()
        return self._longer(self.passing[-1])

    def _longer(self, parts: np.ndarray) -> np.ndarray:
        n, k = max(len(parts) - 1, 0), len(self.hashes)
        self.hashes.append(mix(self.hashes[-1][:n] * _A + self.hashes[0][k:] * _B + np.uint64(k)))
        return parts[:n] & parts[1:]

    def pairs(self) -> np.ndarray:
        """All pairs of neighbouring words, whatever passes."""
        return self._longer(self.word)

    def cells(self, at: np.ndarray) -> np.ndarray:
        return (self.hashes[-1][at] >> np.uint64(64 - self.bits)).astype(np.int64)


def sketches(docs: DataFrame, heavy: list[np.ndarray], bits: int, least: int) -> list[np.ndarray]:
    """heavy, and the next sketch, or the first two: one bit a cell, whether what falls into it has `least` occurrences together. docs: text, language."""
    cap, width = min(least, 65535), max(bits - BLOCKS, 3)
    new = 1 if heavy else 2
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def sent(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(np.concatenate(gathered), return_counts=True)
        counts = np.minimum(counts, cap).astype(np.uint16)
        blocks, edges = np.unique(cells >> width, return_index=True)
        ends = np.append(edges[1:], len(cells))
        steps = np.diff(cells, prepend=0)
        steps[edges] = cells[edges] & (1 << width) - 1
        steps = steps.astype(np.uint32)
        for i in range(0, len(edges), 256):
            some = list(zip(edges[i : i + 256].tolist(), ends[i : i + 256].tolist(), strict=True))
            yield pa.record_batch([pa.array(blocks[i : i + 256].astype(np.int64)), pa.array([steps[a:b].tobytes() for a, b in some], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in some], pa.binary())], names=["block", "steps", "counts"])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for lang, data in by_language(batches):
            phrases = Phrases(lang, data, shared.value, bits)
            for i in range(new):
                at = np.flatnonzero(phrases.pairs() if i else phrases.likely())
                gathered.append((phrases.cells(at) + (i << bits)).astype(np.uint32))
                size += len(at)
            if size >= GATHERED:
                yield from sent(gathered)
                gathered, size = [], 0
        if size:
            yield from sent(gathered)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches, 64):
            for block, steps, counts in zip(*batch.columns, strict=True):
                block = block.as_py()
                if block not in sums:
                    sums[block] = np.zeros(1 << width, np.uint16)
                to, at = sums[block], np.cumsum(np.frombuffer(steps.as_py(), np.uint32), dtype=np.int64)  # a row names a cell once
                to[at] = np.minimum(to[at].astype(np.int64) + np.frombuffer(counts.as_py(), np.uint16), cap)
        for block, to in sums.items():
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([np.packbits(to >= cap, bitorder="little").tobytes()], pa.binary())], names=["block", "full"])

    out, size = np.zeros(new << bits >> 3, np.uint8), 1 << width >> 3
    for r in docs.mapInArrow(touched, "block long, steps binary, counts binary").repartition("block").mapInArrow(summed, "block long, full binary").toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.full, np.uint8)
    return [*heavy, *np.split(out, new)]


def matches(docs: DataFrame, heavy: list[np.ndarray], bits: int) -> DataFrame:
    """(lang, phrase, f) by shard: occurrences of the words and phrases that pass, and of all words together as ''. docs: text, language."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        total: Counter = Counter()
        for lang, data in by_language(batches):
            phrases = Phrases(lang, data, shared.value, bits)
            total[lang] += int(phrases.word.sum())
            begin, end = phrases.start.tolist(), phrases.end.tolist()
            automaton, patterns, some = ahocorasick.Automaton(), [], []
            for k, (passing, hashes) in enumerate(zip(phrases.passing, phrases.hashes, strict=True), 1):
                at = np.flatnonzero(passing)
                _, first, counts = np.unique(hashes[at], return_index=True, return_counts=True)
                if k == 1:
                    some = [(data[begin[i] : end[i]].decode(), f) for i, f in zip(at[first].tolist(), counts.tolist(), strict=True)]
                    continue
                for i in at[first].tolist():
                    phrase = data[begin[i] : end[i + k - 1]].decode()
                    automaton.add_word(f" {phrase} ", len(patterns))
                    patterns.append(phrase)
            del phrases, begin, end
            if patterns:
                automaton.make_automaton()
                found = Counter(map(itemgetter(1), automaton.iter(f" {data.decode()} ")))
                some += [(patterns[x], f) for x, f in found.items()]
            del automaton, patterns
            for i in range(0, len(some), 10_000):
                part = some[i : i + 10_000]
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array([p for p, _ in part], pa.string()), pa.array([f for _, f in part], pa.int64())], names=["lang", "phrase", "f"])
        if total:
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([""] * len(total)), pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "f"])

    return docs.mapInArrow(scanned, "lang string, phrase string, f long")


def counted(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases of up to `longest` words with at least `least` occurrences, and of all words together as ''. docs: text, language."""
    size = docs.agg(F.sum(F.octet_length(docs.columns[0]))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(size / BYTES_A_CELL, 1))), LEAST_BITS), MOST_BITS)
    heavy: list[np.ndarray] = []
    while len(heavy) < longest:
        heavy = sketches(docs, heavy, bits, least)
    return matches(docs, heavy, bits).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def scored(counts: DataFrame, least: int, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers: at least `share` hundredths of their occurrences."""
    counts = counts.withColumn("words", F.split("phrase", " "))
    all_ = counts.where((F.size("words") >= 2) & (F.col("f") >= least)).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = all_.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest")
    )
    part = lambda of, name: counts.select("lang", F.col("phrase").alias(of), F.col("f").alias(name))
    whole: Column = F.expr("cast((1000000BD * cast(a AS decimal(19, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0))) AS long)")
    best = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(whole.alias("score"), "k", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    covered = all_.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words with at least `least` occurrences a, by score, then a, then phrase. The score, in millionths, is that of the phrase's worst cut in two, of l and r occurrences: a * a / (l * r).

    Null texts are empty, null languages `und`; repeated rows count as often as they stand there; other columns are not looked at. The result is stored in the shared folder."""
    docs = docs.select(F.col(text_col), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")))
    scratch = Scratch(docs.sparkSession, "collocations")
    try:
        counts = scratch.stored(counted(docs, least, longest), "counts")
        kept = scored(counts, least, share)
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        salt = F.pmod(F.xxhash64("phrase"), F.lit(64))  # each salt's first `top` hold the language's
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        n = counts.where(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
        return stored(kept.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations-top")
    finally:
        scratch.remove()


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 first phrases of each language of all documents."""
    return mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k))
),
counts AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[:c], ' ') AS p, array_to_string(w[c + 1 :], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scores AS (
    SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = p JOIN counts y ON y.lang = cuts.lang AND y.phrase = q
),
worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
covered AS (
    SELECT lang, part AS phrase, max(a) AS longer
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst LEFT JOIN covered USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""
