"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A document is a bag of words, a word's weight its count. Each of K samples draws, for each word, r and c from Gamma(2, 1) and b from (0, 1), all from hashes of the word and the sample's number. With weight s: t = floor(ln s / r + b), ln a = ln c - r (t - b) - r; the sample is (word, t) where a is least. Two bags agree in a sample with a probability equal to their generalised Jaccard similarity, sum of min / sum of max."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sha256_hex, stored, table

SAMPLES = 32
#: Bytes of text in one group of neighbouring documents.
GROUP_BYTES = 2 << 20
#: Ranges of ids that are found from quantiles; beyond, a range is split evenly.
RANGES = 500
#: Groups whose highest ids are looked up by broadcast; more are joined by a shuffle.
GROUPS_BROADCAST = 1_000_000
#: Groups whose order is found together.
STRETCH = 4096
BLANKS = "[ \\t\\n\\x0b\\f\\r]+"


def _uniform(h: Column, field: int) -> Column:
    return (F.shiftrightunsigned(h, 21 * field).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)


def _draws(term: Column, k: int) -> tuple[Column, Column, Column]:
    h, g = F.xxhash64(F.lit(2 * k), term), F.xxhash64(F.lit(2 * k + 1), term)
    r = -F.ln(_uniform(h, 0) * _uniform(h, 1))
    c = F.ln(-F.ln(_uniform(h, 2) * _uniform(g, 0)))
    return r, c, _uniform(g, 1)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """A long whose minimum over a bag's terms is its k-th sample: ln a in the upper 32 bits, a hash of (term, t) in the lower; null where the weight is."""
    r, c, b = _draws(term, k)
    t = F.floor(log_weight / r + b)
    log_a = c - r * (t - b) - r
    return F.shiftleft(F.floor((log_a + 1024) * F.lit(float(1 << 20))), 32).bitwiseOR(F.xxhash64(F.lit(k), term, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(bags: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each weight column, an array of `samples` numbers by the name that it maps to. bags has a row per key and term: keys, term (long), weight columns; a weight of 0 means that the term isn't in that bag.

    All draws of a term serve its bags together. The minima are longs, kept in place by hash aggregation; within a partition that holds a document whole they need no shuffle."""
    logs = {w: f"_log_{w}" for w in weights}
    bags = bags.select(*keys, "term", *[F.when(F.col(w) > 0, F.ln(w)).alias(n) for w, n in logs.items()])
    parts = [F.min(sample(F.col("term"), F.col(n), k)).alias(f"{n}_{k}") for n in logs.values() for k in range(samples)]
    least = bags.groupBy(*keys).agg(*parts)
    return least.select(*keys, *[F.array(*[F.col(f"{n}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples)]).alias(weights[w]) for w, n in logs.items()])


def likeness(a: Column, b: Column) -> Column:
    """Part of the samples that agree: an estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def as_hex(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def terms(text: Column) -> Column:
    """Words of a text, parted by blanks; one empty word if there is none."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), BLANKS, -1)


def grouped_by_id(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with `part`, a number that doesn't fall as doc_id rises, for groups of about group_bytes; and the number of groups. Quantiles of the ids part them, so gaps and dense ranges of ids make no difference up to RANGES groups. Null ids: -1."""
    size = docs.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    n = max(1, math.ceil(size / group_bytes))
    ranges = min(n, RANGES)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges + 1)], 20 * RANGES)).first()[0] or [0, 0]
    cuts = sorted({*cuts})
    inner = cuts[1:-1]
    at = F.size(F.filter(F.array(*[F.lit(c) for c in inner]), lambda c: c < F.col("doc_id"))) if inner else F.lit(0)
    finer = math.ceil(n / ranges)
    if finer > 1:
        low, high = F.array(F.lit(cuts[0] - 1), *[F.lit(c) for c in inner]), F.array(*[F.lit(c) for c in inner], F.lit(cuts[-1]))
        within = (F.col("doc_id") - F.element_at(low, at + 1) - 1) * finer / F.greatest(F.lit(1), F.element_at(high, at + 1) - F.element_at(low, at + 1))
        at = at * finer + F.least(F.lit(finer - 1), F.greatest(F.lit(0), F.floor(within).cast("int")))
    return docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at).cast("long")), len(cuts) * finer


def _lower_parts(tops: DataFrame) -> DataFrame:
    """(part, next_part): the next lower of the groups that there are, after the lowest the highest. Looked up within stretches of STRETCH numbers; only the stretches themselves, a row for 8 GB of text, are put in one order."""
    stretch = F.floor(F.col("part") / STRETCH).alias("_stretch")
    falling = Window.partitionBy("_stretch").orderBy(F.col("part").desc())
    within = tops.select("part", stretch).withColumn("_lower", F.lead("part").over(falling))
    order = Window.orderBy(F.col("_stretch").desc())
    stretches = tops.groupBy(stretch).agg(F.max("part").alias("_top"))
    around = stretches.select("_stretch", F.lead("_top").over(order).alias("_below"), F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_highest"))
    return within.join(around, "_stretch").select("part", F.coalesce("_lower", "_below", "_highest").alias("next_part"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with part, place, next_part, next_place, next_text: the next document by falling doc_id, after the last the first. Rows of one doc_id are ordered by text.

    Documents are dealt by groups of neighbouring ids and looked up there; only each group's last row looks into another group, by a table of one row per group. The text is shuffled once."""
    parted, n = grouped_by_id(docs)
    by_part = Window.partitionBy("part").orderBy(F.col("doc_id").desc(), "text")
    row = parted.repartition(n, "part").select("part", "doc_id", "text", F.row_number().over(by_part).alias("place"), F.lead("text").over(by_part).alias("_lead"), F.lead(F.lit(True)).over(by_part).alias("_more"))
    tops = parted.groupBy("part").agg(F.max("doc_id").alias("top"))
    after = _lower_parts(tops)
    # the first text of each group: of the documents with the highest ids, one per group
    named = tops.withColumnRenamed("part", "_p")
    heads = parted.join(F.broadcast(named) if n <= GROUPS_BROADCAST else named, (F.col("part") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("part").agg(F.min("text").alias("_head"))
    turn = after.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("part", F.col("next_part").alias("_np"), "_head")
    last = F.col("_more").isNull()
    return row.join(turn, "part").select(
        "part", "place", "doc_id", "text",
        F.when(last, F.col("_np")).otherwise(F.col("part")).alias("next_part"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
        F.when(last, F.col("_head")).otherwise(F.col("_lead")).alias("next_text"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, those of their edited texts, and how like they are.

    Null text: empty. Texts without words are alike. Repeated rows are documents of their own; rows of one doc_id follow each other in order of text. A single document is its own next. No documents: no rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n_chars = F.char_length("text")
    edited = with_next(docs).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 3) as int))")))
    about = edited.select("part", "place", "doc_id", n_chars.cast("long").alias("n_chars"), sha256_hex(F.col("edited")).alias("edited_sha256"), "next_part", "next_place")
    both = edited.select("part", "place", F.explode(F.array(F.struct(F.lit(1).alias("own"), F.col("text").alias("t")), F.struct(F.lit(0).alias("own"), F.col("edited").alias("t")))).alias("x"))
    words = both.select("part", "place", F.col("x.own").alias("own"), F.explode(terms(F.col("x.t"))).alias("word"))
    bags = words.select("part", "place", F.xxhash64("word").alias("term"), "own").groupBy("part", "place", "term").agg(F.sum("own").alias("w_text"), F.sum(1 - F.col("own")).alias("w_edited"))
    # both halves come from one shuffle of the text; stored, since the prints are read twice below
    halves = stored(signatures(bags, ["part", "place"], {"w_text": "own_print", "w_edited": "edited_print"}).unionByName(about, allowMissingColumns=True), "prints")
    prints = halves.filter(F.col("own_print").isNotNull()).select("part", "place", "own_print", "edited_print")
    about = halves.filter(F.col("own_print").isNull()).select(*about.columns)
    following = prints.select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("own_print").alias("next_print"))
    out = about.join(prints, ["part", "place"]).join(following, ["next_part", "next_place"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("own_print")).alias("fingerprint"), as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("own_print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("own_print"), F.col("next_print")).alias("near_next"),
    )
