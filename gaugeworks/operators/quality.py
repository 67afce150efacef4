"""Quality control of manifests and sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite

#: Largest plausible speed of a pointer.
MAX_SPEED = 50_000.0


def coverage(manifest: DataFrame, by: str = "attack_type") -> DataFrame:
    """Rows per class; rows without a class are a class of their own."""
    return manifest.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def identity_leaks(manifest: DataFrame, identity: str = "identity", split: str = "split") -> DataFrame:
    """Identities that stand in several splits, and in which; rows without a split don't count."""
    placed = manifest.filter(F.col(split).isNotNull()).select(identity, split).distinct()
    return placed.groupBy(identity).agg(F.count(F.lit(1)).alias("n_splits"), F.array_join(F.sort_array(F.collect_list(split)), ",").alias("splits")).filter("n_splits > 1")


def leaking_split_pairs(manifest: DataFrame, identity: str = "identity", split: str = "split") -> DataFrame:
    """For each pair of splits that share identities: how many, and the least of them."""
    placed = manifest.filter(F.col(split).isNotNull()).select(F.col(identity).alias("identity"), F.col(split).alias("split")).distinct()
    a, b = placed.alias("a"), placed.alias("b")
    both = a.join(b, (F.col("a.identity") == F.col("b.identity")) & (F.col("a.split") < F.col("b.split")))
    return both.groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")).agg(F.count(F.lit(1)).alias("n_shared"), F.min("a.identity").alias("example"))


def index_fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """One row: the number of different ids and sha256 of the sorted ids joined by bars. That hash is sequential: ids are made distinct and sorted by Spark, and one task hashes them as they come, holding a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha256(), 0
        for b in batches:
            for x in b.column(0):
                h.update((b"|" if n else b"") + x.as_py().encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n_ids": pa.array([n], pa.int64()), "fingerprint": pa.array([h.hexdigest()])})

    distinct = ids.select(F.col(column).cast("string").alias("id")).filter("id is not null").distinct()
    return distinct.repartition(1).sortWithinPartitions("id").mapInArrow(run, "n_ids long, fingerprint string")


def session_faults(touch: DataFrame, motion: DataFrame, sessions: DataFrame, min_touch: int = 3, min_motion: int = 3, max_speed: float = MAX_SPEED, us: str | None = None) -> DataFrame:
    """(session, reason) of all sessions; null for good ones. touch: (session, pos, t, x, y), motion: (session, pos, t, ax); us may name a column of touch with whole microseconds, for exact differences.

    Checked in this order: touch count, motion count, first value that isn't finite (touch before motion), first touch step whose time doesn't rise or whose speed is above max_speed."""
    w = Window.partitionBy("session").orderBy("pos")
    dt = F.col("t") - F.lag("t").over(w) if us is None else (F.col(us) - F.lag(us).over(w)).cast("double") / F.lit(1e6)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    bad_value = ~(finite("t") & finite("x") & finite("y"))
    steps = touch.select("session", "pos", bad_value.alias("bad"), dt.alias("dt"), step.alias("step"))
    fault = F.when(F.col("dt") <= 0, F.lit("non_monotonic_time")).when(F.col("step") > F.col("dt") * F.lit(max_speed), F.lit("implausible_speed"))
    touched = steps.groupBy("session").agg(F.count(F.lit(1)).alias("n_touch"), F.max("bad").alias("bad_touch"), F.min_by(fault, F.when(fault.isNotNull(), F.col("pos"))).alias("fault"))
    moved = motion.groupBy("session").agg(F.count(F.lit(1)).alias("n_motion"), F.max(~(finite("t") & finite("ax"))).alias("bad_motion"))
    all_ = sessions.select("session").join(touched, "session", "left").join(moved, "session", "left")
    reason = (
        F.when(F.coalesce("n_touch", F.lit(0)) < min_touch, F.lit("too_few_touch"))
        .when(F.coalesce("n_motion", F.lit(0)) < min_motion, F.lit("too_few_motion"))
        .when(F.col("bad_touch"), F.lit("non_finite_touch"))
        .when(F.col("bad_motion"), F.lit("non_finite_motion"))
        .otherwise(F.col("fault"))
    )
    return all_.select("session", reason.alias("reason"))


def rep_faults(reps: DataFrame, min_touch: int = 8, min_downs: int = 2) -> DataFrame:
    """reps (pointer array<struct<t,x,y>>, downs) with reason: too few touches or keys, a value that isn't finite, a time that doesn't rise."""
    p = F.col("pointer")
    bad = F.exists(p, lambda e: ~(finite(e["t"]) & finite(e["x"]) & finite(e["y"])))
    late = F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(p))), lambda i: (F.size(p) >= 2) & (F.try_element_at(p, i)["t"] <= F.try_element_at(p, i - 1)["t"]))
    return reps.withColumn("reason", F.when(F.size(p) < min_touch, "too_few_touch").when(F.col("downs") < min_downs, "too_few_keys").when(bad, "non_finite_touch").when(late, "non_monotonic_time"))


#: What each type of ledger event must and may have, and of what kind: fixed values of the ledger's format.
LEDGER = (
    *[(t, f, True, k) for t in ("bonafide_dataset_ingested", "real_attack_dataset_ingested") for f, k in (("name", "text"), ("license", "text"), ("source_url", "url"), ("sha256_of_index", "sha256"))],
    ("real_attack_dataset_ingested", "attack_types", True, "list"),
    *[("generator_registered", f, True, k) for f, k in (("name", "text"), ("version", "text"), ("license", "text"), ("commercial_ok", "flag"), ("model_hash", "text"))],
    *[("ontology_citation", f, r, k) for f, r, k in (("attack_type", True, "text"), ("axis", True, "text"), ("paper", True, "text"), ("doi", False, "text"), ("url", False, "url"))],
    *[("dfdc_bonafide_dataset_ingested", f, True, k) for f, k in (("license", "text"), ("source_url", "url"), ("n_chunks", "count"), ("n_videos", "count"), ("n_frames_written", "count"), ("detection_rate", "rate"), ("real_filenames_sha256", "sha256"))],
    *[(t, "ingested_at", False, "time") for t in ("bonafide_dataset_ingested", "real_attack_dataset_ingested", "dfdc_bonafide_dataset_ingested")],
    ("generator_registered", "registered_at", False, "time"),
)


def ledger_faults(events: DataFrame, key: str, rules: Sequence[tuple[str, str, bool, str]] = LEDGER) -> DataFrame:
    """(key, field, fault) of ledger events, one for an event and field: `unknown_type` (field `type`), `missing` (required and null), `unexpected` (not of this type), `wrong_kind` (an empty text, no URL, no digest, a count below 0, a rate outside 0 to 1, an empty list, a text that is no flag or time).

    The wide rows are unpivoted once to their fields that have a value; the rule table, some dozens of rows, is broadcast. A column that events don't have counts as null. Times default when an event is made, so they aren't required."""
    spark = events.sparkSession
    fields = [c for c in events.columns if c not in (key, "type")]
    pairs = [F.struct(F.lit(c).alias("field"), (F.to_json(F.col(c)) if events.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")).alias("text")) for c in fields]
    rows = events.select(F.col(key).alias("_k"), F.col("type").alias("_t"), F.filter(F.array(*pairs), lambda p: p["text"].isNotNull()).alias("_p"))
    rule = F.broadcast(spark.createDataFrame(rules, "_t string, field string, required boolean, kind string"))
    known = F.broadcast(spark.createDataFrame(sorted({(r[0],) for r in rules}), "_t string").withColumn("_known", F.lit(True)))
    typed = rows.join(known, "_t", "left")
    unknown = typed.filter(F.col("_known").isNull()).select("_k", F.lit("type").alias("field"), F.lit("unknown_type").alias("fault"))
    typed = typed.filter("_known")
    have = typed.select("_k", "_t", F.explode("_p").alias("p")).select("_k", "_t", "p.*").join(rule, ["_t", "field"], "left")
    text, number = F.col("text"), F.expr("try_cast(text AS double)")
    good = (
        F.when(F.col("kind") == "url", text.rlike(r"^https?://\S+$"))
        .when(F.col("kind") == "sha256", text.rlike("^[0-9a-f]{64}$"))
        .when(F.col("kind") == "count", F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False)))
        .when(F.col("kind") == "rate", F.coalesce(number.between(0, 1), F.lit(False)))
        .when(F.col("kind") == "flag", text.isin("true", "false"))
        .when(F.col("kind") == "list", F.coalesce(F.json_array_length("text") > 0, F.lit(False)))
        .when(F.col("kind") == "time", F.expr("try_cast(text AS timestamp)").isNotNull())
        .otherwise(text.rlike(r"\S"))
    )
    wrong = have.select("_k", "field", F.when(F.col("kind").isNull(), "unexpected").when(~good, "wrong_kind").alias("fault")).filter(F.col("fault").isNotNull())
    names = F.transform("_p", lambda p: p["field"])
    needed = typed.select("_k", "_t", names.alias("_n")).join(rule.filter("required"), "_t")
    missing = needed.filter(~F.array_contains("_n", F.col("field"))).select("_k", "field", F.lit("missing").alias("fault"))
    return unknown.unionByName(wrong).unionByName(missing).withColumnRenamed("_k", key)
