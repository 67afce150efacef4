"""Queries of whole runs: sinks, ingests, checks of parameters and ledgers, grids and curves, streams with state. They join those of the catalogue."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import generate, ingest, manifests, quality, sweeps
from ..sources import payloads
from ..sources import proxies as src
from ..sources.shared import shared_folder
from ..streaming import events as streams
from .catalogue import ATTACKS, SQL, eer_sql, query, r6

LANGS = ("de", "en", "es", "fr")


@query("SELECT doc_id, lang, strlen(coalesce(text, ''))::BIGINT AS payload_bytes, sha256(coalesce(text, '')) AS payload_sha256, true AS same FROM documents")
def sink_two_phase(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as payload files with a manifest, in two runs: the first writes every other one, the second finds these there. Read back, each is there once, with its file."""
    root = shared_folder(spark, "payloads")
    rows = src.table(spark, sf, "documents").select("doc_id", "lang", F.concat(F.col("doc_id"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("payload"))
    payloads.append_payloads(rows.filter(F.col("doc_id") % 2 == 0), root, "doc_id")
    found = payloads.with_files(payloads.append_payloads(rows, root, "doc_id"), root)
    return found.select("doc_id", "lang", "payload_bytes", "payload_sha256", ((F.col("payload_sha256") == F.col("file_sha256")) & (F.col("payload_bytes") == F.col("file_bytes"))).alias("same"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, n_chars < 200 AS faulty FROM documents)
SELECT lang, count(*) FILTER (NOT faulty AND place % 3 <> 0)::BIGINT AS written, count(*) FILTER (NOT faulty AND place % 3 = 0)::BIGINT AS known, count(*) FILTER (faulty)::BIGINT AS faulty FROM p GROUP BY lang""")
def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """All documents ingested as pictures of a class each, short ones unfit, after a run that took every third: the second run's counts, from the job that wrote."""
    root = shared_folder(spark, "ingest")
    docs = src.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.encode("text", "UTF-8").alias("payload"))
    plan = ingest.planned(docs, "lang", "doc_id", F.lit("real")).withColumns({"fault": F.when(F.col("n_chars") < 200, "low_variance"), "name": F.concat("sample_id", F.lit(".bin"))})
    about = ("lang", LANGS, "real_attack_dataset_ingested", "docs", "CC0", "http://h", f"{root}/ledger")
    ingest.run(plan.filter(F.col("place") % 3 == 0), root, *about)
    return ingest.run(plan, root, *about)[1]


#: Axes of the events' free parameters: one that holds all values, narrower ones, one that no event has, kinds of values.
EVENT_AXES = {
    "click": {"k": {"type": "uniform", "low": 10, "high": 60}},
    "view": {"k": {"type": "uniform", "low": 0, "high": 100}, "depth": {"type": "uniform", "low": 0, "high": 1}},
    "signup": {"k": {"type": "categorical", "values": list(range(50)), "weights": [1] * 50}},
    "purchase": {"amount": {"type": "uniform", "low": 0, "high": 1}},
    "error": {"k": {"type": "categorical", "values": ["low", "high"], "weights": [1, 1]}},
}


@query("""WITH e AS (SELECT event_id, event_type, (props::JSON->>'$.k')::DOUBLE AS k FROM events)
SELECT event_id, 'k' AS axis, 'outside_range' AS fault FROM e WHERE event_type = 'click' AND NOT k BETWEEN 10 AND 60
UNION ALL SELECT event_id, 'depth', 'missing' FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 'k', 'outside_values' FROM e WHERE event_type = 'signup' AND k NOT BETWEEN 0 AND 49
UNION ALL SELECT event_id, unnest(['amount', 'k']), unnest(['missing', 'extra']) FROM e WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'k', 'outside_values' FROM e WHERE event_type = 'error'""")
def parameter_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Free parameters of all events, as VARIANT, against a catalogue of axes."""
    axes = generate.axes_table(spark, [{"version": "1", "attack_type": kind, "axes": {n: a | {"provenance": {"paper": "given"}} for n, a in given.items()}} for kind, given in EVENT_AXES.items()])
    rows = src.table(spark, sf, "events").select("event_id", "event_type", F.try_parse_json("props").alias("params"))
    return generate.parameter_faults(rows, "event_id", "event_type", "params", axes)


_TYPES = ("bonafide_dataset_ingested", "real_attack_dataset_ingested", "generator_registered", "ontology_citation", "dfdc_bonafide_dataset_ingested", "other")
_FAULTS = (  # types by place, field, fault, condition
    ("0, 1", "name", "missing", "k % 7 = 1"), ("2", "name", "missing", "k % 7 = 1"), ("0, 1, 4", "source_url", "wrong_kind", "k % 7 = 2"), ("0, 1", "sha256_of_index", "wrong_kind", "k % 7 = 3"), ("1", "attack_types", "wrong_kind", "k % 7 = 4"),
    ("2", "version", "wrong_kind", "k % 7 = 5"), ("2", "source_url", "unexpected", "true"), ("2", "sha256_of_index", "unexpected", "true"), ("2", "commercial_ok", "missing", "true"), ("2", "model_hash", "missing", "true"),
    ("3", "name", "unexpected", "k % 7 <> 1"), ("3", "license", "unexpected", "true"), ("3", "source_url", "unexpected", "true"), ("3", "sha256_of_index", "unexpected", "true"), ("3", "attack_type", "missing", "true"), ("3", "axis", "missing", "true"), ("3", "paper", "missing", "true"),
    ("4", "name", "unexpected", "k % 7 <> 1"), ("4", "sha256_of_index", "unexpected", "true"), ("4", "n_chunks", "wrong_kind", "k % 7 = 5"), ("4", "n_videos", "missing", "true"), ("4", "n_frames_written", "missing", "true"), ("4", "detection_rate", "wrong_kind", "k % 7 = 6"),
    ("4", "real_filenames_sha256", "missing", "true"), ("5", "type", "unknown_type", "true"),
)


@query("WITH s AS (SELECT s_suppkey AS k FROM supplier) " + " UNION ALL ".join(f"SELECT k AS event, '{field}' AS field, '{fault}' AS fault FROM s WHERE k % 6 IN ({at}) AND {when}" for at, field, fault, when in _FAULTS))
def ledger_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger events made of all suppliers, each type with faults of all kinds."""
    k, at = F.col("s_suppkey"), F.col("s_suppkey") % 6
    broken = lambda n, bad, good: F.when(k % 7 == n, F.lit(bad)).otherwise(good)
    rows = src.table(spark, sf, "supplier").select(
        k.alias("event"), F.element_at(F.array(*map(F.lit, _TYPES)), (at + 1).cast("int")).alias("type"), F.when(k % 7 != 1, F.col("s_name")).alias("name"), F.lit("CC0").alias("license"),
        broken(2, "ftp", F.concat(F.lit("https://h/"), k)).alias("source_url"), broken(3, "zz", F.sha2(k.cast("string"), 256)).alias("sha256_of_index"),
        F.when(at == 1, F.when(k % 7 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("print")))).alias("attack_types"), F.when(at == 2, broken(5, " ", F.lit("1.0"))).alias("version"),
        F.when(at == 4, broken(5, -1, F.lit(3))).alias("n_chunks"), F.when(at == 4, broken(6, 1.5, F.lit(0.5))).alias("detection_rate"),
    )
    return quality.ledger_faults(rows, "event")


@query("SELECT user_id, event_id, CASE WHEN ts <= max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'non_monotonic_time' END AS fault FROM events")
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a stream in order of their ids, those that go back in time set apart."""
    checked = streams.in_order(streams.event_stream(spark, f"{sf}/events.parquet").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts")
    good, bad = streams.run_to_lanes(checked, shared_folder(spark, "lanes"))
    return good.select("user_id", "event_id", F.lit(None).cast("string").alias("fault")).unionByName(bad.select("user_id", "event_id", "fault"))


CURVE_POOL = """pool AS (SELECT l_orderkey || '-' || l_linenumber AS key, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS attack_type,
  ((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7 + CASE WHEN l_linestatus = 'O' THEN 200 ELSE 0 END) % 1000) / 1000::DOUBLE AS score, l_linenumber || '-' || l_returnflag AS cell FROM lineitem)"""
SIZES = (50, 500, 2000, 5000, 10**12)
NESTED = CURVE_POOL + f""", ranked AS (SELECT *, row_number() OVER (ORDER BY sha256('7|' || key)) AS r FROM pool), sizes AS (SELECT unnest({list(SIZES)}) AS n_real), skips AS (SELECT n_real, n_real > (SELECT count(*) FROM pool) AS skipped FROM sizes),
scored AS (SELECT n_real, label, attack_type, score FROM ranked JOIN skips ON r <= n_real AND NOT skipped),
ap AS (SELECT n_real, max(a) AS apcer FROM (SELECT n_real, avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0 END) AS a FROM scored WHERE label = 1 AND attack_type IS NOT NULL GROUP BY n_real, attack_type) GROUP BY 1),
bp AS (SELECT n_real, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0 END) AS bpcer FROM scored WHERE label = 0 GROUP BY 1)"""


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.table(spark, sf, "lineitem")
    label = (F.col("l_linestatus") == "O").cast("int")
    score = ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 7 + 200 * label) % 1000) / F.lit(1000.0)
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), label.alias("label"), F.when(label == 1, F.col("l_returnflag")).alias("attack_type"), score.alias("score"), F.concat_ws("-", "l_linenumber", "l_returnflag").alias("cell"))


@query(eer_sql("n_real", ctes=NESTED, final="""SELECT s.n_real, s.skipped, CASE WHEN NOT s.skipped THEN round(e.eer, 6) END AS eer, CASE WHEN NOT s.skipped THEN e.threshold END AS threshold, CASE WHEN NOT s.skipped THEN round(coalesce(apcer, 0), 6) END AS apcer, CASE WHEN NOT s.skipped THEN round(coalesce(bpcer, 0), 6) END AS bpcer,
  CASE WHEN NOT s.skipped THEN round((coalesce(apcer, 0) + coalesce(bpcer, 0)) / 2, 6) END AS acer FROM skips s LEFT JOIN e ON e.n_real = s.n_real LEFT JOIN ap ON ap.n_real = s.n_real LEFT JOIN bp ON bp.n_real = s.n_real"""))
def curve_nested(spark: SparkSession, sf: str) -> DataFrame:
    """A curve over nested subsets of all line items, from one pass; sizes beyond the pool are skipped."""
    return r6(sweeps.nested_curve(_pool(spark, sf), "key", SIZES, 7), "eer", "apcer", "bpcer", "acer")


@query(eer_sql("cell", rows="pool", ctes=CURVE_POOL))
def sweep_grid_run(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of all line items in two runs over one folder: the first is stopped halfway, the second goes on."""
    rows, root = _pool(spark, sf), shared_folder(spark, "grid")
    grid = rows.select("cell").distinct()
    sweeps.run_grid(rows, grid.filter(F.crc32(F.col("cell").cast("binary")) % 2 == 0), root, ["cell"])
    return r6(sweeps.run_grid(rows, grid, root, ["cell"]).select("cell", "eer", "threshold"), "eer")


@query(SQL["key_down_up_pairs"])
def table_function_key_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """key_down_up_pairs by the table function, from SQL."""
    tables.register(spark)
    return spark.sql("SELECT session, code, down_t, up_t FROM key_pairs(TABLE({events}))", events=src.keys(spark, sf).withColumnRenamed("us", "t"))


@query(SQL["work_items"])
def table_function_work_items(spark: SparkSession, sf: str) -> DataFrame:
    """work_items by the table function, from SQL."""
    tables.register(spark)
    placed = manifests.placed(src.table(spark, sf, "supplier"), "s_name", "s_suppkey")
    return spark.sql("SELECT * FROM work_items(TABLE({placed}), 5, 'face', {attacks}, 11)", placed=placed, attacks=json.dumps(dict(ATTACKS)))
