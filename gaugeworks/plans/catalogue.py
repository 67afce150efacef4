"""The evaluation engine's queries over the given tables, and for each the same in DuckDB's SQL. Floats are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..functions import scalars as fn
from ..functions.frames import dealt
from ..operators import evaluation, features, generate, ingest, manifests, metrics, profiles, quality, reps, splits, sweeps
from ..sources import files
from ..sources import proxies as src
from ..sources.shared import kept, shared_folder
from ..streaming import enrolment
from ..streaming import events as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Six places, as DuckDB's round() has them: the number times a million is rounded, not its decimal text, so a mean that falls between two places goes the same way."""
    return df.withColumns({n: F.round(F.col(n) * F.lit(1e6)) / F.lit(1e6) for n in names})


# --- views of the tables, as src has them ---

SCORED = """scored AS (SELECT l_orderkey AS unit, l_suppkey AS subject, label, CASE WHEN label = 1 THEN l_returnflag END AS attack_type, l_returnflag, l_shipdate,
  ((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7 + 200 * label) % 1000) / 1000::DOUBLE AS score
  FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label FROM lineitem))"""
MANIFEST = """manifest AS (SELECT d.doc_id AS sample_id, CASE WHEN toxic = 1 THEN 'attack' ELSE 'bonafide' END AS label, CASE WHEN toxic = 1 THEN lang END AS attack_type, source AS identity,
  CASE WHEN d.doc_id % 50 = 49 THEN NULL WHEN (d.doc_id * 7 + d.doc_id // 20) % 10 < 7 THEN 'train' WHEN (d.doc_id * 7 + d.doc_id // 20) % 10 < 9 THEN 'dev' ELSE 'test' END AS split, lang
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
EVENTS = """ev AS (SELECT user_id AS session, event_id AS pos, epoch_us(ts) AS us, event_type, value AS x, (props::JSON->>'$.k')::DOUBLE AS y FROM events),
touch AS (SELECT * FROM ev WHERE event_type = 'click'),
keyev AS (SELECT session, pos, us, CASE WHEN event_type = 'signup' THEN 'down' ELSE 'up' END AS phase, floor(y / 25)::INT AS code FROM ev WHERE event_type IN ('signup', 'purchase')),
motion AS (SELECT session, pos, us, x AS ax, y / 10 AS ay, 1.0::DOUBLE AS az FROM ev WHERE event_type IN ('view', 'error'))"""
STEPS = (
    EVENTS
    + """,
d0 AS (SELECT session, pos, row_number() OVER w - 1 AS step, (us - lag(us) OVER w) / 1e6::DOUBLE AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM touch WINDOW w AS (PARTITION BY session ORDER BY pos)),
d1 AS (SELECT session, pos, step, dt, sqrt(dx * dx + dy * dy) / greatest(dt, 0.001::DOUBLE) AS speed, atan2(dy, dx) AS angle FROM d0 WHERE step > 0),
steps AS (SELECT session, pos, step, dt, speed, abs(angle - lag(angle) OVER w) AS turn, speed - lag(speed) OVER w AS jerk FROM d1 WINDOW w AS (PARTITION BY session ORDER BY pos))"""
)
KEYS = (
    EVENTS
    + """,
k0 AS (SELECT session, phase, us, row_number() OVER (PARTITION BY session, phase ORDER BY pos) AS i FROM keyev),
k1 AS (SELECT d.session, d.i, d.us AS down, u.us AS up FROM k0 d JOIN k0 u ON d.session = u.session AND d.i = u.i AND d.phase = 'down' AND u.phase = 'up'),
keytimes AS (SELECT session, i, (up - down) / 1e6::DOUBLE AS dwell, (lead(down) OVER (PARTITION BY session ORDER BY i) - up) / 1e6::DOUBLE AS flight FROM k1)"""
)
SPEC = "scored"


def rates_sql(by: str = "", rows: str = "scored", ctes: str = SCORED) -> str:
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    before = f"OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {ctes},
c AS (SELECT {keys}score, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM {rows} GROUP BY {keys}score),
r AS (SELECT {keys}score, (sum(n0) OVER ({part}) - coalesce(sum(n0) {before}, 0))::DOUBLE / greatest(sum(n0) OVER ({part}), 1)::DOUBLE AS fpr,
  coalesce(sum(n1) {before}, 0)::DOUBLE / greatest(sum(n1) OVER ({part}), 1)::DOUBLE AS fnr FROM c)"""


def eer_sql(by: str = "", rows: str = "scored", ctes: str = SCORED, final: str | None = None) -> str:
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    found = f"""{rates_sql(by, rows, ctes)},
e AS (SELECT {keys}CASE WHEN abs(fpr - fnr) < 1 THEN (fpr + fnr) / 2 ELSE 0.5 END AS eer, CASE WHEN abs(fpr - fnr) < 1 THEN score END AS threshold
  FROM (SELECT *, row_number() OVER ({part} ORDER BY abs(fpr - fnr), score) AS k FROM r) WHERE k = 1)"""
    return f"{found}\n{final}" if final else f"{found}\nSELECT {keys}round(eer, 6) AS eer, round(threshold, 6) AS threshold FROM e"


# --- error rates ---


@query(eer_sql())
def eer_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.eer(src.scored(spark, sf)), "eer", "threshold")


@query(eer_sql("subject"))
def eer_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.eer(src.scored(spark, sf), ["subject"]), "eer", "threshold")


BY_SPECIES = SCORED + """,
sp AS (SELECT DISTINCT attack_type AS species FROM scored WHERE label = 1 AND attack_type IS NOT NULL),
per AS (SELECT species, label, score FROM scored, sp WHERE label = 0 UNION ALL SELECT attack_type, label, score FROM scored WHERE label = 1 AND attack_type IS NOT NULL)"""


@query(eer_sql("species", "per", BY_SPECIES))
def eer_by_species(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.eer(metrics.each_species_with_bona_fide(src.scored(spark, sf)), ["species"], "weight"), "eer", "threshold")


@query(eer_sql("subject, seed", "s3", SCORED + ", s3 AS (SELECT *, unit % 3 AS seed FROM scored)", "SELECT subject, round(avg(eer), 6) AS eer_mean, round(stddev_pop(eer), 6) AS eer_std, count(*)::BIGINT AS n_seeds FROM e GROUP BY subject"))
def eer_over_seeds(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.eer(src.scored(spark, sf).withColumn("seed", F.col("unit") % 3), ["subject", "seed"])
    return r6(metrics.eer_over_seeds(found, ["subject"]), "eer_mean", "eer_std")


SPECIES_SEEDS = SCORED + """,
s3 AS (SELECT *, unit % 3 AS seed FROM scored),
sp AS (SELECT DISTINCT seed, attack_type AS species FROM s3 WHERE label = 1 AND attack_type IS NOT NULL),
per AS (SELECT species, s3.seed, label, score FROM s3 JOIN sp ON s3.seed = sp.seed WHERE label = 0 UNION ALL SELECT attack_type, seed, label, score FROM s3 WHERE label = 1 AND attack_type IS NOT NULL)"""


@query(eer_sql("species, seed", "per", SPECIES_SEEDS, "SELECT species, round(avg(eer), 6) AS eer_mean, round(stddev_pop(eer), 6) AS eer_std, count(*)::BIGINT AS n_seeds FROM e GROUP BY species"))
def eer_by_species_over_seeds(spark: SparkSession, sf: str) -> DataFrame:
    scored = src.scored(spark, sf).withColumn("seed", F.col("unit") % 3)
    found = metrics.eer(metrics.each_species_with_bona_fide(scored, ["seed"]), ["species", "seed"], "weight")
    return r6(metrics.eer_over_seeds(found, ["species"]), "eer_mean", "eer_std")


@query(rates_sql() + "\nSELECT round(score, 6) AS score, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM r")
def score_cdf_fpr_fnr(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.rates(src.scored(spark, sf)), "score", "fpr", "fnr")


@query(f"WITH {SCORED} SELECT attack_type, count(*)::BIGINT AS n, round(avg(CASE WHEN score < 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS apcer FROM scored WHERE label = 1 AND attack_type IS NOT NULL GROUP BY 1")
def apcer_by_species(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.apcer_by_species(src.scored(spark, sf), 0.5), "apcer")


def error_rates_sql(by: str, threshold: str = "0.5", ctes: str = SCORED, rows: str = "scored") -> str:
    keys, join = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""WITH {ctes},
a AS (SELECT {keys}max(p) AS apcer FROM (SELECT {keys}attack_type, avg(CASE WHEN score < {threshold} THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM {rows} WHERE label = 1 AND attack_type IS NOT NULL GROUP BY {keys}attack_type) {f"GROUP BY {by}" if by else ""}),
b AS (SELECT {keys}avg(CASE WHEN label = 0 THEN CASE WHEN score >= {threshold} THEN 1.0::DOUBLE ELSE 0.0 END END) AS bpcer FROM {rows} {f"GROUP BY {by}" if by else ""})
SELECT {keys}round(coalesce(apcer, 0), 6) AS apcer, round(coalesce(bpcer, 0), 6) AS bpcer, round((coalesce(apcer, 0) + coalesce(bpcer, 0)) / 2, 6) AS acer FROM b LEFT JOIN a {join}"""


@query(error_rates_sql("subject"))
def apcer_bpcer_acer_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.error_rates(src.scored(spark, sf), 0.5, ["subject"]), "apcer", "bpcer", "acer")


@query(error_rates_sql(""))
def apcer_bpcer_acer_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.error_rates(src.scored(spark, sf), 0.5), "apcer", "bpcer", "acer")


THRESHOLD = """cand AS (SELECT {keys}score FROM scored UNION SELECT {keys}min(score) - 1 FROM scored {group} UNION SELECT {keys}max(score) + 1 FROM scored {group}),
att AS (SELECT {keys}attack_type, score, count(*) AS n FROM scored WHERE label = 1 AND attack_type IS NOT NULL GROUP BY ALL),
tot AS (SELECT {keys}attack_type, sum(n) AS total FROM att GROUP BY ALL),
grid AS (SELECT {ckeys}c.score, t.attack_type, t.total, coalesce(a.n, 0) AS n FROM cand c JOIN tot t {on} LEFT JOIN att a ON a.score = c.score AND a.attack_type = t.attack_type {and_}),
cum AS (SELECT {keys}score, coalesce(sum(n) OVER (PARTITION BY {keys}attack_type ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / total::DOUBLE AS p FROM grid),
worst AS (SELECT {ckeys}c.score, coalesce(max(p), 0) AS apcer FROM cand c LEFT JOIN cum ON cum.score = c.score {cumon} GROUP BY {ckeys}c.score),
thr AS (SELECT {keys}max(score) AS threshold, arg_max(apcer, score) AS apcer FROM worst WHERE apcer <= 0.05 {group})"""


def threshold_ctes(by: str = "") -> str:
    if not by:
        return THRESHOLD.format(keys="", ckeys="", group="", on="ON true", and_="", cumon="")
    return THRESHOLD.format(keys=f"{by}, ", ckeys=f"c.{by}, ", group=f"GROUP BY {by}", on=f"ON c.{by} = t.{by}", and_=f"AND a.{by} = c.{by}", cumon=f"AND cum.{by} = c.{by}")


@query(f"WITH {SCORED}, {threshold_ctes()} SELECT round(threshold, 6) AS threshold, round(apcer, 6) AS apcer FROM thr")
def threshold_at_apcer(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.threshold_at_apcer(src.scored(spark, sf), 0.05), "threshold", "apcer")


@query(f"WITH {SCORED}, {threshold_ctes('subject')} SELECT subject, round(threshold, 6) AS threshold, round(apcer, 6) AS apcer FROM thr")
def threshold_at_apcer_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.threshold_at_apcer(src.scored(spark, sf), 0.05, ["subject"]), "threshold", "apcer")


DEV = SCORED.replace("scored AS", "every AS") + ", scored AS (SELECT * FROM every WHERE l_shipdate < TIMESTAMP '1996-01-01'), " + threshold_ctes("subject")


@query(
    "WITH " + DEV + """, x AS (SELECT e.*, threshold FROM (SELECT * FROM every WHERE l_shipdate >= TIMESTAMP '1996-01-01') e LEFT JOIN thr USING (subject)),
a AS (SELECT subject, max(p) AS apcer FROM (SELECT subject, attack_type, avg(CASE WHEN score < threshold THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM x WHERE label = 1 AND attack_type IS NOT NULL AND threshold IS NOT NULL GROUP BY ALL) GROUP BY subject),
b AS (SELECT subject, avg(CASE WHEN label = 0 THEN CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0.0 END END) AS bpcer, any_value(threshold) AS threshold FROM x GROUP BY subject)
SELECT subject, CASE WHEN threshold IS NOT NULL THEN round(coalesce(apcer, 0), 6) END AS apcer, CASE WHEN threshold IS NOT NULL THEN round(coalesce(bpcer, 0), 6) END AS bpcer, CASE WHEN threshold IS NOT NULL THEN round((coalesce(apcer, 0) + coalesce(bpcer, 0)) / 2, 6) END AS acer
FROM b LEFT JOIN a USING (subject)"""
)
def dev_threshold_cross_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds fixed on the rows before 1996, rates of those since."""
    every = src.scored(spark, sf)
    since = F.col("l_shipdate") >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")).cast(every.schema["l_shipdate"].dataType)
    fixed = metrics.threshold_at_apcer(every.filter(~since), 0.05, ["subject"])
    return r6(metrics.rates_at(every.filter(since), fixed, ["subject"]), "apcer", "bpcer", "acer")


@query(f"WITH {SCORED} SELECT subject, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, count(*)::BIGINT AS n FROM scored GROUP BY subject")
def accuracy_half(spark: SparkSession, sf: str) -> DataFrame:
    return r6(metrics.accuracy(src.scored(spark, sf), ["subject"]), "accuracy")


# --- manifests ---


@query(f"WITH {MANIFEST} SELECT attack_type, count(*)::BIGINT AS n FROM manifest GROUP BY 1")
def coverage_by_species(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage(src.manifest(spark, sf))


@query(f"WITH {MANIFEST} SELECT identity, count(DISTINCT split)::BIGINT AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM manifest WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def identity_leak_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.identity_leaks(src.manifest(spark, sf))


@query(f"WITH {MANIFEST}, p AS (SELECT DISTINCT identity, split FROM manifest WHERE split IS NOT NULL) SELECT a.split AS split_a, b.split AS split_b, count(*)::BIGINT AS n_shared, min(a.identity) AS example FROM p a JOIN p b ON a.identity = b.identity AND a.split < b.split GROUP BY 1, 2")
def split_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return quality.leaking_split_pairs(src.manifest(spark, sf))


@query("SELECT count(DISTINCT s_name)::BIGINT AS n_ids, sha256(string_agg(DISTINCT s_name, '|' ORDER BY s_name)) AS fingerprint FROM supplier")
def index_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return quality.index_fingerprint(src.table(spark, sf, "supplier"), "s_name")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.unseen(src.table(spark, sf, "documents").select("doc_id", "lang"), src.table(spark, sf, "labels"), "doc_id")


@query("SELECT c.c_custkey, o_orderkey, o_orderstatus FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) o ON o.o_custkey = c.c_custkey AND k = 1")
def manifest_left_join_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    left = src.table(spark, sf, "customer").select("c_custkey")
    orders = src.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return manifests.last_wins(left, orders, "c_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def restrict_identities_semi(spark: SparkSession, sf: str) -> DataFrame:
    ids = src.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return manifests.restricted(src.table(spark, sf, "lineitem").select("l_suppkey"), ids, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_n_per_identity(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.first_per(src.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)


@query(f"WITH {MANIFEST} SELECT label, lang, sample_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label, lang ORDER BY sample_id) AS rank FROM manifest) WHERE rank <= 20")
def cap_per_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.manifest(spark, sf).select("label", F.col("bonafide_source.dataset").alias("lang"), "sample_id")
    return manifests.first_per(rows, ["label", "lang"], ["sample_id"], 20)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_per_identity(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.best_per(src.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ('0x' || substr(sha256('5|' || o_orderkey), 1, 15))::BIGINT, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def shuffled_take_per_identity(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.shuffled_take(src.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 5, 2)


SPLIT_ORDER = "('0x' || substr(sha256('split|' || subject), 1, 15))::BIGINT"


@query(f"""WITH c AS (SELECT l_suppkey AS subject, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {SPLIT_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS total FROM c)
SELECT subject, n::BIGINT AS n, CASE WHEN b < greatest(1, floor(total * 0.25::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM o""")
def subject_disjoint_split_hash(spark: SparkSession, sf: str) -> DataFrame:
    return splits.subject_disjoint(src.scored(spark, sf), "subject", 0.25, "split")


@query()
def subject_disjoint_split_numpy(spark: SparkSession, sf: str) -> DataFrame:
    return splits.subject_disjoint_permuted(src.scored(spark, sf), "subject", "unit", 0.25, 0)


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS subject, l_returnflag FROM lineitem), n AS (SELECT l_returnflag, count(*) AS n FROM s GROUP BY 1)
SELECT l_returnflag, n::BIGINT AS n, round_even(n * 0.725::DOUBLE, 0)::BIGINT AS n_train, round_even(n * 0.125::DOUBLE, 0)::BIGINT AS n_dev, (n - round_even(n * 0.725::DOUBLE, 0)::BIGINT - round_even(n * 0.125::DOUBLE, 0)::BIGINT)::BIGINT AS n_test FROM n""")
def identity_split_sizes_bround(spark: SparkSession, sf: str) -> DataFrame:
    n = src.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct().groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_returnflag", "n", fn.split_sizes(F.col("n"), 0.725, 0.125).alias("s")).select("l_returnflag", "n", "s.*")


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY ('0x' || substr(sha256('ids|' || c_custkey), 1, 15))::BIGINT, c_custkey) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT c_custkey FROM customer))
SELECT c_custkey, CASE WHEN p <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN p <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'dev' ELSE 'test' END AS split FROM o""")
def identity_disjoint_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.identity_splits(src.table(spark, sf, "customer"), "c_custkey", 0.7, 0.15, "ids")


# --- seeds and work items ---


def seed_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"length(({p})::VARCHAR) || ':' || ({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(sha256({joined}), 1, 8))::BIGINT"


@query(f"SELECT o_orderkey, {seed_sql('7', chr(39) + 'face' + chr(39), 'o_orderstatus', 'o_orderkey')} AS seed, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT AS subject_seed FROM orders")
def derive_seed(spark: SparkSession, sf: str) -> DataFrame:
    o = src.table(spark, sf, "orders")
    return o.select("o_orderkey", fn.derive_seed(F.lit(7), F.lit("face"), "o_orderstatus", "o_orderkey").alias("seed"), fn.subject_seed("o_orderkey").alias("subject_seed"))


ATTACKS = (("mask", 0.2), ("print", 0.5), ("replay", 0.3))


@query(f"""WITH p AS (SELECT s_name AS identity, (row_number() OVER (ORDER BY s_suppkey) - 1) * 5 AS base FROM supplier),
i AS (SELECT identity, sub, base + sub AS counter FROM (SELECT identity, base, unnest(range(5)) AS sub FROM p)),
s AS (SELECT *, {seed_sql('11', chr(39) + 'face' + chr(39), chr(39) + '_dispatch' + chr(39), 'counter')} AS dispatch_seed FROM i),
a AS (SELECT *, CASE WHEN dispatch_seed < {int(0.2 * 2**32)} THEN 'mask' WHEN dispatch_seed < {int(0.7 * 2**32)} THEN 'print' ELSE 'replay' END AS attack FROM s)
SELECT format('face-{{}}-{{:08d}}', attack, counter) AS sample_id, identity, sub::INT AS sub, counter::BIGINT AS counter, dispatch_seed, attack, {seed_sql('11', chr(39) + 'face' + chr(39), 'attack', 'counter')} AS seed FROM a""")
def work_items(spark: SparkSession, sf: str) -> DataFrame:
    s = src.table(spark, sf, "supplier").select("s_name", "s_suppkey")
    return manifests.work_items(s, "s_name", "s_suppkey", 5, "face", ATTACKS, 11)


@query("SELECT s_suppkey, sub::INT AS sub, format('voice-{}-{:08d}', s_nationkey, s_suppkey * 4 + sub) AS sample_id FROM (SELECT s_suppkey, s_nationkey, unnest(range(4)) AS sub FROM supplier)")
def sample_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = src.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sub"))
    return s.select("s_suppkey", "sub", fn.sample_id(F.lit("voice"), F.col("s_nationkey").cast("string"), F.col("s_suppkey") * 4 + F.col("sub")).alias("sample_id"))


# --- features ---


@query(f"WITH {STEPS} SELECT session, pos, round(dt, 6) AS dt, round(speed, 6) AS speed, round(turn, 6) AS turn, round(jerk, 6) AS jerk FROM steps")
def touch_kinematics(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.touch_steps(src.touch(spark, sf)).drop("step"), "dt", "speed", "turn", "jerk")


@query(f"WITH {STEPS} SELECT session, round(avg(speed), 6) AS touch_speed_mean, round(stddev_pop(speed), 6) AS touch_speed_std, round(avg(turn), 6) AS touch_curvature_mean, round(stddev_pop(jerk), 6) AS touch_jitter, round(avg(dt), 6) AS inter_touch_interval_mean FROM steps GROUP BY session")
def touch_features(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.touch_features(src.touch(spark, sf)), *features.FEATURES[:5])


@query(f"WITH {KEYS} SELECT session, i::INT AS i, round(dwell, 6) AS dwell, round(flight, 6) AS flight FROM keytimes")
def dwell_flight(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.key_times(src.keys(spark, sf)), "dwell", "flight")


@query(f"WITH {KEYS} SELECT session, round(avg(CASE WHEN flight < 0.005 THEN 1.0::DOUBLE WHEN flight IS NOT NULL THEN 0.0 END), 6) AS key_paste_ratio FROM keytimes GROUP BY session")
def paste_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.key_features(src.keys(spark, sf)).select("session", "key_paste_ratio"), "key_paste_ratio")


MAGNITUDE = "mag AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY pos) AS step, sqrt(ax * ax + ay * ay + az * az) AS m FROM motion)"
CORR = "coalesce(covar_pop(m, speed) / nullif(stddev_pop(m) * stddev_pop(speed), 0), 0)"


@query(f"WITH {STEPS}, {MAGNITUDE} SELECT session, round({CORR}, 6) AS motion_touch_coupling FROM steps JOIN mag USING (session, step) GROUP BY session")
def motion_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.coupling(src.touch(spark, sf), src.motion(spark, sf)), "motion_touch_coupling")


def feature_sql(events: str, sessions: str) -> str:
    """The features of the CTEs touch, keyev and motion in `events`, for the sessions that a query names."""
    return f"""WITH {STEPS.replace(EVENTS, events)}, {KEYS.split(EVENTS + ',')[1]}, {MAGNITUDE},
t AS (SELECT session, avg(speed) AS f0, stddev_pop(speed) AS f1, avg(turn) AS f2, stddev_pop(jerk) AS f3, avg(dt) AS f4 FROM steps GROUP BY session),
k AS (SELECT session, avg(dwell) AS f5, stddev_pop(dwell) AS f6, avg(flight) AS f7, stddev_pop(flight) AS f8, avg(CASE WHEN flight < 0.005 THEN 1.0::DOUBLE WHEN flight IS NOT NULL THEN 0.0 END) AS f9 FROM keytimes GROUP BY session),
m AS (SELECT session, avg(m) AS f10, stddev_pop(m) AS f11 FROM mag GROUP BY session),
c AS (SELECT session, {CORR} AS f12 FROM steps JOIN mag USING (session, step) GROUP BY session)
SELECT s.session, {', '.join(f"round(coalesce(f{i}, {1.0 if i == 9 else 0.0}::DOUBLE), 6) AS {n}" for i, n in enumerate(features.FEATURES[:-1]))},
  CASE WHEN s.session IN (SELECT session FROM touch) AND s.session NOT IN (SELECT session FROM motion) THEN 1.0::DOUBLE ELSE 0.0 END AS touch_without_motion_ratio
FROM ({sessions}) s LEFT JOIN t USING (session) LEFT JOIN k USING (session) LEFT JOIN m USING (session) LEFT JOIN c USING (session)"""


@query(feature_sql(EVENTS, "SELECT DISTINCT session FROM ev"))
def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    return r6(features.feature_vector(src.sessions(spark, sf), src.touch(spark, sf), src.keys(spark, sf), src.motion(spark, sf)), *features.FEATURES)


@query(f"""WITH {EVENTS},
a AS (SELECT session, list(x ORDER BY pos) AS xs, count(*) AS n FROM touch GROUP BY session),
b AS (SELECT *, greatest(1, floor(n * 0.5::DOUBLE / 4.000000001::DOUBLE))::INT AS st FROM a),
c AS (SELECT *, unnest(range(5)) AS w FROM b),
d AS (SELECT session, xs, w, CASE WHEN n < 5 THEN 1 ELSE w * st + 1 END AS first, CASE WHEN n < 5 THEN n ELSE n - st * 4 END AS size FROM c)
SELECT session, w::INT AS "window", first::INT AS first, size::INT AS size, round(list_sum(xs[first:first + size - 1]), 6) AS total FROM d""")
def count_windows_k5(spark: SparkSession, sf: str) -> DataFrame:
    w = features.count_windows(src.touch(spark, sf).select("session", "pos", "x"), ["session"], "pos")
    return r6(w.groupBy("session", "window").agg(F.first("first").alias("first"), F.first("size").alias("size"), F.sum("x").alias("total")), "total")


WINDOWED = EVENTS.replace("touch AS (SELECT * FROM ev WHERE event_type = 'click')", """click AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM ev WHERE event_type = 'click'),
stepped AS (SELECT *, greatest(1, floor(n * 0.5::DOUBLE / 4.000000001::DOUBLE))::INT AS st FROM click),
laid AS (SELECT *, unnest(range(5)) AS w FROM stepped),
touch AS (SELECT session AS rep, w, session || '/' || w AS session, pos, us, x, y FROM laid WHERE n < 5 OR (i >= w * st AND i < w * st + n - st * 4))""")


@query(f"""WITH {STEPS.replace(EVENTS, WINDOWED)}, {KEYS.split(EVENTS + ',')[1]},
t AS (SELECT session, avg(speed) AS f0, stddev_pop(speed) AS f1, avg(turn) AS f2, stddev_pop(jerk) AS f3, avg(dt) AS f4 FROM steps GROUP BY session),
k AS (SELECT session AS rep, avg(dwell) AS f5, stddev_pop(dwell) AS f6, avg(flight) AS f7, stddev_pop(flight) AS f8 FROM keytimes GROUP BY session)
SELECT r.rep AS session, r.w::INT AS "window", {', '.join(f"round(coalesce(f{i}, 0), 6) AS {n}" for i, n in enumerate(features.FEATURES[:9]))}
FROM (SELECT DISTINCT rep, w, session FROM touch) r LEFT JOIN t USING (session) LEFT JOIN k USING (rep)""")
def rep_windows(spark: SparkSession, sf: str) -> DataFrame:
    """What enrolment takes of a rep, with users for reps."""
    return r6(reps.windows(src.touch(spark, sf), src.keys(spark, sf)), *reps.SUBSET)


def _reps(spark: SparkSession, sf: str) -> DataFrame:
    """Users' clicks and keys in the form of captured reps."""
    ms = (F.col("us") / F.lit(1000.0)).alias("ts")
    packed = lambda e, name, *c: e.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*c, ms).alias("e")))), lambda x: x["e"]).alias(name))
    keys = src.keys(spark, sf).withColumn("code", F.col("code").cast("string"))
    return packed(src.touch(spark, sf), "pointer", "x", "y").join(packed(keys, "keys", "code", "phase"), "session", "left")


@query(f"""WITH {EVENTS},
o AS (SELECT session, phase, lag(phase) OVER (PARTITION BY session, code ORDER BY pos) AS pp FROM keyev),
d AS (SELECT session, count(*) AS n FROM o WHERE phase = 'up' AND pp = 'down' GROUP BY session),
t AS (SELECT session, count(*) AS n, bool_or(late) AS late FROM (SELECT session, us <= lag(us) OVER (PARTITION BY session ORDER BY pos) AS late FROM touch) GROUP BY session)
SELECT t.session, CASE WHEN t.n < 8 THEN 'too_few_touch' WHEN coalesce(d.n, 0) < 2 THEN 'too_few_keys' WHEN late THEN 'non_monotonic_time' END AS reason FROM t LEFT JOIN d USING (session)""")
def rep_qc_reason(spark: SparkSession, sf: str) -> DataFrame:
    return reps.faults(_reps(spark, sf))


@query(f"""WITH {EVENTS},
o AS (SELECT session, code, phase, us, lag(phase) OVER w AS pp, lag(us) OVER w AS pu FROM keyev WINDOW w AS (PARTITION BY session, code ORDER BY pos))
SELECT session, code, pu AS down_t, us AS up_t FROM o WHERE phase = 'up' AND pp = 'down'""")
def key_down_up_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.key_pairs(src.keys(spark, sf).withColumnRenamed("us", "t")).drop("pos")


@query(f"""WITH {EVENTS},
s AS (SELECT session, pos, (us - lag(us) OVER w) / 1e6::DOUBLE AS dt, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM touch WINDOW w AS (PARTITION BY session ORDER BY pos)),
f AS (SELECT session, pos, CASE WHEN dt <= 0 THEN 'non_monotonic_time' WHEN step > dt * 0.001::DOUBLE THEN 'implausible_speed' END AS fault FROM s),
t AS (SELECT session, count(*) AS n, arg_min(fault, pos) FILTER (fault IS NOT NULL) AS fault FROM f GROUP BY session),
m AS (SELECT session, count(*) AS n FROM motion GROUP BY session)
SELECT s.session, CASE WHEN coalesce(t.n, 0) < 12 THEN 'too_few_touch' WHEN coalesce(m.n, 0) < 24 THEN 'too_few_motion' ELSE fault END AS reason
FROM (SELECT DISTINCT session FROM ev) s LEFT JOIN t USING (session) LEFT JOIN m USING (session)""")
def session_qc_reason(spark: SparkSession, sf: str) -> DataFrame:
    """With counts and a largest speed that part these sessions."""
    sec = features.seconds(F.col("us")).alias("t")
    touch, motion = src.touch(spark, sf).select("session", "pos", sec, "x", "y", "us"), src.motion(spark, sf).select("session", "pos", sec, "ax")
    return quality.session_faults(touch, motion, src.sessions(spark, sf), 12, 24, max_speed=0.001, us="us")


# --- profiles ---

FLAT = "flat AS (SELECT vec_id, label AS subject, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS v FROM embeddings)"
MOMENTS = FLAT + ", mo AS (SELECT subject, place, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, var_pop(v) AS variance FROM flat GROUP BY 1, 2)"
DIST = MOMENTS + ", di AS (SELECT subject, vec_id, sqrt(avg(z * z)) AS distance FROM (SELECT subject, vec_id, (v - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS z FROM flat JOIN mo USING (subject, place) WHERE variance > 1e-12) GROUP BY 1, 2)"


@query(f"WITH {MOMENTS} SELECT subject, place::INT AS place, n::BIGINT AS n, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 6) AS variance, variance <= 1e-12 AS constant FROM mo")
def constant_column_drop(spark: SparkSession, sf: str) -> DataFrame:
    return r6(profiles.column_moments(src.profiles(spark, sf), ["subject"], "vector"), "mean", "std", "variance")


@query(f"WITH {DIST} SELECT subject, vec_id, round(distance, 6) AS distance FROM di")
def column_standardise(spark: SparkSession, sf: str) -> DataFrame:
    p = src.profiles(spark, sf)
    return r6(profiles.standard_distances(p, profiles.column_moments(p, ["subject"], "vector"), ["subject"], "vec_id", "vector"), "distance")


THR = "th AS (SELECT subject, count(distance) AS n, CASE WHEN count(distance) >= 4 THEN avg(distance) + 3 * stddev_pop(distance) ELSE max(distance) * 1.1::DOUBLE END AS threshold FROM di GROUP BY 1)"


@query(f"WITH {DIST}, {THR} SELECT subject, n::BIGINT AS n, round(threshold, 6) AS threshold FROM th")
def profile_calibration(spark: SparkSession, sf: str) -> DataFrame:
    p = src.profiles(spark, sf)
    d = profiles.standard_distances(p, profiles.column_moments(p, ["subject"], "vector"), ["subject"], "vec_id", "vector")
    return r6(profiles.calibrated(d, ["subject"]), "threshold")


@query(f"WITH {DIST}, th AS (SELECT subject, avg(distance) AS threshold FROM di GROUP BY 1) SELECT subject, vec_id // 20 AS attempt, count(*)::BIGINT AS n_windows, round(avg(CASE WHEN distance > threshold THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS part_above, CASE WHEN avg(CASE WHEN distance > threshold THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.5 THEN 'REJECT' ELSE 'ACCEPT' END AS verdict FROM di JOIN th USING (subject) GROUP BY ALL")
def attempt_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of up to 20 vectors against the mean distance of their subject."""
    p = src.profiles(spark, sf)
    d = profiles.standard_distances(p, profiles.column_moments(p, ["subject"], "vector"), ["subject"], "vec_id", "vector").withColumn("attempt", F.expr("vec_id div 20"))
    return r6(profiles.attempts(d, d.groupBy("subject").agg(F.avg("distance").alias("threshold")), ["subject"], "attempt"), "part_above")


@query(f"""WITH {FLAT}, m AS (SELECT subject, place, avg(v) AS mean FROM flat GROUP BY 1, 2), c AS (SELECT subject, vec_id, place, v - mean AS d FROM flat JOIN m USING (subject, place))
SELECT subject, a.place::INT AS i, b.place::INT AS j, round(sum(a.d * b.d) / greatest(count(*) - 1, 1), 6) AS cov FROM c a JOIN c b USING (subject, vec_id) WHERE a.place <= b.place GROUP BY subject, a.place, b.place""")
def covariance_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    flat = profiles.covariances(src.profiles(spark, sf), "subject", "vector", 64).select("subject", F.posexplode("cov").alias("k", "cov"))
    return flat.select("subject", F.expr("cast(k div 64 AS int)").alias("i"), (F.col("k") % 64).alias("j"), F.round("cov", 6).alias("cov")).filter("i <= j")


@query()
def mahalanobis_score(spark: SparkSession, sf: str) -> DataFrame:
    p = src.profiles(spark, sf)
    fitted = profiles.profiled(p, "subject", "vector", 64)
    return profiles.distances(p, fitted, "subject", "vector", 64).select("vec_id", "subject", F.round("distance", 6).alias("distance"))


@query()
def logistic_bot(spark: SparkSession, sf: str) -> DataFrame:
    """Feature vectors of sessions; those with many clicks stand for bots."""
    v = features.feature_vector(src.sessions(spark, sf), src.touch(spark, sf), src.keys(spark, sf), src.motion(spark, sf))
    n = src.touch(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    rows = v.join(n, "session", "left").select("session", F.array(*features.FEATURES).alias("vector"), (F.coalesce("n", F.lit(0)) > 13).cast("int").alias("label"))
    w, b, mean, std = profiles.logistic(rows, "vector", "label")
    return profiles.logistic_scores(rows, "vector", w, b, mean, std).select("session", "label", F.round("score", 6).alias("score"))


# --- sweeps ---

CELLS = """cells AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-07-01' THEN 'baseline' ELSE 'commercial' END AS side, c_mktsegment AS capacity, o_orderpriority AS data_level, o_orderkey % 3 AS seed, o_orderkey AS file,
  ((o_orderkey * 37 + o_custkey * 11) % 500) / 1000::DOUBLE AS eer, o_orderkey % 97 AS n_train, o_custkey % 89 AS n_val FROM orders JOIN customer ON o_custkey = c_custkey)"""
AGG = CELLS + ", ag AS (SELECT side, capacity, data_level, avg(eer) AS mean, stddev_pop(eer) AS std, count(*) AS n_seeds, arg_min(n_train, file) AS n_train, arg_min(n_val, file) AS n_val FROM cells GROUP BY ALL)"
AB = AGG + """, ab AS (SELECT coalesce(a.capacity, b.capacity) AS capacity, coalesce(a.data_level, b.data_level) AS data_level, a.mean AS baseline_mean, b.mean AS other_mean, b.mean - a.mean AS delta,
  CASE WHEN b.mean IS NULL THEN 'baseline_only' WHEN a.mean IS NULL THEN 'other_only' WHEN b.mean <= 0.001 THEN 'collapsed' WHEN abs(b.mean - a.mean) > 0.03 THEN 'delta_exceeds_band' ELSE 'ok' END AS verdict,
  coalesce(a.n_train <> b.n_train OR a.n_val <> b.n_val, false) AS scale_mismatch
  FROM (SELECT * FROM ag WHERE side = 'baseline') a FULL JOIN (SELECT * FROM ag WHERE side = 'commercial') b ON a.capacity = b.capacity AND a.data_level = b.data_level)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cells = src.sweep_cells(spark, sf)
    return tuple(sweeps.aggregated(cells.filter(F.col("side") == s)) for s in ("baseline", "commercial"))


@query(f"WITH {AGG} SELECT capacity, data_level, round(mean, 6) AS mean, round(std, 6) AS std, n_seeds::BIGINT AS n_seeds, n_train, n_val FROM ag WHERE side = 'baseline'")
def sweep_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_sides(spark, sf)[0], "mean", "std")


@query(f"WITH {AB} SELECT capacity, data_level, round(baseline_mean, 6) AS baseline_mean, round(other_mean, 6) AS other_mean, round(delta, 6) AS delta, verdict, scale_mismatch FROM ab")
def sweep_ab_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return r6(sweeps.compared(*_sides(spark, sf)), "baseline_mean", "other_mean", "delta")


@query(f"WITH {AB} SELECT count(*) FILTER (verdict NOT IN ('baseline_only', 'other_only'))::BIGINT AS n_shared, count(*) FILTER (verdict = 'ok')::BIGINT AS n_ok, count(*) FILTER (verdict NOT IN ('baseline_only', 'other_only')) > 0 AND count(*) FILTER (verdict NOT IN ('baseline_only', 'other_only')) = count(*) FILTER (verdict = 'ok') AS passed FROM ab")
def sweep_passed(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.passed(sweeps.compared(*_sides(spark, sf)))


FIRES = AGG + ", fi AS (SELECT a.data_level, a.capacity AS cap_a, b.capacity AS cap_b, abs(a.mean - b.mean) AS gap, abs(a.mean - b.mean) >= 0.005 AND abs(a.mean - b.mean) > (a.std + b.std) * 0.01::DOUBLE AS fires FROM ag a JOIN ag b ON a.side = 'baseline' AND b.side = 'baseline' AND a.data_level = b.data_level AND a.capacity < b.capacity)"


def _fires(spark: SparkSession, sf: str) -> DataFrame:
    base = _sides(spark, sf)[0]
    a, b = base.alias("a"), base.alias("b")
    pairs = a.join(b, (F.col("a.data_level") == F.col("b.data_level")) & (F.col("a.capacity") < F.col("b.capacity")))
    fires = sweeps.fires(F.col("a.mean"), F.col("a.std") * F.lit(0.01), F.col("b.mean"), F.col("b.std") * F.lit(0.01), 0.005)
    return pairs.select(F.col("a.data_level").alias("data_level"), F.col("a.capacity").alias("cap_a"), F.col("b.capacity").alias("cap_b"), F.round(F.abs(F.col("a.mean") - F.col("b.mean")), 6).alias("gap"), fires.alias("fires"))


@query(f"WITH {FIRES.replace('(a.std + b.std) * 0.01::DOUBLE', '(a.std * 0.01::DOUBLE + b.std * 0.01::DOUBLE)')} SELECT data_level, cap_a, cap_b, round(gap, 6) AS gap, fires FROM fi")
def sweep_axis_fires(spark: SparkSession, sf: str) -> DataFrame:
    """With bands that part these cells."""
    return _fires(spark, sf)


@query(f"WITH {FIRES.replace('(a.std + b.std) * 0.01::DOUBLE', '(a.std * 0.01::DOUBLE + b.std * 0.01::DOUBLE)')} SELECT data_level, CASE WHEN bool_or(fires) AND bool_and(fires) THEN 'both' WHEN bool_or(fires) THEN 'capacity-limited' WHEN bool_and(fires) THEN 'data-limited' ELSE 'physics-limited' END AS diagnosis FROM fi GROUP BY 1")
def sweep_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    f = _fires(spark, sf).groupBy("data_level").agg(F.bool_or("fires").alias("some"), F.bool_and("fires").alias("all"))
    return f.select("data_level", sweeps.diagnosis(F.col("some"), F.col("all")).alias("diagnosis"))


@query(f"WITH {CELLS} SELECT CASE WHEN eer < 0.3 THEN 'proceed' WHEN eer <= 0.45 THEN 'iterate' ELSE 'rethink' END AS band, count(*)::BIGINT AS n FROM cells GROUP BY 1")
def eer_decision_band(spark: SparkSession, sf: str) -> DataFrame:
    return src.sweep_cells(spark, sf).groupBy(sweeps.decision_band(F.col("eer")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


CURVE = "cu AS (SELECT p_size % 7 * 50 AS n_real, avg(p_retailprice) / 10000 AS eer, p_size % 7 * 50 > 250 AS skipped FROM part GROUP BY p_size % 7)"


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = src.table(spark, sf, "part").groupBy((F.col("p_size") % 7 * 50).alias("n_real")).agg((F.avg("p_retailprice") / 10000).alias("eer"))
    return sweeps.oversized_skipped(curve, F.lit(250))


@query(f"WITH {CURVE}, e AS (SELECT max(CASE WHEN n_real = 0 THEN eer END) AS base, max(n_real) AS top_n, arg_max(eer, n_real) AS top FROM cu WHERE NOT skipped) SELECT round(base, 6) AS base, top_n, round(top, 6) AS top, round(top - base, 6) AS delta, CASE WHEN base IS NULL OR top_n <= 0 OR top IS NULL THEN NULL WHEN top < base THEN 'helps' WHEN top = base THEN 'no change' ELSE 'hurts' END AS verdict FROM e")
def curve_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return r6(sweeps.curve_verdict(_curve(spark, sf)), "base", "top", "delta")


@query(f"WITH {CURVE} SELECT n_real, round(eer, 6) AS eer, skipped FROM cu")
def curve_skip_oversized(spark: SparkSession, sf: str) -> DataFrame:
    return r6(_curve(spark, sf), "eer")


# --- sources and scalars ---


@query("SELECT p_partkey, CASE p_size % 10 WHEN 1 THEN 'print' WHEN 2 THEN 'print' WHEN 3 THEN 'print' WHEN 7 THEN 'replay' WHEN 8 THEN 'replay' WHEN 9 THEN 'replay' WHEN 0 THEN 'bonafide' WHEN 4 THEN 'mask' END AS class FROM part WHERE p_size % 10 NOT IN (5, 6)")
def label_code_map(spark: SparkSession, sf: str) -> DataFrame:
    classes = {0: "bonafide", 1: "print", 2: "print", 3: "print", 4: "mask", 7: "replay", 8: "replay", 9: "replay"}
    coded = src.table(spark, sf, "part").select("p_partkey", fn.code_label(F.col("p_size") % 10, classes).alias("class"))
    return coded.filter(F.col("class").isNotNull())


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host, split_part(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/', 1) AS part FROM pages")
def path_subject(spark: SparkSession, sf: str) -> DataFrame:
    p = src.table(spark, sf, "pages")
    return p.select("page_id", files.subject_of(F.col("url")).alias("host"), F.split_part("url", F.lit("/"), F.lit(4)).alias("part"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 1.0::DOUBLE ELSE round((o_orderkey % 3) * 3600 + (o_custkey % 60) * 60 + (o_orderkey % 60) + (o_custkey % 100) / 100::DOUBLE, 6) END AS seconds FROM orders")
def duration_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Probe texts are made of the keys; every eleventh has no duration."""
    o = src.table(spark, sf, "orders")
    text = F.format_string("  Duration: %02d:%02d:%02d.%02d, start: 0.0", F.col("o_orderkey") % 3, F.col("o_custkey") % 60, F.col("o_orderkey") % 60, F.col("o_custkey") % 100)
    probes = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "N/A").otherwise(text).alias("probe"))
    return r6(probes.select("o_orderkey", fn.duration_seconds("probe", 1.0).alias("seconds")), "seconds")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 600 AS x, l_suppkey % 400 AS y, (20 + l_quantity * 5)::BIGINT AS w, (30 + l_quantity * 4)::BIGINT AS h FROM lineitem),
s AS (SELECT *, least(greatest(w, h), 640, 480) AS side FROM b)
SELECT l_orderkey, l_linenumber, x, y, w, h, greatest(0, least(round_even(x + w / 2.0::DOUBLE - side / 2.0::DOUBLE, 0)::BIGINT, 640 - side))::BIGINT AS "left", greatest(0, least(round_even(y + h / 2.0::DOUBLE - side / 2.0::DOUBLE, 0)::BIGINT, 480 - side))::BIGINT AS top, side::BIGINT AS side FROM s""")
def square_crop_bbox(spark: SparkSession, sf: str) -> DataFrame:
    b = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 600).alias("x"), (F.col("l_suppkey") % 400).alias("y"), (20 + F.col("l_quantity") * 5).cast("long").alias("w"), (30 + F.col("l_quantity") * 4).cast("long").alias("h"))
    return b.withColumn("c", fn.square_crop(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(640).cast("long"), F.lit(480).cast("long"))).select("l_orderkey", "l_linenumber", "x", "y", "w", "h", "c.*")


@query("SELECT o_orderkey, i::INT AS i, round((o_totalprice / 1000) * (i + 0.5::DOUBLE) / 4, 8) AS t FROM (SELECT o_orderkey, o_totalprice, unnest(range(4)) AS i FROM orders)")
def frame_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    o = src.table(spark, sf, "orders").select("o_orderkey", F.posexplode(fn.frame_times(F.col("o_totalprice") / 1000, 4)).alias("i", "t"))
    return o.withColumn("t", F.round("t", 8))


@query("""SELECT 'bonafide_dataset_ingested' AS type, n_name AS name, count(*)::BIGINT AS n, NULL::VARCHAR AS axis FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT 'generator_registered', p_brand, count(*)::BIGINT, NULL FROM part GROUP BY p_brand UNION ALL SELECT 'ontology_citation', r_name, count(*)::BIGINT, n_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def provenance_union_by_type(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: src.table(spark, sf, n)
    count = F.count(F.lit(1)).alias("n")
    a = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(count).select(F.lit("bonafide_dataset_ingested").alias("type"), "name", "n")
    b = t("part").groupBy(F.col("p_brand").alias("name")).agg(count).select(F.lit("generator_registered").alias("type"), "name", "n")
    c = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name"), F.col("n_name").alias("axis")).agg(count).select(F.lit("ontology_citation").alias("type"), "name", "n", "axis")
    return a.unionByName(b).unionByName(c, allowMissingColumns=True).select("type", "name", "n", F.col("axis").cast("string").alias("axis"))


INGEST = """p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents),
d AS (SELECT doc_id, lang, place, format('real-{}-{:08d}', lang, place) AS sample_id, place % 3 = 0 AS known, CASE WHEN n_chars < 200 THEN 'low_variance' END AS fault FROM p WHERE place < 100)"""


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pictures of a class each: a hundred of each class, every third there already, short ones unfit."""
    docs = src.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    plan = ingest.planned(docs, "lang", "doc_id", F.lit("real"), 100)
    done = ingest.marked(plan, plan.filter(F.col("place") % 3 == 0))
    return done.withColumn("fault", F.when(F.col("n_chars") < 200, "low_variance"))


@query(f"WITH {INGEST} SELECT lang, count(*) FILTER (NOT known AND fault IS NULL)::BIGINT AS written, count(*) FILTER (known)::BIGINT AS known, count(*) FILTER (NOT known AND fault IS NOT NULL)::BIGINT AS faulty FROM d GROUP BY lang")
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.counted(_ingested(spark, sf), "lang")


@query(f"WITH {INGEST} SELECT 'real_attack_dataset_ingested' AS type, 'docs' AS name, 'CC0' AS license, 'http://h' AS source_url, sha256(string_agg(DISTINCT sample_id, '|' ORDER BY sample_id)) AS sha256_of_index FROM d HAVING bool_or(NOT known AND fault IS NULL)")
def ingest_event(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.event(_ingested(spark, sf), "sample_id", "real_attack_dataset_ingested", "docs", "CC0", "http://h")


@query("SELECT lang, round(count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) / count(*)::DOUBLE, 6) AS rate FROM documents GROUP BY lang")
def detection_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled good, as pictures with a face found."""
    good = src.table(spark, sf, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("_found", F.lit(True))
    d = src.table(spark, sf, "documents").select("doc_id", "lang").join(good, "doc_id", "left")
    return r6(d.groupBy("lang").agg(fn.detection_rate(F.coalesce("_found", F.lit(False)), F.lit(True)).alias("rate")), "rate")


# --- events in time, as a batch ---


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '5 seconds', ts), time_bucket(INTERVAL '5 seconds', ts) - INTERVAL '5 seconds']) AS start FROM events)
SELECT event_type, epoch_us(start) AS start_us, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2""")
def events_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of ten seconds that begin every five."""
    e = src.table(spark, sf, "events")
    w = e.groupBy("event_type", F.window("ts", "10 seconds", "5 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select("event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(w.start AS TIMESTAMP_NTZ))").alias("start_us"), "n", "total")


@query("""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events")
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(w.start AS TIMESTAMP_NTZ))").alias("start_us"), "n", "total")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def events_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS risk FROM events")
def risk_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """An extra: scores smoothed over five events."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return src.table(spark, sf, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("risk"))


# --- generation ---


@query("SELECT * FROM (VALUES " + ", ".join(f"('{kind}', '{name}', {i}::INT, {low}::DOUBLE, {high}::DOUBLE)" for kind, axes in (("touch", generate.TOUCH_AXES), ("keystroke", generate.KEY_AXES), ("motion", generate.MOTION_AXES)) for i, (name, (low, high)) in enumerate(axes.items())) + ") t(attack_type, axis, axis_pos, low, high)")
def ontology_axes_long(spark: SparkSession, sf: str) -> DataFrame:
    """The behavioural catalogue as a dimension table."""
    return _catalogue(spark).select("attack_type", "axis", "axis_pos", "low", "high")


def _catalogue(spark: SparkSession) -> DataFrame:
    kinds = {"touch": generate.TOUCH_AXES, "keystroke": generate.KEY_AXES, "motion": generate.MOTION_AXES}
    return generate.axes_table(spark, [{"version": "1", "attack_type": kind, "axes": {n: {"type": "uniform", "low": a, "high": b, "provenance": {"paper": "given range"}} for n, (a, b) in axes.items()}} for kind, axes in kinds.items()])


@query()
def ontology_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of each supplier's items, drawn from their own seeds."""
    s = src.table(spark, sf, "supplier").select("s_name", "s_suppkey")
    items = manifests.work_items(s, "s_name", "s_suppkey", 5, "behavioral", (("keystroke", 0.4), ("motion", 0.2), ("touch", 0.4)), 3)
    return generate.sampled(items, _catalogue(spark))


@query()
def work_items_numpy(spark: SparkSession, sf: str) -> DataFrame:
    """As work_items, with the attacks that numpy's weighted choice draws."""
    return generate.dispatched(work_items(spark, sf), dict(ATTACKS), "face", 11)


def _hash_sql(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + ")"


def _unit_sql(digest: str, at: int = 1) -> str:
    return f"((('0x' || substr({digest}, {at}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"


def _normal_sql(channel: str, place: str) -> str:
    h = _hash_sql("seed", f"'{channel}'", place)
    return f"(sqrt(-2 * ln({_unit_sql(h)})) * cos(6.283185307179586 * {_unit_sql(h, 14)}))"


def _spread_sql(mean: str, deviation: str, z: str) -> str:
    c = f"(({deviation}) / ({mean}))"
    return f"(({mean}) * exp({c} * {z} - {c} * {c} / 2))"


N_SESSIONS, SESSION_SEED = 2, 1
ITEMS = f"""subj AS (SELECT s_suppkey::VARCHAR AS subject_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM (SELECT DISTINCT s_suppkey FROM supplier)),
it0 AS (SELECT subject_id, i, s, unnest(['genuine', 'imposter', 'bot']) AS label FROM (SELECT subject_id, i, unnest(range({N_SESSIONS})) AS s FROM subj)),
it1 AS (SELECT concat_ws('-', label, subject_id, i * {N_SESSIONS} + s, 'a') AS session, label, subject_id,
  {seed_sql(f"{SESSION_SEED} * 1000 + i * {N_SESSIONS} + s", "'behavioral'", "label", "('0x' || substr(sha256(subject_id), 1, 8))::BIGINT")} AS seed,
  ('0x' || substr(sha256(subject_id || CASE WHEN label = 'imposter' THEN '-imp' ELSE '' END), 1, 8))::BIGINT AS profile_seed FROM it0),
items AS (SELECT *, label = 'bot' AS bot, {', '.join(f"{low}::DOUBLE + {_unit_sql(_hash_sql('profile_seed', chr(39) + n + chr(39)))} * {high - low}::DOUBLE AS {n}" for n, (low, high) in generate.ALL_AXES.items())} FROM it1)"""
GENERATED = ITEMS + f""",
t0 AS (SELECT *, unnest(range(1, {generate.N_TOUCH + 1})) AS pos FROM items),
t1 AS (SELECT session, pos, round(CASE WHEN bot THEN inter_touch_interval_ms / 1000 ELSE {_spread_sql('inter_touch_interval_ms / 1000', 'inter_touch_interval_ms / 1000 * 0.3::DOUBLE', _normal_sql('pace', 'pos'))} END * 1000000)::BIGINT AS gap,
  CASE WHEN bot THEN touch_speed_mean ELSE {_spread_sql('touch_speed_mean', 'touch_speed_std', _normal_sql('speed', 'pos'))} END AS speed,
  round(CASE WHEN bot THEN 0.0 ELSE touch_curvature * {_normal_sql('turn', 'pos')} END * 1000000000)::BIGINT AS turn,
  {', '.join(f"round(CASE WHEN bot THEN 0.02::DOUBLE ELSE touch_jitter * 0.1::DOUBLE END * {_normal_sql('jitter-' + c, 'pos')} * 10000)::BIGINT AS d{c}" for c in "xy")} FROM t0),
t2 AS (SELECT *, sum(gap) OVER w AS us, (sum(turn) OVER w)::DOUBLE / 1000000000::DOUBLE AS angle FROM t1 WINDOW w AS (PARTITION BY session ORDER BY pos)),
t3 AS (SELECT *, round(speed * gap / 1000000::DOUBLE * 10000::DOUBLE * cos(angle))::BIGINT AS mx, round(speed * gap / 1000000::DOUBLE * 10000::DOUBLE * sin(angle))::BIGINT AS my FROM t2),
touch AS (SELECT session, pos, us::BIGINT AS us, (sum(mx) OVER w + dx)::DOUBLE / 10000::DOUBLE + 100 AS x, (sum(my) OVER w + dy)::DOUBLE / 10000::DOUBLE + 100 AS y FROM t3 WINDOW w AS (PARTITION BY session ORDER BY pos)),
y0 AS (SELECT *, unnest(range(1, {generate.N_KEY + 1})) AS i FROM items),
y1 AS (SELECT session, i, {', '.join(f"round(CASE WHEN bot THEN key_{n}_mean / 1000 ELSE {_spread_sql(f'key_{n}_mean / 1000', f'key_{n}_std / 1000', _normal_sql(n, 'i'))} END * 1000000)::BIGINT AS {n}" for n in ("dwell", "flight"))} FROM y0),
y2 AS (SELECT *, coalesce(sum(dwell + flight) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS down FROM y1),
keyev AS (SELECT session, i * 2 AS pos, down AS us, 'down' AS phase FROM y2 UNION ALL SELECT session, i * 2 + 1, down + dwell, 'up' FROM y2),
m0 AS (SELECT i.*, last, unnest(range(1, {generate.N_MOTION + 1})) AS pos FROM items i JOIN (SELECT session, max(us) AS last FROM touch GROUP BY session) USING (session)),
motion AS (SELECT session, pos, {', '.join(f"round(CASE WHEN bot THEN 0.0 ELSE tremor_std END * 0.1::DOUBLE * {_normal_sql(c, 'pos')}, 5) AS {c}" for c in ("ax", "ay"))},
  round(accel_mag_mean + CASE WHEN bot THEN 0.0 ELSE tremor_std END * CASE WHEN pos < {generate.N_TOUCH} THEN motion_touch_coupling * {_normal_sql('speed', 'pos + 1')} + sqrt(1 - motion_touch_coupling * motion_touch_coupling) * {_normal_sql('az', 'pos')} ELSE {_normal_sql('az', 'pos')} END, 5) AS az FROM m0)"""


def _session_items(spark: SparkSession, sf: str, domain: str = "a") -> DataFrame:
    return generate.session_items(src.table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "s_suppkey", N_SESSIONS, SESSION_SEED, "behavioral", domain)


def _session_features(items: DataFrame) -> DataFrame:
    touch = generate.session_touch(items)
    return features.feature_vector(items.select(F.col("session_id").alias("session")), touch, generate.session_keys(items), generate.session_motion(items))


def _evaluation_set(spark: SparkSession, sf: str, domain: str) -> DataFrame:
    """(session, label, vector) of generated sessions, stored: training reads it many times."""
    items = _session_items(spark, sf, domain)
    rows = _session_features(items).select("session", F.array(*features.FEATURES).alias("vector"))
    return kept(rows.join(items.select(F.col("session_id").alias("session"), "label").hint("merge"), "session").select("session", "label", "vector"), "sessions")


@query(feature_sql(GENERATED, "SELECT session FROM items"))
def session_generate(spark: SparkSession, sf: str) -> DataFrame:
    """Features of generated sessions of all suppliers, as subjects."""
    return r6(_session_features(_session_items(spark, sf)), *features.FEATURES)


@query(f"WITH {ITEMS} SELECT session AS session_id, label, subject_id, 'sessions/' || session || '.json' AS payload_path, {generate.N_TOUCH}::INT AS n_touch, {2 * generate.N_KEY}::INT AS n_key, {generate.N_MOTION}::INT AS n_motion, true AS same_sha256 FROM items")
def session_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Generated sessions written as payload files with a manifest, twice, and read back by it: the second run adds nothing."""
    items, root = _session_items(spark, sf), shared_folder(spark, "sessions")
    touch = generate.session_touch(items)
    payloads = generate.payloads(items, touch, generate.session_keys(items), generate.session_motion(items, touch), "1", "1")
    files.write_sessions(payloads, root)
    found = files.session_payloads(spark, files.write_sessions(payloads, root), root)
    return found.select("session_id", "label", "subject_id", "payload_path", F.size("s.touch").alias("n_touch"), F.size("s.key").alias("n_key"), F.size("s.motion").alias("n_motion"), (F.col("sha256") == F.col("payload_sha256")).alias("same_sha256"))


@query()
def auth_bot_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """EER of imposters and accuracy against bots, in the domain that the models were trained on and in another."""
    return r6(evaluation.evaluated(_evaluation_set(spark, sf, "a"), _evaluation_set(spark, sf, "b"), len(features.FEATURES)), "auth_eer", "bot_accuracy")


@query()
def kernel_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Small pictures made of hashes of the suppliers' names, each attacked in three ways. The suppliers are dealt first, as their small table would be one task's."""
    names = dealt(src.table(spark, sf, "supplier").select("s_suppkey", "s_name"), 300, "s_suppkey")
    s = names.select("s_suppkey", F.unhex(F.repeat(F.sha2("s_name", 512), 27)).alias("pixels"), F.explode(F.array(*map(F.lit, sorted(kernels.KERNELS)))).alias("attack"))
    made = kernels.simulated(s.select("s_suppkey", "pixels", F.lit(24).alias("height"), F.lit(24).alias("width"), "attack", fn.derive_seed("s_suppkey", "attack").alias("seed"), F.lit(None).cast("map<string, double>").alias("params")), sensor="webcam")
    return made.select("s_suppkey", "attack", F.sha2("attacked", 256).alias("sha256"), "fault")


# --- streams, run to their end ---


@query(SQL["events_sliding_windows"])
def stream_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The batch query as a stream: updates of each window are kept, the last one counts."""
    stream = streams.sliding(streams.event_stream(spark, f"{sf}/events.parquet"), ["event_type"], "ts", "value")
    last = streams.last_state(streams.run_to_end(stream, shared_folder(spark, "stream"), "update"), ["event_type", "start"])
    return last.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 6).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Appends the first row of each key of a month; which row that is depends on arrival, so the key is returned."""
    stream = streams.without_repeats(streams.event_stream(spark, f"{sf}/events.parquet"), ["user_id", "event_type"], "ts", "31 days")
    return streams.run_to_end(stream.select("user_id", "event_type"), shared_folder(spark, "stream")).drop("batch")


@query()
def stream_enrolment(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects of the embeddings enrol with six reps of their vectors, are calibrated, and then attempt. The first nine of a vector's components stand in for the nine features of a window."""
    v = src.profiles(spark, sf).select(F.col("subject").cast("string").alias("user"), F.expr("vec_id div 50").alias("rep"), "vec_id", F.slice("vector", 1, 9).alias("x"))
    reps = v.groupBy("user", "rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "x"))), lambda e: e["x"]).alias("windows"))
    place = F.row_number().over(Window.partitionBy("user").orderBy("rep"))
    done = reps.withColumn("_p", place).withColumn("action", F.explode(F.when(F.col("_p") == 6, F.array(F.lit("enroll"), F.lit("calibrate"))).otherwise(F.array(F.when(F.col("_p") < 6, "enroll").otherwise("attempt")))))
    rows = done.select("user", (F.col("_p") * 2 + (F.col("action") == "calibrate").cast("int")).cast("long").alias("seq"), "action", "windows", F.lit(None).cast("string").alias("fault"))
    folder = shared_folder(spark, "actions")
    rows.write.parquet(folder)
    out = streams.run_to_end(enrolment.run(spark.readStream.schema(rows.schema).parquet(folder)), shared_folder(spark, "stream"))
    return r6(out.drop("batch"), "threshold", "part_above")
