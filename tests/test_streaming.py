"""Streams run to their end give what a batch gives; the enrolment state machine against plain numpy."""

import time

import numpy as np
from pyspark.sql import functions as F

from gaugeworks.plans.catalogue import QUERIES, SQL
from gaugeworks.streaming import enrolment, events


def test_stream_twins_are_registered():
    assert {"stream_sliding_windows", "stream_dedup", "stream_enrolment"} <= set(QUERIES)
    assert "stream_sliding_windows" in SQL


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 7).alias("k"), (F.timestamp_seconds(F.col("id"))).alias("ts"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = events.without_repeats(events.event_stream(spark, f"{tmp_path}/in", files_per_trigger=1), ["k"], "ts", "1 hour")
    first = events.run_to_end(stream, f"{tmp_path}/out")
    assert sorted(r["k"] for r in first.collect()) == list(range(7))
    again = events.run_to_end(stream, f"{tmp_path}/out")  # nothing new
    assert again.count() == 7


def test_sessions_of_a_stream(spark, sf, tmp_path):
    stream = events.sessions(events.event_stream(spark, f"{sf}/events.parquet"), ["user_id"], "ts", "value", delay="1 minute")
    found = events.run_to_end(stream, str(tmp_path))
    batch = QUERIES["events_sessions"](spark, sf)
    ours = {(r["user_id"], r["us"], r["n"]) for r in found.select("user_id", F.unix_micros("start").alias("us"), "n").collect()}
    theirs = {(r["user_id"], r["start_us"], r["n"]) for r in batch.collect()}
    assert ours <= theirs  # sessions at the end may still grow
    assert len(ours) >= len(theirs) - 60


def reps(n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, 1, (5, 9)) + np.arange(9) + shift).tolist() for _ in range(n)]


def actions():
    rows, seq = [], 0
    for user, shift in (("a", 0.0), ("b", 5.0)):
        for w in reps(3, 1, shift):
            rows.append((user, seq := seq + 1, "enroll", w, None))
        rows.append((user, seq := seq + 1, "calibrate", None, None))
        rows.append((user, seq := seq + 1, "attempt", reps(1, 2)[0], None))
        rows.append((user, seq := seq + 1, "enroll", None, "too_few_touch"))
        for w in reps(5, 3, shift):
            rows.append((user, seq := seq + 1, "enroll", w, None))
        rows.append((user, seq := seq + 1, "calibrate", None, None))
        rows.append((user, seq := seq + 1, "attempt", reps(1, 4, shift)[0], None))
        rows.append((user, seq := seq + 1, "attempt", reps(1, 4, shift + 40)[0], None))
    rows += [("a", seq := seq + 1, "reset", None, None), ("a", seq := seq + 1, "attempt", reps(1, 4)[0], None), ("c", seq := seq + 1, "dance", None, None)]
    return rows


def test_enrolment_over_several_batches(spark, tmp_path):
    schema = "user string, seq long, action string, windows array<array<double>>, fault string"
    rows = actions()
    for i in range(0, len(rows), 9):  # a file a batch, in this order
        spark.createDataFrame(rows[i : i + 9], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = enrolment.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"))
    got = {r["seq"]: r for r in events.run_to_end(stream, f"{tmp_path}/out").collect()}
    assert len(got) == len(rows)
    state: dict = {}
    for user, seq, action, windows, fault in rows:
        told = enrolment.act(state.setdefault(user, enrolment.Memory()), action, windows, fault)
        r = got[seq]
        assert (r["ok"], r["reason"], r["enroll_reps"], r["verdict"]) == (told[0], told[1], told[2], told[5])
        assert (r["threshold"] is None) == (told[3] is None) and (told[3] is None or abs(r["threshold"] - told[3]) < 1e-9)
    verdicts = [got[s]["verdict"] for _, s, a, *_ in rows if a == "attempt"]
    assert verdicts == [None, "ACCEPT", "REJECT", None, "ACCEPT", "REJECT", None]
    assert [r["reason"] for r in got.values() if r["reason"]].count("too_few_reps") == 2


def test_profile_is_the_shrunk_mahalanobis_distance():
    kept = enrolment.Memory()
    r = reps(8, 5)
    for w in r:
        kept.enroll(enrolment.matrix(w))
        kept = enrolment.Memory.of(kept.as_state())  # as between batches
    p = kept.fitted()
    x, held = np.vstack(r[:-2]), np.vstack(r[-2:])
    c = np.cov(x.T)
    c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(9)
    d = np.array([np.sqrt((v - x.mean(0)) @ np.linalg.pinv(c) @ (v - x.mean(0))) for v in held])
    assert np.isclose(p.threshold, d.mean() + 3 * d.std())
    size = lambda m: sum(len(str(v)) for v in m.as_state())
    before = size(kept)
    for w in reps(50, 6):
        kept.enroll(enrolment.matrix(w))
    assert size(kept) < 1.2 * before  # doesn't grow with the reps
    flat = enrolment.Memory()
    for _ in range(6):
        flat.enroll(np.ones((5, 9)))
    assert flat.fitted() is None


def test_reps_enrol_within_the_stream(spark, tmp_path):
    """Captured reps: quality, windows, enrolment, calibration and attempts in one stateful stream."""
    from .test_operators import KEYS, POINTER, rep

    rows = [("u", i, "enroll", *rep(seed=i)) for i in range(7)] + [("u", 7, "enroll", *rep(n=5)), ("u", 8, "calibrate", None, None), ("u", 9, "attempt", *rep(seed=20)), ("u", 10, "attempt", [(x * 60, y * 60, t) for x, y, t in rep(seed=21)[0]], rep(seed=21)[1]), ("u", 11, "attempt", *rep(pairs=1))]
    schema = f"user string, seq long, action string, pointer {POINTER}, keys {KEYS}"
    for i in range(0, len(rows), 5):
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = enrolment.run_reps(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"))
    got = {r["seq"]: r for r in events.run_to_end(stream, f"{tmp_path}/out").collect()}
    assert [got[i]["reason"] for i in range(12)] == [None] * 7 + ["too_few_touch", None, None, None, "too_few_keys"]
    assert got[7]["enroll_reps"] == 7 and got[8]["threshold"] > 0
    assert (got[9]["verdict"], got[10]["verdict"]) == ("ACCEPT", "REJECT")


def test_state_expires(spark, tmp_path):
    schema = "user string, seq long, action string, windows array<array<double>>, fault string"
    parts = [[("a", i, "enroll", w, None) for i, w in enumerate(reps(6, 1))] + [("a", 6, "calibrate", None, None)], [("a", 7, "attempt", reps(1, 2)[0], None)], [("a", 8, "enroll", reps(1, 3)[0], None)]]
    reasons = []
    for k, ttl in enumerate((0, 1500)):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{k}")
            out = f"{tmp_path}/out{k}"
            q = enrolment.run(spark.readStream.schema(schema).json(f"{tmp_path}/in{k}"), ttl).writeStream.format("json").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(once=True).start()
            assert q.awaitTermination(30)
            if i == 0:
                time.sleep(2)
        got = {r["seq"]: r for r in spark.read.schema(enrolment.OUT).json(out).collect()}
        reasons.append((got[7]["reason"], got[8]["enroll_reps"], got[6]["ok"]))
    assert reasons == [(None, 7, True), ("no_profile", 1, True)]


def test_quarantine_is_that_of_a_batch(spark, tmp_path):
    """However many files a batch has; late, equal and missing times, and a session that goes on."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(5)), i, None if rng.random() < 0.1 else int(i + rng.integers(-6, 6))) for i in range(300)]
    df = spark.createDataFrame(rows, "session long, pos long, s long").select("session", "pos", F.timestamp_seconds("s").alias("ts"), F.lit("x").alias("note"))
    want, last = {}, {}
    for session, pos, s in rows:
        want[pos] = "no_time" if s is None else "non_monotonic_time" if s <= last.get(session, -100) else None
        if s is not None:
            last[session] = max(s, last.get(session, -100))
    for i in range(0, 300, 60):
        df.filter(F.col("pos").between(i, i + 59)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for n in (1, 2, 5):
        checked = events.in_order(events.event_stream(spark, f"{tmp_path}/in", files_per_trigger=n), "session", "pos", "ts")
        good, bad = events.run_to_lanes(checked, f"{tmp_path}/out{n}")
        assert {r["pos"] for r in good.collect()} == {p for p, f in want.items() if f is None}
        assert {r["pos"]: r["fault"] for r in bad.collect()} == {p: f for p, f in want.items() if f}
        assert good.columns == df.columns
        again = events.run_to_lanes(checked, f"{tmp_path}/out{n}")
        assert again[0].count() + again[1].count() == 300


def test_pairs_of_a_rep_are_the_table_s(spark):
    """Any phases: the array step and the window give the same pairs."""
    from gaugeworks.operators import manifests
    from gaugeworks.operators import reps as rep_ops

    rng = np.random.default_rng(4)
    for _ in range(3):
        keys = [(str(rng.choice(["a", "b"])), str(rng.choice(["down", "up", "hold"])), float(i)) for i in range(60)]
        df = spark.createDataFrame([(1, c, i, p, t) for i, (c, p, t) in enumerate(keys)], "session int, code string, pos int, phase string, t double")
        table = sorted((r["up_t"], r["down_t"]) for r in manifests.key_pairs(df).collect())
        assert [(u * 1000, d * 1000) for d, u in rep_ops.completed(keys).tolist()] == table
    assert rep_ops.completed([]).shape == (0, 2)
