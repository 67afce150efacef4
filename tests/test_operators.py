"""Hand-worked cases, edge cases and file sources."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import kernels, running, scalars
from gaugeworks.operators import features, ingest, metrics, quality, reps, splits
from gaugeworks.sources import files, jsonl, schemas

SCORED = "score double, label int, attack_type string"


def scored(spark, rows):
    return spark.createDataFrame(rows, SCORED)


def brute_eer(scores, labels):
    best, out = 1.0, 0.5
    n0, n1 = max(1, labels.count(0)), max(1, labels.count(1))
    for t in sorted(set(scores)):
        fpr = sum(s >= t and y == 0 for s, y in zip(scores, labels)) / n0
        fnr = sum(s < t and y == 1 for s, y in zip(scores, labels)) / n1
        if abs(fpr - fnr) < best:
            best, out = abs(fpr - fnr), (fpr + fnr) / 2
    return out


@pytest.mark.parametrize("seed", range(4))
def test_eer_of_ties(spark, seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 7, 200][seed]
    s, y = (rng.integers(0, 12, n) / 10).tolist(), rng.integers(0, 2, n).tolist()
    (row,) = metrics.eer(scored(spark, [(a, b, None) for a, b in zip(s, y)])).collect()
    assert row["eer"] == brute_eer(s, y)


def test_separable_and_one_class(spark):
    assert metrics.eer(scored(spark, [(0.1, 0, None), (0.2, 0, None), (0.8, 1, "p"), (0.9, 1, "p")])).first()["eer"] == 0.0
    assert metrics.eer(scored(spark, [(0.1, 0, None), (0.9, 0, None)])).first()["eer"] == brute_eer([0.1, 0.9], [0, 0])


def test_rates_by_hand(spark):
    rows = [(s, 0, None) for s in (0.2, 0.3, 0.6, 0.7)] + [(s, 1, "print") for s in (0.4, 0.4, 0.9)] + [(s, 1, "replay") for s in (0.6, 0.7, 0.8)]
    r = metrics.error_rates(scored(spark, rows), 0.5).first()
    assert (r["apcer"], r["bpcer"]) == (2 / 3, 0.5) and math.isclose(r["acer"], 7 / 12)
    by = {x["attack_type"]: x["apcer"] for x in metrics.apcer_by_species(scored(spark, rows), 0.5).collect()}
    assert by == {"print": 2 / 3, "replay": 0.0}
    only = metrics.error_rates(scored(spark, [(0.1, 0, None), (0.9, 0, None)]), 0.5).first()
    assert (only["apcer"], only["bpcer"], only["acer"]) == (0.0, 0.5, 0.25)


def test_threshold_is_the_highest_within_budget(spark):
    rows = [(s, 0, None) for s in (0.1, 0.4, 0.6, 0.9)] + [(0.3, 1, "print"), (0.5, 1, "print"), (0.7, 1, "replay")]
    r = metrics.threshold_at_apcer(scored(spark, rows), 0.5).first()
    apcer = lambda t: max((0.3 < t) / 2 + (0.5 < t) / 2, float(0.7 < t))
    candidates = sorted({s for s, *_ in rows} | {0.1 - 1, 0.9 + 1})
    assert r["threshold"] == max(t for t in candidates if apcer(t) <= 0.5)
    with pytest.raises(ValueError):
        metrics.threshold_at_apcer(scored(spark, rows), -0.1)


def test_leaks(spark):
    m = spark.createDataFrame([("00", "train"), ("00", "test"), ("01", "train"), ("02", None)], "identity string, split string")
    assert [tuple(r) for r in quality.identity_leaks(m).collect()] == [("00", 2, "test,train")]
    assert [tuple(r) for r in quality.leaking_split_pairs(m).collect()] == [("test", "train", 1, "00")]


def windows(n, k=5, overlap=0.5):
    if n < k:
        return [(1, n)] * k
    step = max(1, int(n * (1 - overlap) / (k - 1 + 1e-9)))
    return [(i * step + 1, n - step * (k - 1)) for i in range(k)]


def test_count_windows(spark):
    """The stretches of 1 to 40 rows, against a loop; many rows of one group as well."""
    sizes = [*range(1, 14), 40, 45]
    rows = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "g int, i int")
    got: dict = {}
    for r in features.count_windows(rows.repartition(3), ["g"], "i").collect():
        got.setdefault((r["g"], r["window"]), (set(), r["first"], r["size"]))[0].add(r["i"])
    assert len(got) == 5 * len(sizes)
    for n in sizes:
        step = max(int(n * 0.5 / (4 + 1e-9)), 1)
        length = n - step * 4
        for w in range(5):
            want = list(range(n)) if n < 5 else list(range(w * step, w * step + length))
            assert got[n, w] == (set(want), want[0] + 1, len(want))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_are_the_same_however_they_are_dealt(spark, by):
    """Scores piled up at 0 and 1, numbers and texts as the order, in one window or in stretches."""
    rng = np.random.default_rng(4)
    v = np.unique(np.concatenate((rng.random(300) * 1e-6, 1 - rng.random(300) * 1e-6, rng.random(20))))
    rows = [(int(i % 3), float(x), f"{x:.12f}é", int(n)) for i, (x, n) in enumerate(zip(v, rng.integers(0, 9, len(v))))]
    frame = spark.createDataFrame(rows, "g int, v double, t string, n long")
    want, sums = {}, {}
    for g, x, _, n in rows:
        want[x] = sums.get(g if by else 0, 0)
        sums[g if by else 0] = want[x] + n
    for order in ("v", "t"):
        for large in (10**6, 50):
            out = running.sums_before(frame, order, {"n": "before"}, by, large=large, stretches=8)
            assert {r["v"]: r["before"] for r in out.collect()} == want
    assert sorted(r["k"] for r in running.numbered(frame, "v", "k", large=50).collect()) == list(range(len(rows)))


def test_rates_of_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(g), float(np.round(rng.random(), 3)), int(rng.integers(0, 2)), "ab"[int(rng.integers(0, 2))]) for g in (0, 1) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g int, score double, label int, attack_type string")
    plain = [sorted(map(tuple, f.collect())) for f in (metrics.eer(frame, ["g"]), metrics.eer(frame), metrics.threshold_at_apcer(frame, 0.1, ["g"]), metrics.threshold_at_apcer(frame, 0.1))]
    monkeypatch.setattr(running, "LARGE", 20)
    monkeypatch.setattr(metrics, "LARGE", 20)
    assert plain == [sorted(map(tuple, f.collect())) for f in (metrics.eer(frame, ["g"]), metrics.eer(frame), metrics.threshold_at_apcer(frame, 0.1, ["g"]), metrics.threshold_at_apcer(frame, 0.1))]


def test_a_row_without_a_split_fails(spark):
    found = spark.createDataFrame([("a", "train"), ("b", "test")], "identity string, split string")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "identity string, n int")
    assert sorted(map(tuple, splits.with_split(rows, found, "identity").collect())) == [("a", 1, "train"), ("b", 2, "test")]
    with pytest.raises(Exception, match="no split for identity c"):
        splits.with_split(spark.createDataFrame([("c", 1)], "identity string, n int"), found, "identity").collect()


def test_guard_against_a_part_of_one_class(spark):
    rows = spark.createDataFrame([(0, "train"), (1, "train"), (0, "test"), (1, "test")], "label int, split string")
    assert splits.guarded(rows, "label", "split").count() == 4
    for bad in (rows.filter("label = 0 or split = 'train'"), rows.filter("split = 'train'")):
        with pytest.raises(Exception, match="the test part has one class"):
            splits.guarded(bad, "label", "split").collect()


POINTER = "array<struct<x: double, y: double, ts: double>>"
KEYS = "array<struct<code: string, phase: string, ts: double>>"


def rep(n=45, pairs=8, seed=0, ts0=1000.0):
    rng = np.random.default_rng(seed)
    ts = ts0 + np.cumsum(rng.integers(5, 40, n))
    pointer = [(float(a), float(b), float(t)) for a, b, t in zip(np.cumsum(rng.normal(0, 9, n)), np.cumsum(rng.normal(0, 9, n)), ts)]
    keys, t = [], ts0
    for i in range(pairs):
        t += float(rng.integers(20, 90))
        keys += [(f"K{i % 3}", "down", t), (f"K{i % 3}", "up", t + float(rng.integers(30, 120)))]
    return pointer, sorted(keys, key=lambda k: k[2])


def test_reps_to_events(spark):
    keys = [("A", "up", 5.0), ("A", "down", 10.0), ("A", "down", 20.0), ("B", "down", 25.0), ("A", "up", 40.0), ("A", "up", 41.0), ("B", "up", 60.0), ("C", "down", 70.0)]
    rows = spark.createDataFrame([("r", [(1.0, 2.0, 100.0), (3.0, 4.0, 116.0)], keys), ("none", None, None)], f"session string, pointer {POINTER}, keys {KEYS}")
    assert [(r["us"], r["x"]) for r in reps.touch(rows).orderBy("pos").collect()] == [(0, 1.0), (16000, 3.0)]
    assert [(r["phase"], r["us"]) for r in reps.keys(rows).orderBy("pos").collect()] == [("down", 0), ("up", 20000), ("down", 5000), ("up", 40000)]
    assert reps.completed(keys).tolist() == [[0.02, 0.04], [0.025, 0.06]]


def test_windows_of_reps_in_tables_and_one_by_one(spark):
    made = {f"r{i}": rep(n, pairs, i) for i, (n, pairs) in enumerate(((45, 8), (8, 2), (4, 3), (1, 0), (60, 1)))}
    rows = spark.createDataFrame([(k, *v) for k, v in made.items()], f"session string, pointer {POINTER}, keys {KEYS}")
    got = {(r["session"], r["window"]): [r[n] for n in reps.SUBSET] for r in reps.windows(reps.touch(rows), reps.keys(rows)).collect()}
    assert len(got) == 5 * len(made)
    for k, (pointer, keys) in made.items():
        path = np.array([((t - pointer[0][2]) / 1000, x, y) for x, y, t in pointer])
        assert np.allclose(reps.vectors(path, reps.completed(keys)), [got[k, w] for w in range(5)], atol=1e-9)


def test_faults_of_reps(spark):
    pointer, keys = rep()
    still = [*pointer[:5], (1.0, 1.0, pointer[4][2]), *pointer[6:]]
    odd = [*pointer[:5], (float("nan"), 1.0, pointer[5][2]), *pointer[6:]]
    cases = {"good": (pointer, keys), "few": (pointer[:7], keys), "eight": (pointer[:8], keys), "keys": (pointer, keys[:2]), "open": (pointer, [k for k in keys if k[1] == "down"]), "nan": (odd, keys), "late": (still, keys), "none": (None, None)}
    rows = spark.createDataFrame([(k, *v) for k, v in cases.items()], f"session string, pointer {POINTER}, keys {KEYS}")
    got = {r["session"]: r["reason"] for r in reps.faults(rows).collect()}
    want = {"good": None, "few": "too_few_touch", "eight": None, "keys": "too_few_keys", "open": "too_few_keys", "nan": "non_finite_touch", "late": "non_monotonic_time", "none": "too_few_touch"}
    assert got == want
    for k, (p, q) in cases.items():
        path = np.array([((t - p[0][2]) / 1000, x, y) for x, y, t in p]) if p else np.empty((0, 3))
        assert reps.fault(path, reps.completed(q or [])) == want[k]


def test_few_events_have_defined_features(spark):
    events = "session string, pos int, us long, x double, y double"
    touch = spark.createDataFrame([("one", 0, 0, 1.0, 1.0)], events)
    keys = spark.createDataFrame([], "session string, pos int, us long, phase string")
    motion = spark.createDataFrame([], "session string, pos int, us long, ax double, ay double, az double")
    sessions = spark.createDataFrame([("one",), ("none",)], "session string")
    got = {r["session"]: r for r in features.feature_vector(sessions, touch, keys, motion).collect()}
    assert got["one"]["key_paste_ratio"] == got["none"]["key_paste_ratio"] == 1.0
    assert (got["one"]["touch_without_motion_ratio"], got["none"]["touch_without_motion_ratio"]) == (1.0, 0.0)
    assert all(got["one"][f] == 0.0 for f in features.FEATURES if f not in ("key_paste_ratio", "touch_without_motion_ratio"))


def test_duration(spark):
    rows = spark.createDataFrame([("Duration: 01:02:03.50, x",), ("none",)], "t string")
    assert [r[0] for r in rows.select(scalars.duration_seconds("t", 1.0)).collect()] == [3723.5, 1.0]


# --- files ---


def test_tolerant_strict_and_append(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"sample_id": "a", "seed": 4294967295, "attack_params": {"dpi": 300, "w": [1]}}\n\n{"sample_id": "b", "seed": 1}\n{"sample_id": "c", "se')
    rows = jsonl.read_tolerant(spark, str(path)).selectExpr("sample_id", "seed", "variant_get(attack_params, '$.dpi', 'int') AS dpi").collect()
    assert [tuple(r) for r in rows] == [("a", 4294967295, 300), ("b", 1, None)]
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(path)).select("sample_id", "seed").collect()
    out = f"{tmp_path}/out"
    new = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "sample_id string, seed long")
    jsonl.append_unseen(new, out)
    jsonl.append_unseen(new.union(spark.createDataFrame([("z", 9)], new.schema)), out)
    assert sorted(r["sample_id"] for r in spark.read.json(out).collect()) == ["a", "b", "z"]


def test_ledger_repeats(spark, tmp_path):
    e = spark.createDataFrame([("generator_registered", "g")], "type string, name string")
    for _ in range(2):
        jsonl.append_events(e, f"{tmp_path}/l")
    assert jsonl.events_of(spark, f"{tmp_path}/l", "generator_registered").count() == 2
    assert jsonl.events_of(spark, f"{tmp_path}/l", "ontology_citation").count() == 0


def test_closed_sets(spark):
    schema = "modality string, label string, split string"
    good = spark.createDataFrame([("face", "attack", None), ("voice", "bonafide", "dev")], schema)
    assert jsonl.validated(good).count() == 2
    for bad in (("face", "other", "dev"), ("face", None, "dev"), ("face", "attack", "else")):
        with pytest.raises(Exception, match="closed set"):
            jsonl.validated(spark.createDataFrame([bad], schema)).collect()


def test_cells(spark, tmp_path):
    cells = spark.createDataFrame([("L1", 0.5, {"print": 0.1})], "capacity string, eer double, apcer_per_pai map<string, double>")
    jsonl.write_cells(cells, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary").first().asDict() == {"capacity": "L1", "eer": "0.5"}
    assert spark.read.schema(schemas.SWEEP_CELL).json(f"{tmp_path}/cells").first()["apcer_per_pai"] == {"print": 0.1}


def test_trees_of_pictures(spark, tmp_path):
    for rel in ("bonafide/s1/0.png", "bonafide/s2/0.PNG", "attack/print/s1/0.jpg", "attack/replay/s3/1.jpeg", "attack/print/readme.txt", "other/x.png"):
        p = tmp_path / "set" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    root = f"{tmp_path}/set"
    rows = sorted((r["rel"], r["label"], r["attack_type"]) for r in files.labelled_images(spark, root).collect())
    assert rows == [("attack/print/s1/0.jpg", 1, "print"), ("attack/replay/s3/1.jpeg", 1, "replay"), ("bonafide/s1/0.png", 0, None), ("bonafide/s2/0.PNG", 0, None)]
    manifest = spark.createDataFrame([("1", "attack/print/s1/0.jpg", "old", {"id": "s0"}), ("2", "attack/print/s1/0.jpg", "print", {"id": "s1"})], "sample_id string, output_path string, attack_type string, bonafide_source struct<id: string>")
    got = {r["rel"]: (r["attack_type"], r["subject"]) for r in files.labelled_images(spark, root, manifest).collect()}
    assert got["attack/print/s1/0.jpg"] == ("print", "s1") and got["bonafide/s1/0.png"] == (None, None)
    (tmp_path / "ids.txt").write_text("s1\n\n")
    ids = files.identity_list(spark, f"{tmp_path}/ids.txt")
    assert [r["rel"] for r in files.identity_images(spark, f"{root}/bonafide", ids).select("rel").collect()] == ["s1/0.png"]


def test_payloads(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text(json.dumps({"session_id": "x", "label": "bot", "touch": [{"t": 0.1, "x": 1, "y": 2, "phase": "move"}]}))
    manifest = spark.createDataFrame([("x", "p/x.json"), ("y", "p/missing.json")], "session_id string, payload_path string")
    (row,) = files.session_payloads(spark, manifest, str(tmp_path)).collect()
    assert row["s"]["label"] == "bot" and row["s"]["touch"][0]["x"] == 1.0 and len(row["sha256"]) == 64


def test_label_files(spark, tmp_path):
    long = lambda code: [0] * 40 + [code]
    (tmp_path / "l.json").write_text(json.dumps({"a/b/s1/1.png": long(1), "a/b/s2/2.png": long(5)}))
    (tmp_path / "l.txt").write_text("\n".join(f"{p} {' '.join(map(str, long(c)))}" for p, c in (("a/b/s1/1.png", 7), ("a/b/s3/3.png", 0))) + "\n")
    classes = {0: "bonafide", 1: "print", 7: "replay"}
    got = {r["path"]: r["class"] for r in files.spoof_labels(spark, f"{tmp_path}/l.json", f"{tmp_path}/l.txt", classes).collect()}
    assert got == {"a/b/s1/1.png": "print", "a/b/s3/3.png": "bonafide"}
    (tmp_path / "short.json").write_text(json.dumps({"a": [1]}))
    with pytest.raises(Exception, match="too few labels"):
        files.spoof_labels(spark, f"{tmp_path}/short.json", None, classes).collect()


def test_subject_of_path(spark):
    rows = spark.createDataFrame([("a/b/c/d.png",)], "p string")
    assert rows.select(files.subject_of(rows["p"])).first()[0] == "c"
    with pytest.raises(Exception, match="no subject"):
        short = spark.createDataFrame([("a/b",)], "p string")
        short.select(files.subject_of(short["p"])).collect()


def test_ingest_run(spark):
    """Two runs over pictures: the first takes the good ones within the cap, the second finds them there."""
    rng = np.random.default_rng(1)
    picture = lambda h, w: bytearray(rng.integers(0, 256, (h, w, 3), dtype=np.uint8).tobytes())
    rows = [("print", f"p/{i}.png", picture(20, 30), 20, 30) for i in range(4)] + [("mask", "m/0.png", picture(9, 9), 9, 9), ("mask", "m/1.png", bytearray(9 * 9 * 3), 9, 9), ("mask", "m/2.png", bytearray(b"x"), 9, 9), ("mask", "m/3.png", None, 9, 9)]
    pictures = spark.createDataFrame(rows, "class string, rel string, pixels binary, height int, width int")
    plan = ingest.planned(pictures, "class", "rel", F.lit("real"), cap=3)
    assert sorted(r["sample_id"] for r in plan.collect()) == [f"real-{c}-{i:08d}" for c in ("mask", "print") for i in range(3)]
    none = plan.limit(0)
    first = ingest.staged(ingest.marked(plan, none), 8)
    assert sorted(map(tuple, ingest.counted(first, "class").collect())) == [("mask", 1, 0, 2), ("print", 3, 0, 0)]
    assert {r["rel"]: r["fault"] for r in first.filter("class = 'mask'").collect()} == {"m/0.png": None, "m/1.png": "low_variance", "m/2.png": "bad_shape"}
    assert all((r["staged"] is None) == (r["fault"] is not None) and len(r["staged"] or bytes(192)) == 192 for r in first.collect())
    (told,) = ingest.event(first, "rel", "bonafide_dataset_ingested", "n", "CC0", "u").collect()
    assert told["sha256_of_index"] == hashlib.sha256("|".join(sorted(r["rel"] for r in plan.collect())).encode()).hexdigest()
    second = ingest.staged(ingest.marked(plan, first.filter("fault is null")), 8)
    assert sorted(map(tuple, ingest.counted(second, "class").collect())) == [("mask", 0, 1, 2), ("print", 0, 3, 0)]
    assert ingest.event(second, "rel", "bonafide_dataset_ingested", "n", "CC0", "u").collect() == []


def test_resizing_keeps_constants_and_averages():
    flat = np.full((7, 5, 3), 93, np.uint8)
    assert (kernels.resized(flat, 12, 3) == 93).all()
    ramp = np.tile(np.linspace(0, 255, 64)[None, :, None], (64, 1, 3)).astype(np.uint8)
    half = kernels.resized(ramp, 16, 16)
    assert half.shape == (16, 16, 3) and abs(float(half.mean()) - float(ramp.mean())) < 1
    assert np.abs(half[8, 2:-2, 0].astype(float) - ramp.reshape(16, 4, 16, 4, 3).mean(axis=(1, 3))[8, 2:-2, 0]).max() < 2


def test_real_files_and_chosen_subjects(spark):
    meta = spark.createDataFrame([("a", "REAL"), ("b", "FAKE"), ("gone", "REAL")], "name string, label string")
    assert [r["name"] for r in ingest.real_only(meta, spark.createDataFrame([("a",), ("b",), ("other",)], "name string")).collect()] == ["a"]
    rows = spark.range(300).selectExpr("id % 30 AS subject", "id")
    one, two = ({r["subject"] for r in ingest.chosen_subjects(x, "subject", 7, 3).collect()} for x in (rows, rows.repartition(5)))
    assert one == two and len(one) == 7
    assert one != {r["subject"] for r in ingest.chosen_subjects(rows, "subject", 7, 4).collect()}


def test_places_are_rounded_as_in_duckdb(spark, tables):
    """Means of whole microseconds that lie between two of them; DuckDB rounds x * 1e6."""
    from gaugeworks.plans.catalogue import r6

    ends = [280069.5, 281818.5, 260006.5, 129363.5, -129363.5, 0.5, 2.0, 1e9 + 0.5]
    values = [e / 1e6 for e in ends] + [None, float("nan")]
    theirs = [tables.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values[:-1]]
    rows = r6(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "v").orderBy("i").collect()
    assert [r["v"] for r in rows[:-1]] == theirs and np.isnan(rows[-1]["v"])


def test_equal_numbers_have_no_correlation_however_they_are_dealt(spark):
    """Moments of the parts of a group, joined, may have a variance of 1e-17 where there is none."""
    df = spark.range(59 * 2000).select(F.expr("id div 59").alias("s"), F.expr("9.2D + (id div 59) / 100000D").alias("x"), F.expr("double(7 * id % 11)").alias("y")).repartition(13)
    found = df.groupBy("s").agg(scalars.correlation("x", "y").alias("a"), scalars.correlation("y", "x").alias("b")).collect()
    assert len(found) == 2000 and all(r["a"] == 0.0 and r["b"] == 0.0 for r in found)


def test_means_of_times_are_sums_in_order(spark):
    """The sum of times one after the other, also where parts of a group are joined, as where a task spills."""
    flights = {s: [((7919 * (25 * s + i)) % 320_011 + 80_000) / 1e6 for i in range(24)] for s in range(200)}
    rows = spark.createDataFrame([(s, i, v) for s, vs in flights.items() for i, v in enumerate(vs)], "session int, i int, flight double")
    dealt = rows.repartition(5).withColumn("_flight", features._upto("flight", "i")).repartition(7)
    found = {r["session"]: r["m"] for r in dealt.groupBy("session").agg(features._mean("flight", "_flight", "i").alias("m")).collect()}
    expected = {}
    for s, vs in flights.items():
        total = 0.0
        for v in vs:  # sum() is more exact
            total += v
        expected[s] = total / len(vs)
    assert found == expected
