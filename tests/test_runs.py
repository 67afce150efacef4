"""Runs that write: two-phase sinks, ingests, checks of parameters and ledgers."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import generate, ingest, quality
from gaugeworks.sources import payloads


def tree(root):
    return sorted(os.path.join(d, f)[len(str(root)) + 1 :] for d, _, files in os.walk(root) for f in files if not f.startswith("."))


def sample(spark, n=40):
    return spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") != 3, F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8")).alias("payload")).repartition(4)


def test_each_payload_once(spark, tmp_path):
    rows, root = sample(spark), f"file://{tmp_path}"
    payloads.append_payloads(rows.filter("key % 2 = 0").unionByName(rows.filter("key = 4")), root, "key")
    got = payloads.with_files(payloads.append_payloads(rows, root, "key"), root).collect()
    assert sorted(r["key"] for r in got) == list(range(40))
    assert [tuple(r) for r in got if not (r["file_bytes"] == r["payload_bytes"] == (0 if r["key"] == 3 else r["key"]) and r["file_sha256"] == r["payload_sha256"])] == []
    files = tree(tmp_path / "payloads")
    assert len(files) == 40
    payloads.append_payloads(rows, root, "key")
    assert tree(tmp_path / "payloads") == files
    assert payloads.swept(root) == []
    assert tree(tmp_path / "payloads") == files


def test_failed_attempts_leave_nothing(spark, tmp_path):
    """A task that fails after it has written some, and a job that fails for good."""
    root, flag = f"file://{tmp_path}/out", str(tmp_path / "flag")

    def breaks(always):
        def run(batches):
            for b in batches:
                yield b.slice(0, b.num_rows // 2)
                if any(k == 7 for k in b.column(0).to_pylist()) and (always or not os.path.exists(flag)):
                    open(flag, "w").close()
                    raise ValueError("lost")
                yield b.slice(b.num_rows // 2)

        return run

    rows = sample(spark)
    with pytest.raises(Exception, match="lost"):
        payloads.write_payloads(rows.mapInArrow(breaks(True), rows.schema), root)
    assert payloads.manifest(spark, root, rows.drop("payload").schema).count() == 0
    time.sleep(1)  # tasks of the lost job may still be ending
    payloads.append_payloads(rows, root, "key")
    payloads.swept(root)
    assert len(tree(tmp_path / "out" / "payloads")) == 40
    assert payloads.swept(root) == []


def test_attempts_that_spark_did_not_take_are_deleted(tmp_path):
    """Two attempts of one task, one of them taken: by the writer's own phases."""
    w = payloads.PayloadWriter(f"file://{tmp_path}", "name", "payload")
    for attempt in ("a", "b"):
        for folder, name in ((f"payloads/{w.job}/{attempt}", "f1"), (f"_staged/{w.job}", f"{attempt}.json")):
            os.makedirs(tmp_path / folder, exist_ok=True)
            (tmp_path / folder / name).write_text(json.dumps({"key": 1}))
    w.commit([payloads.Written("b", 1), payloads.Written("empty", 0), None])
    assert tree(tmp_path) == [f"manifest/{w.job}/b.json", f"payloads/{w.job}/b/f1"]
    w.abort([])  # after all: a job that is told to give up
    assert tree(tmp_path / "payloads") == []


def test_empty_input_and_columns_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert payloads.append_payloads(sample(spark, 0), root, "key").count() == 0
    rows = spark.createDataFrame([(1, "n1", bytearray(b"\x00\xff"), ["é"], None)], "key long, name string, payload binary, tags array<string>, note string")
    r = payloads.append_payloads(rows, root, "key").collect()[0]
    assert (r["tags"], r["note"], r["payload_bytes"]) == (["é"], None, 2)


def test_ingest_run(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(f"s{i}", "print" if i % 2 else "mask", f"s{i}.bin", bytearray(b"x" * i), "dark" if i in (4, 5) else None) for i in range(10)] + [("z", "other", "z.bin", bytearray(), None), ("n", None, "n.bin", bytearray(), None)]
    plan = spark.createDataFrame(rows, "sample_id string, kind string, name string, payload binary, fault string")
    about = ("kind", ("mask", "print", "replay"), "real_attack_dataset_ingested", "d", "CC0", "http://h", f"{root}/ledger")
    found, counts = ingest.run(plan.filter("sample_id < 's3'"), root, *about)
    assert {r["kind"]: tuple(r)[1:] for r in counts.collect()} == {"mask": (2, 0, 0), "print": (1, 0, 0), None: (1, 0, 0)}
    found, counts = ingest.run(plan, root, *about)
    assert {r["kind"]: tuple(r)[1:] for r in counts.collect()} == {"mask": (2, 2, 1), "print": (3, 1, 1), None: (1, 1, 0)}
    assert found.count() == 10
    ingest.run(plan, root, *about)  # writes nothing, so no event
    events = spark.read.json(f"{root}/ledger").collect()
    assert len(events) == 2 and len({r["sha256_of_index"] for r in events}) == 2


def test_a_run_reads_its_plan_once(spark, tmp_path):
    """Counts come from the job that writes."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    plan = sample(spark).withColumns({"sample_id": F.col("name"), "kind": F.lit("print"), "fault": F.lit(None).cast("string")}).drop("key")
    ingest.run(plan.mapInArrow(count, plan.schema), f"file://{tmp_path}", "kind", ("print",), "t", "d", "CC0", "http://h")
    assert seen.value == 40


def test_parameter_faults(spark):
    axes = generate.axes_table(spark, [{"version": 1, "attack_type": "print", "axes": {"dpi": {"type": "uniform", "low": 100, "high": 300}, "paper": {"type": "categorical", "values": ["matte", 5, True], "weights": [1, 1, 1]}}}, {"version": 1, "attack_type": "none", "axes": {}}])
    cases = {
        '{"dpi": 150, "paper": "matte"}': {}, '{"dpi": 100.0, "paper": 5}': {}, '{"dpi": 3e2, "paper": true}': {}, "{}": {"dpi": "missing", "paper": "missing"}, None: {"dpi": "missing", "paper": "missing"},
        "not json": {"dpi": "missing", "paper": "missing"}, "[1]": {"dpi": "missing", "paper": "missing"}, '{"dpi": "150", "paper": {}}': {"dpi": "wrong_type", "paper": "wrong_type"}, '{"dpi": null, "paper": null}': {"dpi": "wrong_type", "paper": "wrong_type"},
        '{"dpi": 99.9, "paper": "gloss"}': {"dpi": "outside_range", "paper": "outside_values"}, '{"dpi": true, "paper": 6, "x": {"y": 1}}': {"dpi": "wrong_type", "paper": "outside_values", "x": "extra"},
    }
    rows = spark.createDataFrame([(i, "print", c) for i, c in enumerate(cases)] + [(98, "none", '{"a": 1}'), (99, "unheard", '{"a": 1}')], "id int, kind string, p string").withColumn("p", F.try_parse_json("p"))
    got: dict = {}
    for r in generate.parameter_faults(rows, "id", "kind", "p", axes).collect():
        assert (r["id"], r["axis"]) not in got
        got[r["id"], r["axis"]] = r["fault"]
    assert got == {(i, a): f for i, c in enumerate(cases.values()) for a, f in c.items()} | {(98, "a"): "extra", (99, "a"): "extra"}


def test_ledger_faults(spark):
    """Each type right, and each with one fault at a time."""
    sha, when = "a" * 64, "2024-05-01T00:00:00"
    good = {
        "bonafide_dataset_ingested": {"name": "n", "license": "l", "source_url": "http://h/x", "sha256_of_index": sha, "ingested_at": when},
        "real_attack_dataset_ingested": {"name": "n", "license": "l", "source_url": "https://h", "sha256_of_index": sha, "attack_types": ["print"]},
        "generator_registered": {"name": "n", "version": "1", "license": "l", "commercial_ok": False, "model_hash": "h", "registered_at": when},
        "ontology_citation": {"attack_type": "t", "axis": "a", "paper": "p", "url": "http://h"},
        "dfdc_bonafide_dataset_ingested": {"license": "l", "source_url": "http://h", "n_chunks": 0, "n_videos": 2, "n_frames_written": 3, "detection_rate": 1.0, "real_filenames_sha256": sha},
    }
    bad = {"name": " ", "license": "", "source_url": "h", "sha256_of_index": "A" * 64, "ingested_at": "soon", "attack_types": [], "version": "", "model_hash": "\t", "registered_at": "x", "attack_type": "", "axis": "", "paper": "", "url": "ftp://h", "n_chunks": -1, "n_videos": -2, "n_frames_written": -3, "detection_rate": 1.01, "real_filenames_sha256": "b"}
    rows, want = [], set()
    add = lambda e: (rows.append(e | {"id": len(rows)}), len(rows) - 1)[1]
    for kind, fields in good.items():
        add({"type": kind} | fields)
        for f in fields:
            i = add({"type": kind} | {k: v for k, v in fields.items() if k != f})
            if f not in ("ingested_at", "registered_at", "url"):
                want.add((i, f, "missing"))
            if f in bad:
                want.add((add({"type": kind} | fields | {f: bad[f]}), f, "wrong_kind"))
        other = next(f for f in ("doi", "version") if f not in fields and kind != "ontology_citation" or f == "version")
        want.add((add({"type": kind} | fields | {other: "1"}), other, "unexpected") if other not in fields else (len(rows), other, "none"))
    want = {w for w in want if w[2] != "none"}
    want |= {(add({"type": None, "name": "n"}), "type", "unknown_type"), (add({"type": "x"}), "type", "unknown_type")}
    schema = "id int, type string, name string, license string, source_url string, sha256_of_index string, ingested_at string, attack_types array<string>, version string, commercial_ok boolean, model_hash string, registered_at string, attack_type string, axis string, paper string, doi string, url string, n_chunks long, n_videos long, n_frames_written long, detection_rate double, real_filenames_sha256 string"
    names = [c.strip().split()[0] for c in schema.split(",")]
    found = quality.ledger_faults(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema), "id").collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_grid_goes_on_and_writes_each_cell_once(spark, tmp_path):
    from gaugeworks.operators import metrics, sweeps

    rows = spark.range(600).select((F.col("id") % 4).cast("int").alias("a"), F.concat(F.lit("l"), F.col("id") % 2).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, F.lit("print")).alias("attack_type"), (F.col("id") * 37 % 101 / 101).alias("score"))
    grid, root = rows.select("a", "b").distinct().unionByName(spark.createDataFrame([(9, "none")], "a int, b string")), f"file://{tmp_path}/grid"
    assert sweeps.run_grid(rows, grid.filter("a < 2"), root, ["a", "b"]).count() == 2
    first = {f: os.stat(tmp_path / "grid" / f).st_mtime_ns for f in tree(tmp_path / "grid") if f.endswith(".parquet")}
    out = sweeps.run_grid(rows, grid, root, ["a", "b"])
    want = {(r["a"], r["b"]): (r["eer"], r["threshold"]) for r in metrics.eer(rows, ["a", "b"]).collect()}
    assert {(r["a"], r["b"]): (r["eer"], r["threshold"]) for r in out.collect()} == want and out.count() == 4
    assert all(os.stat(tmp_path / "grid" / f).st_mtime_ns == t for f, t in first.items())  # finished cells aren't touched
    assert sweeps.run_grid(rows, grid, root, ["a", "b"]).count() == 4


def test_nested_curve_is_that_of_each_subset(spark):
    import hashlib

    from gaugeworks.operators import metrics, sweeps

    rows = [(i, int(i % 3 == 0), ("print", "mask")[i % 2] if i % 3 == 0 else None, (i * 37 % 50) / 50) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, label int, attack_type string, score double")
    got = {r["n_real"]: r for r in sweeps.nested_curve(df, "k", [10, 60, 200, 201], 5).collect()}
    order = sorted(rows, key=lambda r: hashlib.sha256(f"5|{r[0]}".encode()).hexdigest())
    for n in (10, 60, 200):
        part = spark.createDataFrame(order[:n], df.schema)
        one, rates = metrics.eer(part).first(), metrics.error_rates(part, 0.5).first()
        assert (got[n]["eer"], got[n]["threshold"], got[n]["skipped"]) == (one["eer"], one["threshold"], False)
        assert abs(got[n]["acer"] - rates["acer"]) < 1e-9 and abs(got[n]["apcer"] - rates["apcer"]) < 1e-9
    assert got[201]["skipped"] and got[201]["eer"] is None
    empty = sweeps.nested_curve(df.limit(0), "k", [5], 5).collect()
    assert [(r["n_real"], r["skipped"]) for r in empty] == [(5, True)]


def test_a_large_group_of_a_plan_is_numbered_in_stretches(spark, monkeypatch):
    """Places as by one window over each group, null among them, without any task that holds a group."""
    from gaugeworks.operators import ingest

    monkeypatch.setattr(ingest, "PLAN_ROWS", 20)
    rows = [(None if i % 5 == 0 else "a" if i % 5 < 4 else "b", (i * 7919) % 100_003, f"payload {i}") for i in range(400)]
    plan = ingest.planned(spark.createDataFrame(rows, "class string, id int, payload string"), "class", "id", F.lit("real"))
    want, seen = {}, {}
    for c, i, p in sorted(rows, key=lambda r: r[1]):
        want[i] = (c, seen.setdefault(c, 0), p)
        seen[c] += 1
    assert {r["id"]: (r["class"], r["place"], r["payload"]) for r in plan.collect()} == want
    assert dict(plan.dtypes)["place"] == "int"
    windows = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Window " in x and "payload" not in x.split("Window ")[0]]
    assert windows and all("_part#" in x for x in windows)


def test_few_suppliers_make_pictures_in_several_tasks(spark):
    from gaugeworks.plans import catalogue

    assert catalogue.kernel_pictures(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 4  # of 300 of its 1,000 suppliers each


def test_nested_subsets_of_repeated_keys_do_not_depend_on_how_rows_are_dealt(spark):
    from gaugeworks.operators import sweeps

    rows = [(f"k{i // 4}", i % 2, (i * 37 % 100) / 100, "p" if i % 2 else None) for i in range(120)]
    found = []
    for given in (rows, rows[::-1], rows[1::2] + rows[::2]):
        pool = spark.createDataFrame(given, "key string, label int, score double, attack_type string").coalesce(1)
        found.append(sorted(map(tuple, sweeps.nested_curve(pool, "key", (10, 49, 50, 51, 1000), 7).collect())))
    assert found[0] == found[1] == found[2]


def test_a_curve_orders_only_rows_where_a_size_ends(spark, monkeypatch):
    """Nothing as long as the pool is stored, also with a key of very many rows; counts are those of the whole order."""
    import hashlib
    import json

    from gaugeworks.operators import metrics, sweeps

    rows = [(f"k{i if i % 4 else 0}", i % 2, (i * 37 % 50) / 50, "p" if i % 2 else None) for i in range(20_000)]
    pool = spark.createDataFrame(rows, "key string, label int, score double, attack_type string")
    stored, kept = [], sweeps.kept
    monkeypatch.setattr(sweeps, "DIGITS", 2, raising=False)
    monkeypatch.setattr(sweeps, "kept", lambda df, what: stored.append(kept(df, what)) or stored[-1])
    text = lambda r: json.dumps([str(r[1]), str(r[2]), r[3]], separators=(",", ":"))
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"7|{r[0]}".encode()).hexdigest(), text(r)))
    many = next(i for i, r in enumerate(order) if r[0] == "k0")  # the first of 5,000 of one key
    sizes = [0, 30, many, many + 1, many + 2500, many + 5000, 20_000, 20_001]
    got = {r["n_real"]: r for r in sweeps.nested_curve(pool, "key", sizes, 7).collect()}
    assert len(got) == len(sizes) and max(df.count() for df in stored) < 5_000
    assert got[0]["eer"] is None and got[20_001]["skipped"]
    for n in sizes[1:-1]:
        part = spark.createDataFrame(order[:n], pool.schema)
        one, rates = metrics.eer(part).first(), metrics.error_rates(part, 0.5).first()
        assert (got[n]["eer"], got[n]["threshold"]) == (one["eer"], one["threshold"])
        assert abs(got[n]["bpcer"] - rates["bpcer"]) < 1e-9 and abs(got[n]["apcer"] - rates["apcer"]) < 1e-9
