"""Table functions against the DataFrame functions and a plain loop."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugeworks.functions import running, tables
from gaugeworks.operators import manifests
from gaugeworks.plans import runs
from gaugeworks.plans.catalogue import SQL

EVENTS = "session string, code string, pos int, phase string, t long, CODE_ string"


def paired(events):
    """(session, code, pos, down, up) by a loop."""
    last, out = {}, []
    for s, c, pos, phase, t in sorted(events, key=lambda e: e[2]):
        before = last.get((s, c))
        last[s, c] = phase, t
        if phase == "up" and before and before[0] == "down":
            out.append((s, c, pos, before[1], t))
    return out


def test_key_pairs(spark):
    rng = random.Random(3)
    events = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", "", None]), i, rng.choice(["down", "up", "up", "hold", None]), 2**60 + rng.randrange(9)) for i in range(600)]
    frame = spark.createDataFrame([(*e, "own") for e in events], EVENTS).repartition(5)
    tables.register(spark)
    got = spark.sql("SELECT * FROM key_pairs(TABLE({e}))", e=frame)
    assert got.columns == ["session", "code", "pos", "down_t", "up_t"]
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: r[2])
    assert order(got.collect()) == order(paired(events)) == order(manifests.key_pairs(frame).collect())
    assert spark.sql("SELECT * FROM key_pairs(TABLE({e}))", e=frame.filter("false")).collect() == []


def test_key_pairs_needs_its_columns(spark):
    tables.register(spark)
    with pytest.raises(AnalysisException, match="lacks code"):
        spark.sql("SELECT * FROM key_pairs(TABLE({e}))", e=spark.range(3).withColumnRenamed("id", "session")).collect()


def test_work_items(spark):
    ids = spark.createDataFrame([("n\u00e9", 4), ("a", 9), (None, 2), ("a", 9)], "name string, place_ long")
    tables.register(spark)
    got = spark.sql("SELECT * FROM work_items(TABLE({p}), 40, 'voice', {w}, 7)", p=manifests.placed(ids, "name", "place_"), w='{"b": 1, "a": 3, "c": 0.5}')
    want = manifests.work_items(ids, "name", "place_", 40, "voice", (("b", 1), ("a", 3), ("c", 0.5)), 7)
    by = lambda df: sorted(map(tuple, df.select(*want.columns).collect()), key=lambda r: r[3])
    assert got.schema.names == want.schema.names and by(got) == by(want) and len(by(got)) == 120
    assert {r[5] for r in by(got)} == {"a", "b", "c"}


@pytest.mark.parametrize("attacks", ["[]", "{}", '{"a": 0}', '{"a": -1}'])
def test_work_items_refuses_weights(spark, attacks):
    tables.register(spark)
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM work_items(TABLE({p}), 1, 'voice', {w}, 7)", p=spark.createDataFrame([("a", 0)], "identity string, place long"), w=attacks).collect()


def test_queries(spark, sf, same):
    for name in ("table_function_key_pairs", "table_function_work_items"):
        same(getattr(runs, name)(spark, sf), SQL[name])


def test_cuts_below(spark):
    """The two-step search for a place among cuts, for every number of cuts."""
    for n in (*range(12), 100, 1000):
        cuts = sorted({7 * i % (3 * n + 1) for i in range(n)})
        got = spark.range(-1, 3 * n + 3).select("id", running._cuts_below(F.col("id"), cuts).alias("at")).collect()
        assert [r["at"] for r in got] == [sum(c < r["id"] for c in cuts) for r in got]
