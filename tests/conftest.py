"""One local session for all tests; the shared folder and Spark's own files go to a folder of this run."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # of the Python workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.local.dir": folder, "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(sf):
    """DuckDB with the tables as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def same(tables):
    """Asserts that a DataFrame has the columns and rows that DuckDB returns."""

    def check(df, sql):
        found = tables.execute(sql)
        names = sorted(c[0] for c in found.description)
        assert sorted(df.columns) == names
        order = [next(i for i, c in enumerate(found.description) if c[0] == n) for n in names]
        theirs = sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
        ours = sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
        assert len(ours) == len(theirs)
        for a, b in zip(ours, theirs, strict=True):
            assert a == b

    return check


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v
