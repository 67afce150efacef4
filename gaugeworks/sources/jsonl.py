"""JSON lines: tolerant and strict reading, appending by key, ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifests import unseen
from .schemas import LABELS, MANIFEST, MODALITIES, PROVENANCE, SPLITS


def read_tolerant(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Rows of all whole lines; blank lines and a line that was cut off are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """All rows; a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What path holds, without broken lines; no rows if there is nothing yet."""
    try:
        return read_tolerant(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_unseen(rows: DataFrame, path: str, key: str = "sample_id") -> None:
    """Appends the rows whose key isn't at path yet, each key once. The existing side is its keys only; running it again appends nothing."""
    known = existing(rows.sparkSession, path, f"{key} {rows.schema[key].dataType.simpleString()}")
    unseen(rows, known, key).write.mode("append").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Appends ledger events as they are: repeated runs repeat them."""
    events.write.mode("append").json(path)


def events_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_tolerant(spark, path, PROVENANCE).filter(F.col("type") == kind)


def validated(rows: DataFrame, allowed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """rows; the job fails on a value outside a closed column's set. Nulls pass in attack_type and split only."""
    allowed = {"modality": MODALITIES, "label": LABELS, "split": (*SPLITS, None)} if allowed is None else allowed
    good = F.lit(True)
    for name, values in allowed.items():
        one = F.coalesce(F.col(name).isin([v for v in values if v is not None]), F.lit(None in values))
        good = good & one
    return rows.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("value outside a closed set: "), F.to_json(F.struct(*allowed)))).cast("boolean")))


def write_cells(cells: DataFrame, folder: str) -> None:
    """Sweep cells as JSON, and their summary as CSV with a header."""
    cells.write.mode("append").json(f"{folder}/cells")
    flat = [f.name for f in cells.schema if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    cells.select(*flat).write.mode("append").option("header", True).csv(f"{folder}/summary")
