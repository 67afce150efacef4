"""Ingest runs over listed pictures: which to take, which are there already, what quality control says, what was written, and the licence event of the run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.frames import with_fields
from ..functions.kernels import quality_fault, resized
from ..functions.running import sums_before
from ..functions.scalars import sample_id
from ..sources import jsonl, payloads
from .quality import index_fingerprint

#: Rows of a group, with their payloads, that one task numbers.
PLAN_ROWS = 20_000


def planned(files: DataFrame, group: str, order: str, prefix: Column, cap: int | None = None) -> DataFrame:
    """files with place (from 0 in order within the group) and sample_id; with a cap, the first of each group only, which is the feature. `order` is a number or a text. A large group is numbered in stretches, as its rows with their payloads are too much for one task. files is read several times."""
    numbered = sums_before(files.withColumn("_one", F.lit(1)), order, {"_one": "place"}, [group], PLAN_ROWS).drop("_one").withColumn("place", F.col("place").cast("int"))
    taken = numbered if cap is None else numbered.filter(F.col("place") < cap)
    return taken.withColumn("sample_id", sample_id(prefix, F.col(group), F.col("place")))


def marked(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """plan with known: whether its sample_id is among existing ones."""
    known = existing.select("sample_id").distinct().withColumn("known", F.lit(True))
    return plan.join(known, "sample_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def staged(pictures: DataFrame, size: int) -> DataFrame:
    """pictures (pixels binary of 8-bit RGB, height, width) with staged, the pixels at size x size, and fault: what makes a picture unfit, null for good ones."""

    def one(pixels: bytes | None, h: int, w: int) -> tuple[bytes | None, str | None]:
        if pixels is None or h < 1 or w < 1 or len(pixels) != h * w * 3:
            return None, "bad_shape"
        out = resized(np.frombuffer(pixels, np.uint8).reshape(h, w, 3), size, size)
        told = quality_fault(out, size, size)
        return (None if told else out.tobytes()), told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(*(x.as_py() for x in row)) for row in zip(*(b.column(c) for c in ("pixels", "height", "width")), strict=True)]
            yield b.append_column("staged", pa.array([m[0] for m in made], pa.binary())).append_column("fault", pa.array([m[1] for m in made], pa.string()))

    return pictures.mapInArrow(run, with_fields(pictures, staged="binary", fault="string"))


def counted(done: DataFrame, group: str) -> DataFrame:
    """(group, written, known, faulty) of rows with known and fault; faulty ones aren't written, and are tried again by a later run."""
    fresh = ~F.col("known")
    return done.groupBy(group).agg(F.count_if(fresh & F.col("fault").isNull()).alias("written"), F.count_if("known").alias("known"), F.count_if(fresh & F.col("fault").isNotNull()).alias("faulty"))


def observed(done: DataFrame, group: str, groups: Sequence[str], counters: Observation) -> DataFrame:
    """done, which counts as it passes by: in the job that writes it, `counters` gets written, known and faulty of each of `groups`, a closed list, and of all others together. So a run isn't read again for its counts."""
    fresh, at = ~F.col("known"), F.col(group)
    kinds = {"written": fresh & F.col("fault").isNull(), "known": F.col("known"), "faulty": fresh & F.col("fault").isNotNull()}
    of = [(str(i), at == g) for i, g in enumerate(groups)] + [("other", F.coalesce(~at.isin(list(groups)), F.lit(True)))]
    return done.observe(counters, *[F.count_if(here & is_).alias(f"{kind}:{i}") for i, here in of for kind, is_ in kinds.items()])


def counters_of(spark: SparkSession, counters: Observation, group: str, groups: Sequence[str]) -> DataFrame:
    """(group, written, known, faulty) of a job that has ended; a group without rows is left out, others are one row without a name."""
    told = counters.get
    rows = [(g, *(told[f"{kind}:{i}"] for kind in ("written", "known", "faulty"))) for i, g in [*((str(i), g) for i, g in enumerate(groups)), ("other", None)]]
    return spark.createDataFrame([r for r in rows if any(r[1:])], f"`{group}` string, written long, known long, faulty long")


def run(plan: DataFrame, root: str, group: str, groups: Sequence[str], kind: str, name: str, licence: str, source_url: str, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """An ingest from a plan (sample_id, the group, name, payload, fault and further columns) to payload files and their manifest below root: what is there already is passed over, faulty rows aren't written and are tried again by a later run. Returns the manifest and the run's counts.

    One job reads the plan, writes and counts. A run that wrote something appends its licence event to the ledger."""
    spark = plan.sparkSession
    rest = StructType([f for f in plan.schema if f.name not in ("payload", "fault")])
    counters = Observation()
    done = observed(marked(plan, payloads.manifest(spark, root, rest)), group, groups, counters)
    payloads.write_payloads(done.filter(~F.col("known") & F.col("fault").isNull()).select(*rest.names, "payload"), root)
    counts, now = counters_of(spark, counters, group, groups), payloads.manifest(spark, root, rest)
    if ledger and counts.agg(F.sum("written")).first()[0]:
        named = [F.lit(v).alias(k) for k, v in (("type", kind), ("name", name), ("license", licence), ("source_url", source_url))]
        jsonl.append_events(index_fingerprint(now, "sample_id").select(*named, F.col("fingerprint").alias("sha256_of_index")), ledger)
    return now, counts


def event(done: DataFrame, index: str, kind: str, name: str, licence: str, source_url: str) -> DataFrame:
    """The ledger's row of a run, with the fingerprint of the index column; no row if the run wrote nothing."""
    wrote = done.agg(F.coalesce(F.bool_or(~F.col("known") & F.col("fault").isNull()), F.lit(False)).alias("wrote"))
    named = [F.lit(v).alias(k) for k, v in (("type", kind), ("name", name), ("license", licence), ("source_url", source_url))]
    return index_fingerprint(done, index).crossJoin(wrote).filter("wrote").select(*named, F.col("fingerprint").alias("sha256_of_index"))  # one row each


def real_only(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """files (name) that the metadata (name, label) call REAL; metadata for files that aren't there, and files without metadata, go."""
    return files.join(metadata.filter("label = 'REAL'").select("name").distinct(), "name", "left_semi")


def chosen_subjects(rows: DataFrame, subject: str, n: int, seed: int) -> DataFrame:
    """rows of n subjects, drawn by a hash of seed and subject: a sampling operator."""
    from ..functions.running import order_number

    drawn = rows.select(subject).distinct().orderBy(order_number(F.concat_ws("|", F.lit(seed), F.col(subject).cast("string"))), subject).limit(n)
    return rows.join(drawn, subject, "left_semi")
