"""Streams of events: append without repeats, windows, sessions. The same functions that serve batches, with watermarks, and a sink that keeps the last state of each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.frames import with_fields

#: Before all times.
NEVER = -(1 << 62)


def event_stream(spark: SparkSession, path: str, time: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream, in the schema it has; times without a zone are read as UTC, as watermarks need."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    base = path.rstrip("/")
    # as a pattern: the source takes a single file only so
    return reader.parquet(f"{base[:-1]}[{base[-1]}]").withColumn(time, F.col(time).cast("timestamp"))


def without_repeats(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the delay: an append that is safe to run again. State older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def sliding(stream: DataFrame, by: Sequence[str], time: str, value: str, size: str = "10 seconds", slide: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    w = stream.withWatermark(time, delay).groupBy(*by, F.window(time, size, slide).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, by: Sequence[str], time: str, value: str, gap: str = "30 minutes", delay: str = "1 minute") -> DataFrame:
    w = stream.withWatermark(time, delay).groupBy(*by, F.session_window(time, gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("w.start").alias("start"), "n", "total")


def in_order(stream: DataFrame, by: str, pos: str, time: str) -> DataFrame:
    """stream with fault: `no_time`, or `non_monotonic_time` where an event of a session (`by`) isn't later than all before it, else null. Events of a session arrive in the order of `pos` from batch to batch; within a batch they are put in order. The state is one number a session, its last time in microseconds, so the faults are those of a batch over all rows, however the stream is cut."""
    out = with_fields(stream, fault="string")

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else NEVER
        rows = pd.concat(list(batches)).sort_values(pos, kind="stable")
        us = pd.to_datetime(rows[time]).dt.tz_localize(None).astype("datetime64[us]")
        none, us = us.isna().to_numpy(), us.to_numpy().astype(np.int64)
        before = np.maximum.accumulate(np.concatenate(([last], np.where(none, NEVER, us))))
        state.update((int(before[-1]),))
        yield rows.assign(fault=np.where(none, "no_time", np.where(us <= before[:-1], "non_monotonic_time", None)))[out.names]

    return stream.groupBy(by).applyInPandasWithState(check, out, "last long", "append", GroupStateTimeout.NoTimeout)


def run_to_lanes(checked: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs all that is there and writes it once, good rows and faulty ones apart: (good without fault, quarantine with it)."""
    lane = F.when(F.col("fault").isNull(), "good").otherwise("quarantine")

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("lane", lane).write.mode("overwrite").partitionBy("lane").parquet(f"{folder}/rows/batch={batch}")

    query = checked.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = checked.sparkSession.read.schema(with_fields(checked, batch="long", lane="string")).parquet(f"{folder}/rows")
    return rows.filter("lane = 'good'").select(*[c for c in checked.columns if c != "fault"]), rows.filter("lane = 'quarantine'").select(*checked.columns)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs all that is there, writes it below folder with the number of the batch, and returns what was written. A batch that runs twice replaces its own part."""
    spark = stream.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(with_fields(stream, batch="long")).parquet(f"{folder}/rows")


def last_state(updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of the updates of each key the one of the last batch."""
    rest = [c for c in updates.columns if c not in key and c != "batch"]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_u")).select(*key, *[F.col(f"_u.{c}").alias(c) for c in rest])
