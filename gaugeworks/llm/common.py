"""What the operators of this folder share: tables, the shared folder, names, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A-Z to a-z, all else as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset, a local one if all executors are this machine's, otherwise an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/gaugeworks-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared_dir() that nothing reads any more, in whatever store it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: later steps don't depend on executors that made it."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job go when the job ends, not when the driver happens to collect its garbage: for chains of jobs that hand on stored tables, whose shuffles nothing reads again. The session's setting is put back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables in one folder of the shared folder, removed together when no result reads them any more."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.path = spark, shared_dir(spark, what)

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        """As stored(), in this folder."""
        path = f"{self.path}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        removed(self.spark, self.path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not in df, whatever it has (names match without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """df's schema and further fields (name, type)."""
    out = StructType(list(df.schema.fields))
    for name, kind in fields:
        out = out.add(name, kind)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, and, but for a single longer row, of so many bytes, so that what a step returns takes little memory outside the heap at once."""
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            part = batch.slice(i, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            i += part.num_rows
            yield part


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; lower() does the same where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


# --- hashes of words, for numpy code inside tasks -----------------------------------------------

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20
#: Bytes that part words: space and \t to \r.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold_case:
        values[65:91] = values[97:123]
    return values


class Powers:
    """BASE**i and BASE**-i modulo 2**64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(max(n, SLICE), base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def word_hashes(data: np.ndarray, values: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of data (bytes as uint8): polynomial hashes modulo 2**64, mixed. Works slice by slice, cut between words, so that long texts need no more memory than short ones."""
    hashes, starts, ends, at, n = [], [], [], 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        if end < n:
            gaps = np.flatnonzero(spaces[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a slice
                while end < n and not (g := np.flatnonzero(spaces[data[end : end + SLICE]])).size:
                    end = min(n, end + SLICE)
                end = n if end >= n else end + int(g[0]) + 1
        part = data[at:end]
        word = np.empty(len(part) + 2, np.int8)
        word[0] = word[-1] = 0
        np.logical_not(spaces[part], out=word[1:-1].view(bool))
        edge = np.diff(word)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = POWERS.to(len(part))
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[part] * up, dtype=np.uint64, out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(s + at)
            ends.append(e + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
