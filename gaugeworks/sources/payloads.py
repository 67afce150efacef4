"""A sink in two phases for payload files and their manifest, as a Spark data source: `df.write.format("gaugeworks_payloads")`.

Rows are (name, payload binary, further columns). Each attempt of a task writes its payloads into a folder of its own and its manifest rows into a staged list. Only when all tasks are done, commit publishes the lists of the attempts that Spark took and deletes the folders of the others; abort deletes all that the job has written. So a failed or doubled attempt leaves neither a row nor a file, and a manifest row never comes before its file. What a killed process left behind after abort, or a lost driver, no row names; swept() deletes it.

Below `root`: `payloads/<job>/<attempt>/<name>`, and `manifest/<job>/<attempt>.json` with a line per row: the further columns, payload_path (below root), payload_bytes and payload_sha256."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.manifests import unseen
from .jsonl import existing

FORMAT = "gaugeworks_payloads"
ADDED = {"payload_path": "string", "payload_bytes": "long", "payload_sha256": "string"}


def opened(root: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^(file:)?/+(?=[^/])", "file:///", root))


@dataclass
class Written(WriterCommitMessage):
    """What one attempt leaves."""

    attempt: str
    rows: int


class PayloadWriter(DataSourceArrowWriter):
    def __init__(self, root: str, name: str, payload: str) -> None:
        self.root, self.name, self.payload = root, name, payload
        self.job = uuid.uuid4().hex  # made on the driver, the same in all tasks

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = opened(self.root)
        attempt = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        try:
            return self._written(fs, base, attempt, iterator)
        except BaseException:  # whatever stopped it, a failed attempt takes its files along
            _kept(fs, f"{base}/payloads/{self.job}/{attempt}", set())
            raise

    def _written(self, fs: pa.fs.FileSystem, base: str, attempt: str, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, n, out = f"payloads/{self.job}/{attempt}", 0, None
        for batch in iterator:
            names, payloads = batch.column(self.name), batch.column(self.payload)
            rest = batch.drop_columns([self.payload])
            for name, payload, row in zip(names, payloads, rest.to_pylist(), strict=True):
                if out is None:
                    fs.create_dir(f"{base}/{folder}", recursive=True)
                    fs.create_dir(f"{base}/_staged/{self.job}", recursive=True)
                    out = fs.open_output_stream(f"{base}/_staged/{self.job}/{attempt}.json")
                data, path = payload.as_py() or b"", f"{folder}/{name.as_py()}"
                with fs.open_output_stream(f"{base}/{path}") as file:
                    file.write(data)
                line = row | {"payload_path": path, "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest()}
                out.write((json.dumps(line, default=str, ensure_ascii=False) + "\n").encode())
                n += 1
        if out is not None:
            out.close()
        return Written(attempt, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = opened(self.root)
        taken = {m.attempt for m in messages if isinstance(m, Written) and m.rows}
        _kept(fs, f"{base}/payloads/{self.job}", taken)
        _kept(fs, f"{base}/_staged/{self.job}", {f"{a}.json" for a in taken})
        if taken:  # the one step that publishes: a folder takes its place
            fs.create_dir(f"{base}/manifest", recursive=True)
            fs.move(f"{base}/_staged/{self.job}", f"{base}/manifest/{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = opened(self.root)
        for folder in ("payloads", "_staged"):
            _kept(fs, f"{base}/{folder}/{self.job}", set())


def _kept(fs: pa.fs.FileSystem, folder: str, names: set[str]) -> None:
    """Deletes all in folder but these; with none, the folder."""
    if fs.get_file_info(folder).type == pa.fs.FileType.NotFound:
        return
    if not names:
        fs.delete_dir(folder)
        return
    for found in fs.get_file_info(pa.fs.FileSelector(folder)):
        if found.base_name not in names:
            (fs.delete_dir if found.type == pa.fs.FileType.Directory else fs.delete_file)(found.path)


class PayloadFiles(DataSource):
    """Options: root, name and payload (columns; `name` and `payload` by default)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PayloadWriter:
        if overwrite:
            raise ValueError("payloads are only ever appended")
        return PayloadWriter(self.options["root"], self.options.get("name", "name"), self.options.get("payload", "payload"))


def write_payloads(rows: DataFrame, root: str, name: str = "name", payload: str = "payload") -> None:
    """Writes each row's payload to a file and its other columns to the manifest, in one job. Names are unique and safe as file names; a null payload is an empty file."""
    rows.sparkSession.dataSource.register(PayloadFiles)
    rows.write.format(FORMAT).option("root", root).option("name", name).option("payload", payload).mode("append").save()


def manifest(spark: SparkSession, root: str, columns: StructType) -> DataFrame:
    """What is published below root, with the given further columns; no rows if there is nothing yet."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", " + ", ".join(f"{n} {t}" for n, t in ADDED.items())
    return existing(spark, f"{root}/manifest/*", fields)


def append_payloads(rows: DataFrame, root: str, key: str, name: str = "name", payload: str = "payload") -> DataFrame:
    """write_payloads() of the rows whose key isn't in the manifest yet, each key once; returns the manifest. A run that was stopped goes on where it was, and one that is repeated adds nothing."""
    spark, rest = rows.sparkSession, StructType([f for f in rows.schema if f.name != payload])
    write_payloads(unseen(rows, manifest(spark, root, rest), key), root, name, payload)
    return manifest(spark, root, rest)


def with_files(rows: DataFrame, root: str) -> DataFrame:
    """Manifest rows with file_bytes and file_sha256, of what the files hold; nulls where a file is missing. Spark passes over empty files when it reads, so a row of no bytes counts as having its file."""
    below = root.rstrip("/").rpartition(":")[2].lstrip("/")
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/payloads")
    told: Column = F.regexp_replace("path", rf"^.*?\Q{below}\E/", "")
    found = rows.join(files.select(told.alias("payload_path"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha256")), "payload_path", "left")
    empty = F.col("payload_bytes") == 0
    return found.withColumns({"file_bytes": F.coalesce("_bytes", F.when(empty, 0)), "file_sha256": F.coalesce("_sha256", F.when(empty, F.sha2(F.lit(b""), 256)))}).drop("_bytes", "_sha256")


def swept(root: str) -> list[str]:
    """Deletes the folders of all jobs that published nothing, and returns their names; for when no job is writing below root. Only jobs are listed, not files."""
    fs, base = opened(root)
    names = lambda folder: {f.base_name for f in fs.get_file_info(pa.fs.FileSelector(f"{base}/{folder}", allow_not_found=True))}
    gone = (names("payloads") | names("_staged")) - names("manifest")
    for job in gone:
        for folder in ("payloads", "_staged"):
            _kept(fs, f"{base}/{folder}/{job}", set())
    return sorted(gone)
