"""Trees of files: images by label and by identity, session payloads, label files. Spark lists and reads them; contents are read only where asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import with_fields
from ..functions.scalars import code_label
from ..operators.manifests import last_wins, restricted
from .jsonl import append_unseen, existing
from .schemas import SESSION, SESSION_MANIFEST

#: Payload files that a task reads at once.
FILES_A_BATCH = 200
IMAGES = "*.{png,jpg,jpeg,PNG,JPG,JPEG}"


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, length, content and rel, the path below root."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    below = root.rstrip("/").rpartition(":")[2].lstrip("/")
    return found.select("path", "length", "content", F.regexp_replace("path", rf"^.*?\Q{below}\E/", "").alias("rel"))


def labelled_images(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """Images below root/bonafide and root/attack/<species>: (path, rel, label 0 or 1, attack_type, subject), the last two also from the manifest row for the relative path, if there is one; of several the last by `seq` or sample_id."""
    files = _files(spark, root, IMAGES).drop("content")
    top = F.split_part("rel", F.lit("/"), F.lit(1))
    files = files.filter(top.isin("bonafide", "attack")).withColumns({"label": (top == "attack").cast("int"), "species": F.when(top == "attack", F.split_part("rel", F.lit("/"), F.lit(2)))})
    if manifest is None:
        return files.select("path", "rel", "label", F.col("species").alias("attack_type"), F.lit(None).cast("string").alias("subject"))
    order = "seq" if "seq" in manifest.columns else "sample_id"
    rows = manifest.select(F.col("output_path").alias("rel"), order, F.col("attack_type").alias("_type"), F.col("bonafide_source.id").alias("subject"))
    joined = last_wins(files, rows, "rel", order, ["_type", "subject"])
    return joined.select("path", "rel", "label", F.col("_type").alias("attack_type"), "subject")


def identity_images(spark: SparkSession, root: str, identities: DataFrame | None = None) -> DataFrame:
    """(identity, rel, path, content) of root/<identity>/<image>; identities (a column `identity`) restricts them. Content isn't read where it isn't selected."""
    files = _files(spark, root, IMAGES).filter(F.size(F.split("rel", "/")) == 2)
    rows = files.select(F.split_part("rel", F.lit("/"), F.lit(1)).alias("identity"), "rel", "path", "content")
    return rows if identities is None else restricted(rows, identities, "identity")


def identity_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are passed over."""
    return spark.read.text(path).select(F.trim("value").alias("identity")).filter(F.col("identity") != "")


def _opened(root: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^(file:)?/(?=[^/])", "file:///", root))


def write_sessions(payloads: DataFrame, root: str, manifest: str = "manifest") -> DataFrame:
    """Writes each session (session_id, label, subject_id and its events, one row each) as a JSON file of its own below root/sessions, and appends those whose session_id isn't there yet to the manifest root/manifest, with the file's path and sha256; returns the manifest.

    A file's name and content follow from its row alone, so a task that runs again writes the same; a run that is repeated appends nothing."""
    text = payloads.select("session_id", "label", "subject_id", F.to_json(F.struct(*payloads.columns)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        fs.create_dir(f"{base}/sessions", recursive=True)
        for b in batches:
            for name, content in zip(b.column("session_id"), b.column("text"), strict=True):
                part = f"{base}/sessions/_{name.as_py()}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(part) as out:
                    out.write(content.as_py().encode())
                final = f"{base}/sessions/{name.as_py()}.json"
                if fs.get_file_info(final).type == pa.fs.FileType.NotFound:
                    fs.move(part, final)
                else:
                    fs.delete_file(part)
            yield b

    written = text.mapInArrow(run, text.schema)
    rows = written.select("session_id", "label", "subject_id", F.concat(F.lit("sessions/"), "session_id", F.lit(".json")).alias("payload_path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("payload_sha256"))
    append_unseen(rows, f"{root}/{manifest}", "session_id")
    return existing(payloads.sparkSession, f"{root}/{manifest}", SESSION_MANIFEST)


def session_payloads(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """manifest rows with the session in their payload file (one JSON object a file, *.json), by its path below root; rows whose file is missing or empty are left out.

    The tasks open the files that their rows name: the driver lists none, however many there are."""
    names, rest = [c for c in manifest.columns if c != "payload_path"], manifest.filter(F.col("payload_path").endswith(".json"))

    def content(fs: pa.fs.FileSystem, path: str) -> bytes | None:
        try:
            with fs.open_input_stream(path, compression=None) as file:
                return file.read() or None
        except FileNotFoundError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        for b in batches:
            for i in range(0, b.num_rows, FILES_A_BATCH):
                part = b.slice(i, FILES_A_BATCH)
                yield part.append_column("_content", pa.array([content(fs, f"{base}/{p.as_py()}") for p in part.column("payload_path")], pa.binary()))

    read = rest.mapInArrow(run, with_fields(rest, _content="binary")).filter("_content is not null")
    return read.select("payload_path", *names, F.from_json(F.col("_content").cast("string"), SESSION).alias("s"), F.sha2("_content", 256).alias("sha256"))


def spoof_labels(spark: SparkSession, json_path: str | None, text_path: str | None, classes: dict[int, str], place: int = 40) -> DataFrame:
    """(path, code, class) from a JSON object of path to labels, or lines of a path and labels; of one path the JSON one counts. Codes outside classes are left out; a list that is too short fails the job."""
    short = lambda n: F.raise_error(F.concat(F.lit("too few labels: "), F.col("path"))).cast("int")
    parts = []
    if json_path:
        rows = spark.read.text(json_path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<int>>")).alias("path", "labels"))
        parts.append(rows.select("path", F.lit(0).alias("rank"), F.when(F.size("labels") > place, F.get("labels", F.lit(place))).otherwise(short(place)).alias("code")))
    if text_path:
        # the path comes first, so labels are one place further on
        rows = spark.read.text(text_path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("w")).select(F.get("w", F.lit(0)).alias("path"), "w")
        parts.append(rows.select("path", F.lit(1).alias("rank"), F.when(F.size("w") > place + 1, F.get("w", F.lit(place + 1)).cast("int")).otherwise(short(place)).alias("code")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    one = rows.groupBy("path").agg(F.min_by("code", "rank").alias("code"))
    return one.withColumn("class", code_label(F.col("code"), classes)).filter(F.col("class").isNotNull())


def subject_of(path: Column) -> Column:
    """The third part of a path; the job fails where there is none."""
    part = F.split_part(path, F.lit("/"), F.lit(3))
    return F.when(part != "", part).otherwise(F.raise_error(F.concat(F.lit("no subject in "), path)))
