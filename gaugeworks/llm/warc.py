"""WARC archives: written record by record, read back in sequence.

Each record is a gzip member of its own. The reader inflates incrementally, frames records by their content length, and checks the digests of block and payload."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir, table

#: A new archive is begun after so many compressed bytes.
ROLL_BYTES = 64 << 20
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
CHUNK = 1 << 16
#: Tasks that archives are dealt to, at most; more archives are several a task.
MOST_PARTITIONS = 20_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store that uri names, as pyarrow reaches it from a task (file, hdfs, s3, gs)."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One compressed record. A revisit's block is the HTTP header only; its Content-Length and the payload digest are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Corrupt(ValueError):
    """An archive that breaks the format or a digest."""


class _Members:
    """The inflated bytes of a stream of gzip members; `ended` after a member's last byte was handed out."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.z, self.out = stream, b"", None, bytearray()

    def _more(self) -> bool:
        """Inflates some more of the member at hand; False at its end."""
        if self.z is None or self.z.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise Corrupt("an archive ends within a record")
        self.out += self.z.decompress(self.raw, CHUNK)
        self.raw = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"")
        return True

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the stream."""
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.z, self.out = zlib.decompressobj(31), bytearray()
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self._more():
                raise Corrupt("a header without an end")
        head = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise Corrupt("a record is shorter than its content length")
            part = bytes(self.out[:n])
            del self.out[: len(part)]
            n -= len(part)
            if part:
                yield part

    def finish(self) -> None:
        while self._more():
            pass
        if bytes(self.out) != b"\r\n\r\n":
            raise Corrupt("a record is longer than its content length")


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_archive(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order. Bytes are hashed as they come; payloads are kept only if asked for."""
    members = _Members(stream)
    while members.begin():
        first, h = _fields(members.until(b"\r\n\r\n"))
        if first not in ("WARC/1.0", "WARC/1.1") or not h.get("content-length", "").isdigit():
            raise Corrupt("not a WARC record")
        block, payload, http, kept, n = hashlib.sha1(), hashlib.sha1(), b"", bytearray(), 0
        in_payload = False
        for part in members.take(int(h["content-length"])):
            block.update(part)
            if not in_payload:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                in_payload, part, http = True, http[at + 4 :], http[:at]
            payload.update(part)
            n += len(part)
            if with_payload:
                kept += part
        members.finish()
        _, inner = _fields(http)
        revisit = h.get("warc-type") == "revisit"
        named = h.get("warc-payload-digest", "").removeprefix("sha1:")
        if h.get("warc-block-digest", "").removeprefix("sha1:") != base64.b32encode(block.digest()).decode():
            raise Corrupt("a block's digest is wrong")
        if not revisit and named != base64.b32encode(payload.digest()).decode():
            raise Corrupt("a payload's digest is wrong")
        page = lambda x: None if x in ("", "None") else int(x)
        number = lambda name: page(h.get(name, "").removeprefix("<urn:page:").removesuffix(">"))
        yield {"page_id": number("warc-record-id"), "url": h.get("warc-target-uri"), "payload_bytes": int(inner.get("content-length", n)) if revisit else n, "payload_digest": base64.b32decode(named).hex(), "record_type": h.get("warc-type"), "refers_to": number("warc-refers-to"), "payload": bytes(kept) if with_payload and not revisit else None}


def with_revisits(pages: DataFrame, payload_col: str) -> DataFrame:
    """pages with _refers_to: of rows with equal payloads of REVISIT_BYTES at least, all but those with the largest page_id refer to it.

    Digests are counted before the join, so the side that names the responses has a row per repeated payload; a payload that many pages share is a skewed key of the other side, which adaptive execution splits. Shorter payloads get a key by chance that nothing has, so they are dealt evenly."""
    digest, first, n = fresh(pages, "_digest", "_first", "_n")
    long = F.octet_length(payload_col) >= REVISIT_BYTES
    keyed = pages.withColumn(digest, F.when(long, F.sha1(payload_col)).otherwise(F.concat(F.lit("-"), F.floor(F.rand(7) * 65536).cast("string"))))
    firsts = pages.filter(long).groupBy(F.sha1(payload_col).alias(digest)).agg(F.max("page_id").alias(first), F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).drop(n)
    joined = keyed.join(firsts, digest, "left")
    return joined.withColumn("_refers_to", F.when(~F.col("page_id").eqNullSafe(F.col(first)), F.col(first))).drop(digest, first)


def archive(rows: Iterable[tuple], folder: str, name: str, roll_bytes: int = ROLL_BYTES) -> Iterator[tuple[str, int]]:
    """Writes rows (page_id, url, payload, refers_to) to archives folder/name-0000.warc.gz, ..., and yields each one's address and number of records when it is complete."""
    fs, base = _open_fs(folder)
    fs.create_dir(base, recursive=True)
    out, size, files, count = None, 0, 0, 0
    for page_id, url, payload, refers_to in rows:
        file = f"{name}-{files:04d}.warc.gz"
        if out is None:
            out, size, count = fs.open_output_stream(f"{base}/{file}", compression=None), 0, 0
        data = record(page_id, url, payload or b"", refers_to, refers_to is not None)
        out.write(data)
        size += len(data)
        count += 1
        if size >= roll_bytes:
            out.close()
            out, files = None, files + 1
            yield f"{folder}/{file}", count
    if out is not None:
        out.close()
        yield f"{folder}/{file}", count


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives of page_id, url, payload (binary) and _refers_to to a folder that executors share, and returns the list of them: (path, records), kept as a table beside them.

    Each attempt of a task has archives of its own, named by its number, and the list holds those of the one attempt that Spark took. An attempt that failed, or ran beside another, leaves files that no list names; however it cut its rows, none is lost or doubled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rows = (tuple(x.as_py() for x in r) for b in batches for r in zip(*(b.column(c) for c in ("page_id", "url", "payload", "_refers_to")), strict=True))
        for path, n in archive(rows, folder, f"part-{context.partitionId():06d}-{context.taskAttemptId():08d}", roll_bytes):
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([n], pa.int64())})

    written = pages.select("page_id", "url", "payload", "_refers_to").mapInArrow(run, "path string, records long")
    written.write.parquet(f"{folder}/list")
    return pages.sparkSession.read.schema(written.schema).parquet(f"{folder}/list")


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """All archives in a folder that others have filled, as a list for read()."""
    # content isn't read here: the column is pruned
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of a list of archives (path). The list is dealt to tasks, an archive to each as far as there are partitions for it; a task streams its archives."""
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _open_fs(path)
                rows: list[dict] = []
                held = 0
                with fs.open_input_stream(inner, compression=None) as stream:
                    for r in read_archive(stream, with_payload):
                        rows.append(r)
                        held += 200 + len(r["payload"] or b"")
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    n = archives.count()
    return archives.select("path").repartition(max(1, min(n, MOST_PARTITIONS))).mapInArrow(run, READ_SCHEMA)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records to the shared folder, and read back.

    Null html: an empty payload. Null url: no target. Repeated rows with the largest page_id are all responses; a null page_id revisits. No pages: no archive, no rows."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return read(write(with_revisits(pages, "payload"), shared_dir(spark, "warc"))).drop("payload", "url")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
