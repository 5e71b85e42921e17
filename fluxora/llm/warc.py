"""WARC archives with revisit records and a salvage reader (operator 7).

Writing: each page becomes a record, a gzip member of its own, with the page in UTF-8 as
the payload of an HTTP response.  Of records with equal payloads of at least ``least``
bytes, that with the smallest page id is the response and the others revisit it.  Tasks
gather members into segments of about ``SEGMENT`` bytes; a segment is a row (archive,
segment, data) of a Parquet table, so that Spark's committer settles retried tasks.  The
data of an archive's segments, in order, are a valid ``.warc.gz`` file.

Reading: the salvage reader checks each member (gzip checksum, version line, length, end
marks, payload digest).  Where a check fails it searches for the next member or version
line that begins a valid record, goes on there, and logs the bytes between as a gap with
the reason of the first failure.  It reads plain records as well.

:func:`salvaged` writes the gaps to a log table; :func:`archived` fails when pages are lost.
Segments can be written as ``.warc.gz`` files and read from them.

A null page is an empty payload.  Rows that share the smallest id and the payload are all
responses; a null id is never the smallest unless all are null.  Empty tables give no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.llm.common import map_rows, slices, staged
from fluxora.session import scratch_path

LEAST = 100
SEGMENT = 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not compressed."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(ValueError):
    """A check on a record failed."""


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the front of ``data``, checked."""
    if not VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode(
            "utf-8", "replace"
        ).strip()
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Damaged("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = bytes(data[start:stop])
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers:
        payload = block.partition(b"\r\n\r\n")[2]
        found = "sha256:" + hashlib.sha256(payload).hexdigest()
        if headers["warc-payload-digest"].lower() != found:
            raise Damaged("payload digest differs")
    return headers, block, stop + 4


def member(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The gzip member or plain record at ``at``: headers, block and its end."""
    if not data.startswith(MAGIC, at):
        if not data.startswith(b"WARC/", at):
            raise Damaged("neither member nor version line")
        headers, block, size = parse(memoryview_bytes(data, at))
        return headers, block, at + size
    unpack, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and pos < len(data):
            parts.append(unpack.decompress(data[pos : pos + STEP]))
            pos += STEP
    except zlib.error as problem:
        raise Damaged("gzip data is broken") from problem
    if not unpack.eof:
        raise Damaged("gzip member is cut")
    headers, block, size = parse(raw := b"".join(parts))
    if size != len(raw):
        raise Damaged("member holds more than its record")
    return headers, block, min(pos, len(data)) - len(unpack.unused_data)


def memoryview_bytes(data: bytes, at: int) -> bytes:
    """The bytes that can belong to a plain record at ``at``, by its stated length."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    size = re.search(rb"\r\ncontent-length:\s*([0-9]{1,18})", data[at:end], re.IGNORECASE)
    return data[at : end + 8 + (int(size[1]) if size else 0)]


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps in order; together their byte ranges cover all of ``data``."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            headers, block, end = member(data, at)
        except Damaged as problem:
            if gap is None:
                gap, reason = at, str(problem)
            found = [x for x in (data.find(MAGIC, at + 1), data.find(b"WARC/1.", at + 1)) if x > 0]
            at = min(found, default=len(data))
            continue
        if gap is not None:
            yield {"start": gap, "end": at, "gap": reason}
            gap = None
        yield {"start": at, "end": end, "headers": headers, "block": block}
        at = end
    if gap is not None:
        yield {"start": gap, "end": len(data), "gap": reason}


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest and the id that a revisit refers to."""
    rows = pages.select(
        F.col("`page_id`").cast("long").alias("page_id"),
        F.col("`url`").alias("url"),
        F.coalesce(F.col("`html`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Sums per digest in each task before the shuffle; only digests met twice go on.
    firsts = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~is_first, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the archives; returns the table of their segments."""

    def make():
        ready: list[bytes] = []
        count = [0]
        context = TaskContext.get()
        archive = f"archive-{context.partitionId() if context else 0:06d}"

        def segment() -> list[dict]:
            data = b"".join(ready)
            ready.clear()
            count[0] += 1
            return [{"archive": archive, "segment": count[0] - 1, "data": data}] if data else []

        def work(batch: pa.RecordBatch) -> list[dict]:
            out, size = [], sum(map(len, ready))
            columns = ("page_id", "url", "payload", "digest", "refers_to")
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                ready.append(gzip.compress(record(*row), 5, mtime=0))
                size += len(ready[-1])
                if size >= SEGMENT:
                    out += segment()
                    size = 0
            return out

        work.rest = lambda: iter([segment()])
        return work

    rows = map_rows(with_originals(pages, least), make, "archive string, segment int, data binary")
    return staged(rows, "warc")


READ_SCHEMA = (
    "archive string, segment int, start long, end long, gap string, type string, "
    "record_id string, url string, payload binary, payload_bytes long, "
    "payload_digest string, refers_to string"
)


def read_archives(segments: DataFrame) -> DataFrame:
    """A row per record and per gap (``gap`` holds the reason; null for records)."""

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("archive", "segment", "data"))
            for archive, number, data in zip(*columns):
                for found in salvage(data or b""):
                    headers = found.get("headers", {})
                    size = headers.get("payload-length", "")
                    rows.append(
                        {
                            "archive": archive, "segment": number,
                            "start": found["start"], "end": found["end"], "gap": found.get("gap"),
                            "type": headers.get("warc-type"),
                            "record_id": headers.get("warc-record-id"),
                            "url": headers.get("warc-target-uri"),
                            "payload": found.get("block", b"").partition(b"\r\n\r\n")[2] or None,
                            "payload_bytes": int(size) if size.isdigit() else None,
                            "payload_digest": headers.get("warc-payload-digest", "")
                            .removeprefix("sha256:") or None,
                            "refers_to": headers.get("warc-refers-to"),
                        }
                    )
            return rows

        return work

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(READ_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, 4):
            rows = work(part)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return segments.mapInArrow(run, READ_SCHEMA)


def page_of(column: str):
    """The page id inside ``<urn:page:...>``, null if there is none."""
    found = F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(found != "", found.cast("long"))


class PagesLost(ValueError):
    """Archives hold fewer records than pages were written; the gaps are logged."""


GAP_COLUMNS = ["archive", "segment", "start", "end", "gap"]


def salvaged(segments: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Records (without payloads), the log of quarantined gaps, and where that log is kept.

    Both are written tables; a gap names its archive, segment, byte range and first reason.
    """
    read = staged(read_archives(segments).drop("payload"), "records")
    path = scratch_path(segments.sparkSession, "warc-gaps")
    read.filter("gap IS NOT NULL").select(*GAP_COLUMNS).write.parquet(path)
    gaps = segments.sparkSession.read.parquet(path)
    return read.filter("gap IS NULL"), gaps, path


def write_files(segments: DataFrame, folder: str) -> DataFrame:
    """One ``.warc.gz`` file per segment; returns path and size of each.

    A file is written aside and moved to its name, so a task that runs twice leaves one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for batch in slices(batches, 4):
            paths, sizes = [], []
            columns = (batch.column(c).to_pylist() for c in ("archive", "segment", "data"))
            for archive, number, data in zip(*columns):
                path = f"{base}/{archive}-{number:05d}.warc.gz"
                aside = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside, compression=None) as out:
                    out.write(data)
                system.move(aside, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"]
            )

    return staged(segments.mapInArrow(run, "path string, bytes long"), "warc-files")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of ``.warc.gz`` files, for :func:`read_archives`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    name = F.regexp_extract("path", r"([^/]*)-([0-9]+)\.warc\.gz$", 1)
    number = F.regexp_extract("path", r"-([0-9]+)\.warc\.gz$", 1).cast("int")
    return files.select(name.alias("archive"), number.alias("segment"), F.col("content").alias("data"))


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to archives, read those back, one row per record.

    Damage does not pass silently: gaps are logged, and fewer records than pages are an error
    that names the log and how many bytes it holds.
    """
    rows, gaps, path = salvaged(write_archives(pages))
    found, wanted = rows.count(), pages.count()
    if found < wanted:
        n, size = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
        raise PagesLost(f"{wanted - found} of {wanted} pages lost in {n} gaps of {size} bytes, see {path}")
    return rows.select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page_of("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
    sha256(body) AS payload_digest FROM p),
m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
