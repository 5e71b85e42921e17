"""File-level work: existence, listings, header probes, digests and publishing."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROBE_BYTES = 1 << 16
CHUNK = 1 << 22
POINTER = "CURRENT"  # not hidden, unlike names that start with an underscore


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of all files below ``root``; contents are not read.

    Spark plans no scan for files of zero bytes, so those are added from the file index
    with length 0 and no time.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    sized = found.select("path", "length", "modificationTime")
    # The index is driver-side metadata already; only the names are handed back to Spark.
    names = spark.createDataFrame([(u,) for u in found.inputFiles()], "url string")
    decoded = F.url_decode(F.replace("url", F.lit("+"), F.lit("%2B")))
    names = names.select(F.regexp_replace(decoded, "^file:/+", "file:/").alias("path"))
    empty = names.join(sized, "path", "left_anti").select(
        "path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("t")
    )
    return sized.unionByName(empty.withColumnRenamed("t", "modificationTime"))


def path_value(name: str, path: str = "path") -> Column:
    """Value of a ``name=value`` folder in a file path, NULL when absent."""
    text = F.regexp_extract(F.col(path), f"/{name}=([^/]+)/", 1)
    return F.nullif(text, F.lit(""))


def _open(path: str, seekable: bool = False):
    """Bytes of a file in any file system Arrow knows, opened inside a task."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path.removeprefix("file:/")
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner) if seekable else filesystem.open_input_stream(inner)


def probe(files: DataFrame, sample_lines: int = 100) -> DataFrame:
    """First lines of each listed file: (path, length, codificacao, cabecalho, linhas).

    Only the header and ``sample_lines`` lines of a file are read, whatever their length, by
    the task that holds its listing row.  UTF-8 is tried first, then Latin-1.
    """

    def first_lines(path: str) -> bytes:
        raw, wanted = bytearray(), sample_lines + 1
        with _open(path) as stream:
            while raw.count(b"\n") < wanted and (chunk := stream.read(PROBE_BYTES)):
                raw += chunk
        return b"\n".join(bytes(raw).split(b"\n")[:wanted])

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                raw = first_lines(path)
                try:
                    text, encoding = raw.decode("utf-8"), "utf-8"
                except UnicodeDecodeError:
                    text, encoding = raw.decode("latin-1"), "latin-1"
                lines = text.splitlines()
                body = [x for x in lines[1 : sample_lines + 1] if x.strip()]
                rows.append((path, length, encoding, lines[0] if lines else "", body))
            yield pd.DataFrame(
                rows, columns=["path", "length", "codificacao", "cabecalho", "linhas"]
            )

    schema = "path string, length long, codificacao string, cabecalho string, linhas array<string>"
    return files.select("path", "length").mapInPandas(heads, schema)


def digests(files: DataFrame) -> DataFrame:
    """SHA-256 of each listed file, read as a stream of chunks (any file size)."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with _open(path) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                out.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "sha256": out})

    return files.select("path").mapInPandas(hashed, "path string, sha256 string")


FOOTER = "path string, row_count long, columns array<string>, present array<string>"


def footers(files: DataFrame) -> DataFrame:
    """Rows, columns and columns with a value of each listed Parquet file, by its footer alone.

    No data page is read.  A column whose footer tells no NULL count is taken to have values.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch["path"]:
                with _open(path, seekable=True) as file:
                    meta = pq.read_metadata(file)
                names = list(dict.fromkeys(c.split(".")[0] for c in (
                    meta.schema.column(i).path for i in range(meta.num_columns)
                )))
                present = set()
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for i in range(group.num_columns):
                        column = group.column(i)
                        stats = column.statistics
                        nulls = stats.null_count if stats is not None and stats.has_null_count else 0
                        if column.num_values > nulls:
                            present.add(column.path_in_schema.split(".")[0])
                rows.append((path, meta.num_rows, names, [n for n in names if n in present]))
            yield pd.DataFrame(rows, columns=["path", "row_count", "columns", "present"])

    return files.select("path").mapInPandas(read, FOOTER)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row hashes: one row."""
    hashed = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("linhas"), F.sum(hashed).cast("string").alias("impressao")
    )


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def publish(
    df: DataFrame, root: str, problems: Callable[[DataFrame], list[str]]
) -> tuple[str | None, list[str]]:
    """Write a new version beside the current one, check it, then move the pointer.

    ``problems`` inspects the written data and names what is wrong.  With any problem
    the pointer stays where it was, so readers keep the previous version.
    """
    spark = df.sparkSession
    version = f"version={uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    written = spark.read.schema(df.schema).parquet(f"{root}/{version}")
    found = problems(written)
    if found:
        return None, found
    _replace_file(spark, f"{root}/{POINTER}", version)
    return version, []


def _replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write aside, then rename over the old file, so that no reader meets half a file."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.valueOf("OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    context.rename(fs.makeQualified(aside), fs.makeQualified(target), overwrite)


def remove_folders(spark: SparkSession, uris: list[str]) -> None:
    """Delete folders named by URI; one that is gone already is no error."""
    jvm = spark.sparkContext._jvm
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def current_version(spark: SparkSession, root: str) -> str | None:
    if not exists(spark, f"{root}/{POINTER}"):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()["value"].strip()


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published below {root}")
    return spark.read.parquet(f"{root}/{version}")
