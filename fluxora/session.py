"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Applied only where the session has not chosen a value itself.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", app: str = "fluxora", **conf: str) -> SparkSession:
    """Single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only when nothing is configured and the
    master is local (tests, bench); on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fluxora-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/fluxora/{label}-{uuid.uuid4().hex}"


# Paths staged inside the open blocks of :func:`passing_stages`, the innermost last.
_PASSING: list[list[str]] = []
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_path(spark: SparkSession, label: str) -> str:
    """A scratch path that goes with the innermost block of :func:`passing_stages`, if any."""
    path = scratch_path(spark, label)
    if _PASSING:
        _PASSING[-1].append(path)
    return path


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: what is needed later is written by then."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            delete(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go when it ends, not when the driver collects garbage."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that a lost executor re-reads files in place of re-running the
    upstream shuffles, and gives the next plan real file sizes to choose joins by.
    """
    return stage_in_turns(df.sparkSession, [df], label)


def stage_in_turns(spark: SparkSession, parts: Iterable[DataFrame], label: str) -> DataFrame:
    """:func:`stage` of the union of ``parts``, which are made and written one after another.

    Only one part's shuffle files lie on disk at a time.  There is at least one part.
    """
    path = staging_path(spark, label)
    for df in parts:
        with shuffles_removed(spark):
            df.write.mode("append").parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """:func:`stage` that also tells the row count, observed while writing."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return staged, int(seen.get["rows"])


BROADCAST_ROWS = 100_000


def counted_side(rows: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """Stage one side of a join and broadcast it only when counted to be few rows."""
    staged, n = stage_counted(rows, label)
    return F.broadcast(staged) if n <= (BROADCAST_ROWS if limit is None else limit) else staged


def release(spark: SparkSession) -> None:
    """Delete everything :func:`stage` and the scratch sinks wrote for this folder."""
    delete(spark, f"{shared_dir(spark)}/fluxora")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
