"""A ledger of what ran: one row per period, stage and attempt, with the digest of its input.

A period is calendar time, so the ledger has few rows at any data size; it is appended to and
the last attempt of a (period, stage) counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxora.session import stage
from fluxora.sources.files import digests, exists, path_value

Period = tuple[int, int]
Outcome = tuple[str, str]  # status, codes or message

ENTRY = (
    "ano int, mes int, etapa string, tentativa int, digest string, status string, codigos string"
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(path)


def last_entries(ledger: DataFrame) -> DataFrame:
    """The last attempt of every (period, stage)."""
    last = Window.partitionBy("ano", "mes", "etapa").orderBy(F.desc("tentativa"))
    return ledger.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def known_state(spark: SparkSession, path: str, stage_name: str) -> dict[Period, tuple[int, str, str]]:
    """(attempt, digest, status) of every period's last attempt at a stage."""
    rows = last_entries(read_ledger(spark, path).filter(F.col("etapa") == stage_name)).collect()
    return {(r["ano"], r["mes"]): (r["tentativa"], r["digest"], r["status"]) for r in rows}


def record(
    spark: SparkSession, path: str, stage_name: str, outcomes: dict[Period, Outcome],
    digest: dict[Period, str],
) -> None:
    """Append one attempt for every period that ran."""
    if not outcomes:
        return
    known = known_state(spark, path, stage_name)
    rows = [
        (*p, stage_name, known.get(p, (0,))[0] + 1, digest.get(p), status, codes)
        for p, (status, codes) in sorted(outcomes.items())
    ]
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(path)


def isolated(
    work: Callable[[list[Period]], dict[Period, Outcome]], periods: Sequence[Period]
) -> dict[Period, Outcome]:
    """Run all periods in one go; if that fails, halve them until the bad ones stand alone.

    One bad period costs about two jobs per halving and the others still run together.  When
    more jobs in a row fail than one bad period explains, the fault is not a period's: it is
    raised.
    """
    periods = list(periods)
    patience = len(periods).bit_length() + 3
    failed_in_a_row = 0

    def attempt(some: list[Period]) -> dict[Period, Outcome]:
        nonlocal failed_in_a_row
        try:
            done = work(some)
            failed_in_a_row = 0
            return done
        except (PySparkException, Py4JJavaError, ValueError) as problem:
            failed_in_a_row += 1
            if failed_in_a_row > patience:
                raise
            if len(some) == 1:
                text = str(problem).strip().splitlines()
                return {some[0]: ("error", (text[0] if text else type(problem).__name__)[:500])}
        middle = len(some) // 2
        return attempt(some[:middle]) | attempt(some[middle:])

    return attempt(periods) if periods else {}


DEALT_BYTES = 64 << 20


def dealt(files: DataFrame) -> DataFrame:
    """Listed files dealt out in turn to tasks of some 64 MB each, at most one task a file.

    A listing is one small table, so without this one task would read all of its files.
    """
    sizes = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).first()
    least = files.sparkSession.sparkContext.defaultParallelism
    tasks = min(sizes["files"], max(least, (sizes["bytes"] or 0) // DEALT_BYTES + 1))
    return files.repartition(max(1, tasks))


def file_digests(spark: SparkSession, listed: DataFrame, path: str) -> DataFrame:
    """path and sha256 of the listed files; only new or changed files are read.

    What was read is kept below ``path``: a file counts as unchanged while its length and
    time of modification are.
    """
    facts = ["path", "length", "modificationTime"]
    known = (
        spark.read.parquet(path) if exists(spark, path)
        else spark.createDataFrame([], "path string, length long, modificationTime timestamp, sha256 string")
    )
    # A file of zero bytes has no time; its digest is that of nothing either way.
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in facts]
    joined = listed.select(*facts).alias("l").join(
        known.alias("k"), same[0] & same[1] & same[2], "left"
    ).select(*[F.col(f"l.{c}").alias(c) for c in facts], "k.sha256")
    joined = stage(joined.dropDuplicates(["path"]), "digests-known")
    fresh = dealt(joined.filter("sha256 IS NULL").drop("sha256"))
    fresh = stage(fresh.join(digests(fresh), "path").select(*facts, "sha256"), "digests-new")
    fresh.write.mode("append").parquet(path)
    return joined.filter("sha256 IS NOT NULL").unionByName(fresh).select("path", "sha256")


def period_digests(digested: DataFrame, salt: str) -> dict[Period, str]:
    """One digest per period over the names and digests of its files."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    rows = digested.select(
        path_value("ano").try_cast("int").alias("ano"), path_value("mes").try_cast("int").alias("mes"),
        F.concat_ws(":", name, "sha256").alias("part"),
    ).filter("ano IS NOT NULL AND mes BETWEEN 1 AND 12")
    # The files of one month: their names are listed by the driver for the scan as well.
    grouped = rows.groupBy("ano", "mes").agg(
        F.sha2(F.concat_ws("\n", F.lit(salt), F.sort_array(F.collect_list("part"))), 256).alias("digest")
    )
    return {(r["ano"], r["mes"]): r["digest"] for r in grouped.collect()}
