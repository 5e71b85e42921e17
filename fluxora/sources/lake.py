"""Delimited and Parquet layers: scans, fallbacks, sinks, upserts and backfills."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxora.functions.labels import parse_period
from fluxora.operators.order_stats import join_null_safe
from fluxora.operators.territory import last_per_key
from fluxora.session import stage
from fluxora.sources.delimited import scan
from fluxora.sources.files import exists, remove_folders


def month_text(col: Column) -> Column:
    """Two-digit month, so that folders read ``mes=04``."""
    return F.lpad(col.cast("string"), 2, "0")


def read_delimited(
    spark: SparkSession, path: str, sep: str = ";", encoding: str | None = None
) -> DataFrame:
    """Delimited rows, all columns as text, headers normalised, each file by its own header.

    A file without the separator, an empty one or a line of another width is an error;
    :func:`fluxora.sources.delimited.scan` sets such files and lines aside instead.
    """
    return scan(spark, path, separators=(sep,), encoding=encoding, pattern="*").strict


BYTE_ORDER_MARK = "\ufeff"


def write_delimited(
    df: DataFrame, path: str, partition: Sequence[str] = (), sep: str = ";",
    encoding: str = "UTF-8", bom: bool = False,
) -> None:
    """Delimited files with a header; ``bom`` starts each with a byte-order mark, for spreadsheets."""
    if bom:
        # The header line is the first thing in a file; readers take the mark off again.
        first = next(c for c in df.columns if c not in partition)
        df = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    writer = balanced(df, partition).write.mode("overwrite").option("sep", sep)
    writer = writer.option("header", True).option("encoding", encoding)
    if partition:
        # Only the folders present in the rows are replaced.
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition)
    writer.csv(path)


def balanced(df: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Rows of one output folder together, but a hot folder split over several tasks."""
    return df.hint("rebalance", *[F.col(c) for c in partition]) if partition else df


def write_table(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replace exactly the partitions present in ``df``."""
    (
        balanced(df, partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


def write_both(df: DataFrame, root: str, name: str, partition: Sequence[str] = ()) -> bool:
    """Parquet and delimited copies of one table; an empty table is skipped."""
    if df.isEmpty():
        return False
    staged = stage(df, f"sink-{name}")
    write_table(staged, f"{root}/parquet/{name}", partition) if partition else staged.write.mode(
        "overwrite"
    ).parquet(f"{root}/parquet/{name}")
    write_delimited(staged, f"{root}/csv/{name}", partition, sep=",", bom=True)
    return True


def prepare_months(
    source: DataFrame,
    path: str,
    column: str,
    prepare: Callable[[DataFrame], DataFrame],
    months: Sequence[tuple[int, int]] | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Rows of a ``YYYYMM`` column prepared and written as delimited months, with an account.

    The account has one row per month: rows filtered, rows saved (read back from the files),
    the columns and whether it was a dry run.  Rows without a period belong to the month NULL,
    which is never written.  A wanted month without rows is an error before anything is written.
    A dry run prepares every row all the same, so it fails where the real one would, and writes
    nothing at ``path``.
    """
    start = parse_period(F.col(column))
    keyed = source.withColumns({"ano": F.year(start), "mes": F.month(start)})
    if months is not None:
        wanted = F.lit(False)
        for year, month in months:
            wanted = wanted | ((F.col("ano") == year) & (F.col("mes") == month))
        keyed = keyed.where(wanted)
    rows = stage(prepare(keyed), "prepared")
    columns = [c for c in rows.columns if c not in ("ano", "mes")]
    # One row per calendar month.
    counted = stage(rows.groupBy("ano", "mes").agg(F.count(F.lit(1)).alias("filtradas")), "prepared-months")
    if months is not None:
        found = {(r["ano"], r["mes"]) for r in counted.collect()}
        empty = sorted(set(months) - found)
        if empty:
            raise ValueError("no rows of the months " + ", ".join(f"{y}-{m:02d}" for y, m in empty))
    dated = rows.where(F.col("ano").isNotNull())
    spark = source.sparkSession
    saved = counted.limit(0).select("ano", "mes", F.lit(0).cast("long").alias("gravadas"))
    if not dry_run and not counted.where(F.col("ano").isNotNull()).isEmpty():
        write_delimited(dated.withColumn("mes", month_text(F.col("mes"))), path, ["ano", "mes"])
        text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        text = text.add("ano", T.IntegerType()).add("mes", T.IntegerType())
        back = spark.read.schema(text).options(header=True, sep=";").csv(path)
        saved = back.groupBy("ano", "mes").agg(F.count(F.lit(1)).alias("gravadas"))
    return counted.join(saved, ["ano", "mes"], "left").select(
        "ano", "mes", "filtradas", F.coalesce("gravadas", F.lit(0)).alias("gravadas"),
        F.lit(",".join(columns)).alias("colunas"), F.lit(dry_run).alias("simulado"),
    )


def read_partition(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """One month; the filter prunes folders before any file is opened."""
    return spark.read.parquet(path).where((F.col("ano") == year) & (F.col("mes") == month))


# What the Parquet reader says of a damaged file (fixed values).
CORRUPT_MARKS = ("Could not read footer", "is not a Parquet file", "CANNOT_READ_FILE_FOOTER")


def read_with_fallback(
    spark: SparkSession, root: str, name: str, schema: T.StructType
) -> DataFrame:
    """Parquet when present and readable, otherwise the delimited copy, tagged ``_source``.

    ``mergeSchema`` reads every footer (as a Spark job), so one corrupt file is enough
    to fall back at plan time.
    """
    parquet = f"{root}/parquet/{name}"
    try:
        spark.read.option("mergeSchema", True).parquet(parquet)
        df = spark.read.schema(schema).parquet(parquet)
        return df.withColumn("_source", F.lit("parquet"))
    except Exception as error:
        # A missing path or an unreadable file falls back; any other failure (a lost
        # connection, say) must not turn into a stale copy.
        condition = (getattr(error, "getCondition", lambda: None)() or "").upper()
        unreadable = condition.startswith(("CANNOT_READ_FILE", "FAILED_READ_FILE", "CANNOT_MERGE"))
        corrupt = any(mark in str(error) for mark in CORRUPT_MARKS)
        if not (isinstance(error, AnalysisException) or unreadable or corrupt):
            raise
    csv = f"{root}/csv/{name}"
    if not exists(spark, csv):
        raise FileNotFoundError(f"neither format of {name} exists below {root}")
    df = spark.read.schema(schema).option("header", True).csv(csv)
    return df.withColumn("_source", F.lit("csv"))


def resolved_rows(
    target: DataFrame, source: DataFrame, period: Sequence[str], code: str, natural: Sequence[str]
) -> DataFrame:
    """Source rows with ``__key``: the natural key of the target row that each takes over.

    A source row that finds its code in the target takes over that row, whatever its
    names say; otherwise it replaces the row with its natural key or is new.
    """
    by_code = target.where(F.col(code).isNotNull()).select(
        *period, code, F.struct(*natural).alias("__hit")
    )
    # Rows without a code cannot match by it: they skip the join, where they would all
    # meet in one task.
    coded = source.where(F.col(code).isNotNull()).join(by_code, [*period, code], "left")
    own_key = F.struct(*natural)
    return coded.withColumn("__key", F.coalesce("__hit", own_key)).drop("__hit").unionByName(
        source.where(F.col(code).isNull()).withColumn("__key", own_key)
    )


def merge_rows(
    target: DataFrame,
    source: DataFrame,
    period: Sequence[str],
    code: str,
    natural: Sequence[str],
) -> DataFrame:
    """Target rows updated by source rows: by (period, code) first, else by natural key.

    ``__action`` tells what became of each row: inserted, updated, unchanged or kept (no
    source row names it); ``__given`` how many source rows it had, of which the largest counts.
    """
    period, natural = list(period), list(natural)
    columns = target.columns
    row = F.struct(*[F.col(c) for c in columns if c not in period])
    nothing = F.lit(None).cast(target.select(row.alias("r")).schema["r"].dataType)
    old = target.select(*period, F.struct(*natural).alias("__key"), row.alias("__old"), nothing.alias("__new"))
    new = resolved_rows(target, source, period, code, natural).select(
        *period, "__key", nothing.alias("__old"), row.alias("__new")
    )
    merged = old.unionByName(new).groupBy(*period, "__key").agg(
        F.max("__old").alias("__old"), F.max("__new").alias("__new"), F.count("__new").alias("__given")
    )
    action = (
        F.when(F.col("__new").isNull(), "kept")
        .when(F.col("__old").isNull(), "inserted")
        .when(F.col("__old") == F.col("__new"), "unchanged")
        .otherwise("updated")
    )
    both = merged.withColumn("__row", F.coalesce("__new", "__old"))
    return both.select(
        *[F.col(c) if c in period else F.col("__row")[c].alias(c) for c in columns],
        action.alias("__action"), "__given",
    )


def _same_columns(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Stored columns in the order and types of ``source`` (folder values are re-typed)."""
    return stored.select(*[F.col(c).cast(t).alias(c) for c, t in source.dtypes])


ACTIONS = ("inserted", "updated", "unchanged")


def _merged(
    spark: SparkSession, path: str, source: DataFrame, period: Sequence[str], code: str,
    natural: Sequence[str],
) -> DataFrame:
    """The touched partitions after the merge, staged: Spark must not overwrite what it reads."""
    if exists(spark, path):
        # Folder values in the source's types: read as numbers, ``01`` would not be ``01``.
        target = _same_columns(spark.read.schema(source.schema).parquet(path), source)
    else:
        target = source.limit(0)
    touched = source.select(*period).distinct()
    # Size bound: one row per calendar period; it prunes the target's folders.
    affected = target.join(F.broadcast(touched), list(period), "left_semi")
    return stage(merge_rows(affected, source, period, code, natural), "upsert")


def load(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    period: Sequence[str],
    code: str,
    natural: Sequence[str],
    required: Sequence[str] = (),
    dry_run: bool = False,
) -> DataFrame:
    """Idempotent merge into a table partitioned by ``period``, with an account of it.

    One row per period of the source: rows inserted, updated, unchanged, repeated (another
    source row of the same target row counted) and skipped (a ``required`` column is NULL or
    blank).  The account comes from the rows that are written, not from another pass over the
    inputs.  A dry run gives the same account and writes nothing.

    Only touched partitions are read and rewritten.
    """
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    source = stage(source.withColumn("__skip", lacking), "load")
    usable = source.where(~F.col("__skip")).drop("__skip")
    merged = _merged(spark, path, usable, period, code, natural)
    if not dry_run:
        write_table(merged.drop("__action", "__given"), path, period)
    counted = merged.groupBy(*period).agg(
        *[F.count_if(F.col("__action") == a).alias(a) for a in ACTIONS],
        F.sum(F.greatest(F.col("__given") - 1, F.lit(0))).alias("repeated"),
    )
    skipped = source.groupBy(*period).agg(F.count_if("__skip").alias("skipped"))
    zero = F.lit(0).cast("long")
    return join_null_safe(skipped, counted, period, "left").select(
        *period, *[F.coalesce(c, zero).alias(c) for c in (*ACTIONS, "repeated", "skipped")]
    )


def upsert(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    period: Sequence[str],
    code: str,
    natural: Sequence[str],
) -> None:
    """:func:`load` for callers that need no account."""
    merged = _merged(spark, path, source, period, code, natural)
    write_table(merged.drop("__action", "__given"), path, period)


def key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched_only(df: DataFrame, touched: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Rows of the touched folders, pruned by literals before any file is opened.

    ``touched`` has one row per folder; the driver that plans a scan holds their names anyway.
    """
    rows = touched.collect()
    for c in partition:
        values = sorted({r[c] for r in rows if r[c] is not None}, key=str)
        kept = F.col(c).isin(values)
        df = df.where(kept | F.col(c).isNull() if any(r[c] is None for r in rows) else kept)
    return join_null_safe(df, F.broadcast(touched), list(partition), "left_semi")


def append_once(
    spark: SparkSession, path: str, source: DataFrame, partition: Sequence[str], key: str,
    order: Sequence[Column], buckets: int = 64,
) -> None:
    """Insert rows by key, the last one winning; delivering them again changes nothing.

    A key may come back in another partition: the partitions that hold its old row are
    rewritten too, and one that is left without rows is removed.

    Where a key lies is told by an index beside the target, in hash buckets: a batch reads the
    buckets of its keys and the partitions these name, never the whole target.  The places a
    batch will write to are added to the index before the target is written and the places it
    left are dropped after, so at any moment the index names at least every true place.
    """
    partition = list(partition)
    index = f"{path.rstrip('/')}__index"
    source = stage(last_per_key(source, [key], order), "arrived")
    stored = spark.read.schema(source.schema).parquet(path) if exists(spark, path) else None
    types = dict(source.dtypes)
    columns = [F.col(c).cast(types[c]).alias(c) for c in (key, *partition)]

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select(*columns, key_bucket(key, buckets).alias("__bucket")).distinct()

    def write_index(rows: DataFrame, mode: str) -> None:
        rows.repartition("__bucket").write.mode(mode).option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("__bucket").parquet(index)

    if stored is not None and not exists(spark, index):
        write_index(placed(stored), "overwrite")
    arriving = placed(source)
    # At most ``buckets`` numbers.
    hit = sorted(r[0] for r in arriving.select("__bucket").distinct().collect())
    known = None
    if exists(spark, index):
        read = spark.read.schema(arriving.schema).parquet(index)
        known = stage(read.where(F.col("__bucket").isin(hit)), "index-read")
    write_index(arriving, "append")
    touched = source.select(*partition)
    if known is not None:
        before = known.join(source.select(key), key, "left_semi")
        touched = touched.unionByName(before.select(*partition))
    touched = stage(touched.distinct(), "touched")
    merged, gone = source, []
    if stored is not None:
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("__folder")
        old = touched_only(stored.select("*", folder), touched, partition)
        old = old.select(*[F.col(c).cast(t).alias(c) for c, t in source.dtypes], "__folder")
        merged = last_per_key(old.drop("__folder").unionByName(source), [key], order)
        merged = stage(merged, "append")
        emptied = join_null_safe(
            old.select("__folder", *partition).distinct(), merged.select(*partition).distinct(),
            partition, "left_anti",
        )
        gone = sorted({r["__folder"] for r in emptied.collect()})
    write_table(merged, path, partition)
    remove_folders(spark, gone)
    now = placed(merged.join(source.select(key), key, "left_semi"))
    if known is not None:
        now = now.unionByName(known.join(source.select(key), key, "left_anti"))
    write_index(now, "overwrite")


def backfill_plan(
    available: DataFrame,
    done: DataFrame,
    start: tuple[int, int],
    end: tuple[int, int],
    overwrite: bool = False,
) -> DataFrame:
    """Periods of a range with what to do: run, skipped (already there) or missing.

    All inputs have one row per calendar period.
    """
    low, high = sorted((start, end))
    first, last = low[0] * 12 + low[1] - 1, high[0] * 12 + high[1] - 1
    spark = available.sparkSession
    wanted = spark.range(first, last + 1).select(
        F.floor(F.col("id") / 12).cast("int").alias("ano"),
        (F.col("id") % 12 + 1).cast("int").alias("mes"),
    )
    joined = wanted.join(
        available.select("ano", "mes", F.lit(True).alias("__src")), ["ano", "mes"], "left"
    ).join(done.select("ano", "mes", F.lit(True).alias("__done")), ["ano", "mes"], "left")
    skip = F.col("__done").isNotNull() & F.lit(not overwrite)
    status = F.when(F.col("__src").isNull(), "missing").when(skip, "skipped").otherwise("run")
    return joined.select("ano", "mes", status.alias("acao"))
