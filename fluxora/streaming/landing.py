"""The landing zone as a stream: new files are merged once, however often delivered."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxora.sources.files import POINTER, _replace_file, exists
from fluxora.sources.lake import append_once


def landing_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str = "*",
    file_format: str = "parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    return (
        spark.readStream.format(file_format)
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def run_available(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> None:
    """Process everything that has arrived, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def land(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    partition: Sequence[str],
    key: str,
    order: Callable[[], Sequence[Column]],
) -> None:
    """Merge arriving rows by key into a partitioned table."""

    def merge(batch: DataFrame, _: int) -> None:
        append_once(batch.sparkSession, target, batch, partition, key, order())

    run_available(stream, checkpoint, merge)


def count_available(
    stream: DataFrame, dims: Sequence[str], count: Column, target: str, checkpoint: str,
    compact_after: int = 32,
) -> None:
    """Running counts kept in streaming state; a trigger writes the changed keys only.

    Every trigger's changes are a folder of their own, put in force by replacing the file that
    names the folders, so readers (:func:`read_counts`) see the counts of one trigger whole and
    never an empty target.  After ``compact_after`` triggers the folders become one.  A trigger
    that is run again writes the same folder again.  A target belongs to one checkpoint.
    """
    counted = stream.groupBy(*dims).agg(count.alias("n"))

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = counts_state(spark, target)
        if number <= state["last"]:
            return
        name = f"changes-{number:010d}"
        batch.write.mode("overwrite").parquet(f"{target}/{name}")
        folders = [*state["folders"], name]
        if len(folders) > compact_after:
            whole = f"counts-{number:010d}"
            latest(spark, target, folders, dims).write.mode("overwrite").parquet(f"{target}/{whole}")
            folders = [whole]
        put_in_force(spark, target, {"last": number, "folders": folders})

    query = (
        counted.writeStream.outputMode("update")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def counts_state(spark: SparkSession, target: str) -> dict:
    """The folders in force and the last trigger they hold."""
    if not exists(spark, f"{target}/{POINTER}"):
        return {"last": -1, "folders": []}
    return json.loads(spark.read.text(f"{target}/{POINTER}").first()["value"])


def put_in_force(spark: SparkSession, target: str, state: dict) -> None:
    _replace_file(spark, f"{target}/{POINTER}", json.dumps(state, sort_keys=True))


def latest(spark: SparkSession, target: str, folders: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """The last written count of every key; folders are named in the order of their triggers."""
    number = F.regexp_extract(F.col("_metadata.file_path"), "-([0-9]{10})/[^/]*$", 1)
    rows = spark.read.parquet(*[f"{target}/{f}" for f in folders]).select("*", number.alias("__at"))
    return rows.groupBy(*dims).agg(F.max_by("n", "__at").alias("n"))


def read_counts(spark: SparkSession, target: str, dims: Sequence[str]) -> DataFrame:
    """The counts of the last trigger in force."""
    folders = counts_state(spark, target)["folders"]
    if not folders:
        raise FileNotFoundError(f"no counts below {target}")
    return latest(spark, target, folders, dims)
