"""What the operators share: reading, staging, Arrow maps and a worker-wide store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.session import scratch_path

SLICE_ROWS = 512
SPACES = " \t\n\x0b\f\r"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage there."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks."""
    import sys
    import types

    module = sys.modules.setdefault("_fluxora_worker", types.ModuleType("_fluxora_worker"))
    return module.__dict__.setdefault(name, {})


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the Python objects of one slice stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[dict]]], schema: str
) -> DataFrame:
    """``make`` runs once per task; what it returns turns a slice into output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches):
            rows = work(part)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        rest = getattr(work, "rest", None)
        if rest is not None:
            for rows in rest():
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def doc_view(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone: extra columns of any name stay out of the operator."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
