"""The monthly run: landing -> clean -> aggregate, all periods in one job per stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.operators import movement as mv
from fluxora.operators import quality
from fluxora.operators.clean import clean_movements, period_text
from fluxora.session import stage
from fluxora.sources.files import write_json
from fluxora.sources.lake import read_delimited, write_table

PERIOD = ("ano", "mes")


def with_folder_period(
    raw: DataFrame, dictionary: DataFrame, decoded: dict[str, str], number_mode: str
) -> DataFrame:
    """Clean rows stamped with the period of their folder; every row stays.

    What a row says of its own period is left in ``competenciamov``, where validation
    holds it against the folder.  Without folder columns the rows' own period counts.
    """
    if not set(PERIOD) <= set(raw.columns):
        return clean_movements(raw, dictionary, decoded, number_mode)
    folder = {c: f"__folder_{c}" for c in PERIOD}
    kept = raw.withColumnsRenamed(folder)
    cleaned = clean_movements(
        kept, dictionary, decoded, number_mode, list(folder.values())
    )
    year, month = (F.col(folder[c]).cast("int") for c in PERIOD)
    return cleaned.withColumns(
        {
            "ano": year,
            "mes": month,
            "competencia_date": F.make_date(year, month, F.lit(1)).cast(
                cleaned.schema["competencia_date"].dataType
            ),
            "competencia_str": period_text(year, month),
        }
    ).drop(*folder.values())


def clean_stage(
    spark: SparkSession, landing: str, clean_path: str, dictionary: DataFrame,
    decoded: dict[str, str], number_mode: str = "auto", sidecar: str | None = None,
) -> DataFrame:
    """Landing files to the clean table; returns the validation of every period.

    ``sidecar`` names where the validation is kept as JSON, one document per period.
    """
    raw = read_delimited(spark, landing)
    cleaned = with_folder_period(raw, dictionary, decoded, number_mode)
    write_table(cleaned, clean_path, PERIOD)
    clean = spark.read.parquet(clean_path)
    expected = F.format_string("%04d%02d", F.col("ano"), F.col("mes"))
    validation = stage(quality.validate_clean(clean, PERIOD, expected), "validation")
    if sidecar is not None:
        write_json(validation, sidecar)
    return validation


def aggregate_stage(
    spark: SparkSession, clean_path: str, gold_path: str, validation: DataFrame, scopes: Column,
    specs: Sequence[mv.TableSpec] = mv.TABLES,
) -> DataFrame:
    """Clean table to the table matrix; periods with a failed validation are left out."""
    clean = spark.read.parquet(clean_path)
    passed = quality.gate_periods(clean, validation, PERIOD)
    matrix = mv.table_matrix(passed, scopes, specs, PERIOD)
    write_table(matrix, gold_path, ("tabela", *PERIOD))
    return spark.read.parquet(gold_path)
