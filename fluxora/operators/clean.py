"""Raw rows to clean movements: headers, periods, numbers, flags, bands and contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxora.functions.labels import (
    age_band,
    band_is_unknown,
    band_to_age,
    parse_period,
    period_text,
)
from fluxora.functions.numbers import to_numbers
from fluxora.functions.text import clean_text, header_name
from fluxora.operators.territory import decode

# Column contract of the landing files and of clean movements (fixed values).
REQUIRED_INPUT = (
    "competenciamov", "saldomovimentacao", "horascontratuais", "salario", "valorsalariofixo",
)
RECOMMENDED_INPUT = (
    "regiao", "uf", "municipio", "secao", "subclasse", "cbo2002ocupacao", "graudeinstrucao",
    "idade", "racacor", "sexo", "tipomovimentacao",
)
DERIVED = ("competencia_date", "admissao", "desligamento", "faixa_etaria")
CRITICAL = ("horascontratuais", "salario", "valorsalariofixo", "idade", "saldomovimentacao")
MEASURES = ("idade", "horascontratuais", "salario", "valorsalariofixo", "saldomovimentacao")
SOURCE_RENAMES = {"nivel_instrucao": "graudeinstrucao", "faixa_horas_contrat": "horascontratuais"}


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[header_name(c) for c in df.columns])


def rename_source(df: DataFrame, renames: dict[str, str] = SOURCE_RENAMES) -> DataFrame:
    """Rename source columns; every source name must be present."""
    missing = [c for c in renames if c not in df.columns]
    if missing:
        raise ValueError("missing source columns: " + ", ".join(missing))
    return df.withColumnsRenamed(renames)


def with_columns_of(
    df: DataFrame, essential: Sequence[str], optional: dict[str, str]
) -> DataFrame:
    """Add missing optional columns as typed NULLs; a missing essential column is an error."""
    missing = [c for c in essential if c not in df.columns]
    if missing:
        raise ValueError("missing essential columns: " + ", ".join(missing))
    absent = {c: t for c, t in optional.items() if c not in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()}) if absent else df


def stamp_period(df: DataFrame, source: str) -> DataFrame:
    """ano, mes, competencia_str and competencia_date from a ``YYYYMM`` column."""
    start = parse_period(F.col(source))
    return df.withColumn("competencia_date", start).withColumns(
        {
            "ano": F.year("competencia_date"),
            "mes": F.month("competencia_date"),
            "competencia_str": F.when(
                F.col("competencia_date").isNotNull(),
                period_text(F.year("competencia_date"), F.month("competencia_date")),
            ),
        }
    )


def period_equals(col: Column, year: int, month: int) -> Column:
    """Text period equal to one month, tolerating blanks and a trailing ``.0``."""
    text = F.regexp_replace(F.trim(col.cast("string")), r"\.0$", "")
    return text == f"{year:04d}{month:02d}"


def in_period_range(
    year: Column, month: Column, start: tuple[int, int], end: tuple[int, int]
) -> Column:
    """Inclusive month range; a reversed range is put in order."""
    low, high = sorted((start, end))
    number = year * 100 + month
    return number.between(low[0] * 100 + low[1], high[0] * 100 + high[1])


def up_to_period(year: Column, month: Column, last: tuple[int, int]) -> Column:
    return (year < last[0]) | ((year == last[0]) & (month <= last[1]))


def movement_flags(df: DataFrame, sign: str = "saldomovimentacao") -> DataFrame:
    """Drop rows without a sign; 1 is a hire, -1 a separation, others are neither."""
    return df.where(F.col(sign).isNotNull()).withColumns(
        {
            "admissao": (F.col(sign) == 1).cast("int"),
            "desligamento": (F.col(sign) == -1).cast("int"),
        }
    )


def age_from_band(df: DataFrame, band: str, age: str = "idade") -> DataFrame:
    """Representative age per band code; an unknown code fails the job and is named."""
    message = F.concat(F.lit("unmapped age band: "), F.col(band).cast("string"))
    checked = F.when(
        band_is_unknown(F.col(band)), F.raise_error(message).cast("double")
    ).otherwise(band_to_age(F.col(band)))
    return df.withColumn(age, checked)


def unknown_bands(df: DataFrame, band: str) -> DataFrame:
    return (
        df.where(band_is_unknown(F.col(band)))
        .groupBy(F.col(band).alias("codigo"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def clean_movements(
    raw: DataFrame,
    dictionary: DataFrame,
    decoded: dict[str, str],
    number_mode: str = "auto",
    file_period: Sequence[str] = ("ano", "mes"),
) -> DataFrame:
    """Raw delimited rows (all text) to typed, decoded movements.

    ``file_period`` names the columns that tell monthly files apart: the number format is
    decided for each of them.
    """
    df = normalize_headers(raw)
    if "saldomovimentacao" not in df.columns:
        raise ValueError("column saldomovimentacao is required")
    df = stamp_period(df, "competenciamov")
    df = to_numbers(df, list(MEASURES), number_mode, file_period)
    df = df.withColumn(
        "faixa_etaria",
        age_band(F.col("idade")) if "idade" in df.columns else F.lit("Ignorado"),
    )
    df = movement_flags(df)
    texts = [n for n, t in df.dtypes if t == "string"]
    df = df.withColumns({c: clean_text(F.col(c)) for c in texts})
    return decode(df, dictionary, {c: d for c, d in decoded.items() if c in df.columns})
