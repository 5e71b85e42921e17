"""Bands, period labels and code lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age bands: upper age (inclusive) and label (fixed values).
AGE_BANDS = (
    (24, "18 a 24 anos"),
    (29, "25 a 29 anos"),
    (39, "30 a 39 anos"),
    (49, "40 a 49 anos"),
    (64, "50 a 64 anos"),
)
AGE_UNDER_18 = "Até 17 anos"
AGE_OVER_64 = "65 anos ou mais"
AGE_UNKNOWN = "Ignorado"
AGE_ORDER = (AGE_UNDER_18, *(label for _, label in AGE_BANDS), AGE_OVER_64)

# Representative age per source band code (fixed values); "0NA" is missing.
BAND_AGE = {"01": 17, "02": 21, "03": 29, "04": 39, "05": 49, "06": 59, "07": 65}
BAND_MISSING = "0NA"

# Month names (fixed values).
MONTHS = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)


def age_band(age: Column) -> Column:
    band = F.when(age.isNull() | F.isnan(age.cast("double")), AGE_UNKNOWN)
    band = band.when(age < 18, AGE_UNDER_18)
    for upper, label in AGE_BANDS:
        band = band.when(age <= upper, label)
    return band.otherwise(AGE_OVER_64)


def band_code(col: Column) -> Column:
    """``3``, ``3.0``, ``"03"`` and ``03`` are the same code; missing spellings are NULL."""
    text = F.btrim(F.trim(col.cast("string")), F.lit('"'))
    text = F.when(~F.lower(text).isin("", "nan", "none", "<na>"), text)
    text = F.regexp_replace(text, r"\.0$", "")
    return F.when(text.rlike(r"^\d$"), F.lpad(text, 2, "0")).otherwise(text)


def band_to_age(col: Column) -> Column:
    code = band_code(col)
    table = F.create_map(*[F.lit(v) for pair in BAND_AGE.items() for v in pair])
    return F.element_at(table, code).cast("double")


def band_is_unknown(col: Column) -> Column:
    code = band_code(col)
    return code.isNotNull() & ~code.isin(*BAND_AGE, BAND_MISSING)


def period_text(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))


def period_label(year: Column, month: Column) -> Column:
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat(F.element_at(names, month.cast("int")), F.lit(" de "), year.cast("string"))


def parse_period(col: Column) -> Column:
    """Month start from ``YYYYMM`` (a trailing ``.0`` is dropped); anything else is NULL."""
    digits = F.regexp_extract(F.trim(col.cast("string")), r"^(\d{6})(?:\.0)?\z", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMM"))


def lookup(col: Column, table: dict[str, str]) -> Column:
    entries = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.element_at(entries, col)


def resolve_two_letter(col: Column, by_name: dict[str, str], normalise) -> Column:
    """Two letters pass through in upper case, otherwise look the normalised name up."""
    text = F.trim(col)
    return F.when(text.rlike("^[A-Za-z]{2}$"), F.upper(text)).otherwise(
        lookup(normalise(col), by_name)
    )
