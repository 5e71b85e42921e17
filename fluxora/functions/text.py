"""Text normalisation as built-in column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin blocks whose letters are folded by rule (Latin-1, Extended-A/B, Additional).
LATIN_RANGES = ((0x00A0, 0x0250), (0x1E00, 0x1F00))


@lru_cache(maxsize=1)
def latin_fold() -> tuple[str, str]:
    """Accented letters and, position by position, their plain letter."""
    accented, plain = [], []
    for start, stop in LATIN_RANGES:
        for code in range(start, stop):
            base = [
                c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)
            ]
            if len(base) == 1 and base[0] != chr(code) and base[0].isalpha():
                accented.append(chr(code))
                plain.append(base[0])
    return "".join(accented), "".join(plain)


def strip_accents(col: Column) -> Column:
    """Drop accents from Latin text; loose combining marks are dropped as well."""
    accented, plain = latin_fold()
    return F.regexp_replace(F.translate(col, accented, plain), r"\p{Mn}+", "")


def strip_accents_any_script(col: Column) -> Column:
    """NFKD folding for scripts outside the Latin blocks, one Arrow batch at a time."""

    @F.pandas_udf(T.StringType())
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.str.normalize("NFKD").map(
                lambda text: "".join(c for c in text if not unicodedata.combining(c)),
                na_action="ignore",
            )

    return fold(col)


# Every Unicode blank, as one regular-expression class.
BLANKS = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def clean_text(col: Column) -> Column:
    """Trim and collapse whitespace; NULL stays NULL."""
    return F.trim(F.regexp_replace(col, BLANKS, " "))


def upper_key(col: Column) -> Column:
    """Upper-case, accent-free, single-spaced label."""
    return F.upper(clean_text(strip_accents(col)))


def join_key(col: Column) -> Column:
    """``upper_key`` with punctuation as spaces; empty and "nan" become NULL."""
    spaced = clean_text(F.regexp_replace(strip_accents(col), r"[.,;:/\-_|]+", " "))
    key = F.upper(spaced)
    return F.when((key != "") & (F.lower(F.trim(col)) != "nan"), key)


# Spellings of a missing code (fixed values).
MISSING_CODES = ("", "nan", "none", "null", "<na>")


def is_code_missing(col: Column) -> Column:
    text = col.cast("string")
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING_CODES)


def format_code(col: Column, width: int = 7) -> Column:
    """Digits without a trailing ``.0``, zero-padded to ``width``; longer codes stay whole."""
    text = F.trim(col.cast("string"))
    text = F.when(text.rlike(r"^\d+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text)
    padded = F.when(
        text.rlike(r"^\d+$") & (F.length(text) < width), F.lpad(text, width, "0")
    ).otherwise(text)
    return F.when(~is_code_missing(col), padded)


def header_name(name: str) -> str:
    """Column-name form of a raw header: trimmed, lower, accent-free, ``_`` for blanks."""
    folded = unicodedata.normalize("NFKD", name.strip().lower())
    return "".join(c for c in folded if not unicodedata.combining(c)).replace(" ", "_")


def header_key(col: Column) -> Column:
    """The same rule as :func:`header_name` for header text held in a column."""
    return F.replace(strip_accents(F.lower(F.trim(col))), F.lit(" "), F.lit("_"))


def valid_category(col: Column) -> Column:
    """Trimmed label, NULL when empty or "nan"."""
    text = F.trim(col.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def is_yes(col: Column) -> Column:
    """Yes-flag; NULL stays NULL."""
    return F.upper(F.trim(col)) == "SIM"
