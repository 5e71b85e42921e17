"""Number parsing, coercion and Brazilian number formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxora.functions.text import BLANKS
from fluxora.operators.order_stats import join_null_safe
from fluxora.session import counted_side

# Cell texts read as missing numbers (fixed values).
NULL_TOKENS = ("", "nan", "None", "NA", "N/A", "<NA>", "-", "--")


# Digits, an optional point and exponent; type letters such as ``12d`` are not numbers.
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
# With blanks of any kind (no-break spaces too) at either end.
SPACED_NUMBER = f"^(?:{BLANKS})?({NUMBER})(?:{BLANKS})?$"
SPACED_TOKEN = f"^(?:{BLANKS})?(?:{'|'.join(NULL_TOKENS)})(?:{BLANKS})?$"

# A value named twice in an expression is computed twice, branches of a condition apart.  So
# that a cell costs one pass of its pattern, every rule below names its text once.


def parse_number_br(col: Column) -> Column:
    """``1.234,56`` -> 1234.56; ``R$`` and blanks are dropped, bad text becomes NULL."""
    text = F.replace(F.regexp_replace(col.cast("string"), BLANKS, ""), F.lit("R$"), F.lit(""))
    # Points go, the comma becomes one.  No missing token holds a digit, so none is a number.
    return F.regexp_extract(F.translate(text, ",.", "."), f"^{NUMBER}$", 0).try_cast("double")


def parse_number_plain(col: Column) -> Column:
    return finite(col)


def textual_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns holding at least one cell that is not a plain number: one aggregate row.

    A column counts as numeric only if every non-missing cell already parses, so the
    comma format is applied per column, never cell by cell.
    """
    if not columns:
        return []
    row = df.agg(*[any_not_plain(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def any_not_plain(name: str) -> Column:
    """Aggregate: does any present cell of the column fail to read as a plain number?"""
    cell = F.col(name)
    return F.max(cell.isNotNull() & finite(cell).isNull() & ~cell.cast("string").rlike(SPACED_TOKEN))


def to_numbers(
    df: DataFrame, columns: list[str], mode: str = "auto", per: Sequence[str] = ()
) -> DataFrame:
    """Convert text columns to double with one rule per column.

    ``mode``: "br" and "plain" force a rule; "auto" inspects each whole column first, or,
    with ``per``, the column within each group of those keys (the period of a file).
    """
    if mode not in ("auto", "br", "plain"):
        raise ValueError(f"unknown number mode: {mode!r}")
    present = [c for c in columns if c in df.columns]
    if mode == "auto" and per and present:
        flags = {c: f"__br_{c}" for c in present}
        rules = df.groupBy(*per).agg(*[any_not_plain(c).alias(f) for c, f in flags.items()])
        ruled = join_null_safe(df, counted_side(rules, "number-rules"), list(per))
        return ruled.withColumns(
            {
                c: F.when(F.col(f), parse_number_br(F.col(c))).otherwise(
                    parse_number_plain(F.col(c))
                )
                for c, f in flags.items()
            }
        ).drop(*flags.values())
    text_cols = set(textual_columns(df, present)) if mode == "auto" else set()
    use_br = {c: mode == "br" or c in text_cols for c in present}
    return df.withColumns(
        {
            c: parse_number_br(F.col(c)) if use_br[c] else parse_number_plain(F.col(c))
            for c in present
        }
    )


def finite(col: Column) -> Column:
    """Number or NULL: text that does not parse, NaN and infinities are missing."""
    number = F.regexp_extract(col.cast("string"), SPACED_NUMBER, 1).try_cast("double")
    return F.get(F.filter(F.array(number), lambda n: F.abs(n) != float("inf")), F.lit(0))


def valid_positive(col: Column) -> Column:
    number = col.try_cast("double")
    return F.when((number > 0) & ~F.isnan(number), number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with NULL for a zero or missing base."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def format_br(col: Column, decimals: int) -> Column:
    """1234.5 -> ``1.234,50``; missing -> ``--``."""
    number = finite(col)
    return F.coalesce(F.translate(F.format_number(number, decimals), ",.", ".,"), F.lit("--"))


def format_currency_br(col: Column) -> Column:
    text = format_br(col, 2)
    return F.when(text != "--", F.concat(F.lit("R$ "), text)).otherwise(text)


def format_ordinal(col: Column) -> Column:
    number = F.round(finite(col)).cast("long")
    return F.coalesce(F.concat(number.cast("string"), F.lit("º")), F.lit("--"))
