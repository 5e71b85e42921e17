"""Delimited landing files whose headers differ: read by header group, bad lines set aside.

The first lines of every file tell its encoding, separator and header.  Files with the same
normalised header, separator and encoding form a group and are read together under their own
schema; groups are aligned by column name.  So a month with another column order, with more or
with fewer columns keeps every value under its own name.

Nothing is lost silently.  Every data line is either a clean row or a rejected one, kept with
its file and the reason; every file is either read or refused as a whole, with the reason.

The driver holds file names by group (the same metadata Spark's file index holds) and one plan
branch per distinct header.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxora.functions.text import header_key
from fluxora.sources.files import listing, probe

# Java's names of the encodings that the probe tells apart (fixed values).
CHARSETS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
UNREADABLE = "\ufffd"  # what a decoder puts in place of bytes it cannot read
BAD_LINE = "__linha"
LINE_FILE = "__arquivo"
REASON = "__motivo"
MARKS = (BAD_LINE, LINE_FILE, REASON)


@dataclass(frozen=True)
class Landing:
    """What a scan found: every data line of the files that can be read, and a row per file.

    Blank lines are no data.
    """

    lines: DataFrame
    files: DataFrame

    @property
    def rows(self) -> DataFrame:
        """The clean lines: all columns, as text."""
        return self.lines.filter(F.col(BAD_LINE).isNull()).drop(*MARKS)

    @property
    def rejected(self) -> DataFrame:
        """arquivo, linha and motivo of the lines that are no rows."""
        return self.lines.filter(F.col(BAD_LINE).isNotNull()).select(
            F.col(LINE_FILE).alias("arquivo"), F.col(BAD_LINE).alias("linha"),
            F.col(REASON).alias("motivo"),
        )

    @property
    def strict(self) -> DataFrame:
        """:attr:`rows`, but a bad line or a refused file is an error that names it."""
        refused = self.files.filter("recusa IS NOT NULL").limit(10).collect()
        if refused:
            raise ValueError(
                "files that cannot be read: " + "; ".join(f"{r['path']} ({r['recusa']})" for r in refused)
            )
        message = F.concat_ws(" ", F.col(REASON), F.lit("line in"), F.col(LINE_FILE), F.lit(":"), F.col(BAD_LINE))
        sound = F.when(F.col(BAD_LINE).isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
        return self.lines.filter(sound).drop(*MARKS)


def parsed_headers(probed: DataFrame, separators: Sequence[str] = (";",)) -> DataFrame:
    """Separator (the first of ``separators`` in the header) and normalised header columns."""
    text = F.regexp_replace("cabecalho", "^\\uFEFF", "")
    sep = F.coalesce(*[F.when(F.contains(text, F.lit(s)), F.lit(s)) for s in separators])
    found = probed.withColumn("cabecalho", text).withColumn("separador", sep)
    quoted = F.concat(F.lit("\\Q"), F.col("separador"), F.lit("\\E"))
    names = F.split(F.translate("cabecalho", '"', ""), quoted, -1)
    has = F.col("separador").isNotNull()
    return found.withColumns(
        {
            "separador_ok": has,
            "colunas": F.when(has, F.transform(names, lambda h: header_key(h))).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )


def refusal(required: Sequence[str]) -> Column:
    """Why a file cannot be read by name; NULL when it can."""
    wanted = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    missing = F.array_except(wanted, "colunas")
    twice = F.size("colunas") != F.size(F.array_distinct("colunas"))
    return (
        F.when(F.col("length") == 0, "empty")
        .when(F.trim("cabecalho") == "", "no_header")
        .when(~F.col("separador_ok"), "separator")
        .when(F.exists("colunas", lambda c: c == ""), "unnamed_column")
        .when(twice, "duplicate_column")
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
    )


def line_reason(raw: Column, sep: str, width: int) -> Column:
    """Why a line is no row of its header's width."""
    fields = F.size(F.split(raw, f"\\Q{sep}\\E", -1))
    return (
        F.when(raw.contains(UNREADABLE), "undecodable")
        .when(fields < width, "short")
        .when(fields > width, "long")
        .otherwise("malformed")
    )


def read_group(
    spark: SparkSession, root: str, paths: Sequence[str], columns: Sequence[str], sep: str,
    encoding: str,
) -> DataFrame:
    """Every line of files that share a header, with its file and, if bad, its text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD_LINE]])
    reader = spark.read.schema(schema).options(
        header=True, sep=sep, encoding=encoding, enforceSchema=True, mode="PERMISSIVE",
        columnNameOfCorruptRecord=BAD_LINE,
        # Only a parser that sees all fields of a line can tell that it has too few or many.
        columnPruning=False,
    )
    inside = root.rpartition(":")[2]
    if any("=" in p.rpartition(inside)[2] for p in paths):
        reader = reader.option("basePath", root)
    lines = reader.csv(list(paths)).withColumn(LINE_FILE, F.col("_metadata.file_path"))
    damaged = F.exists(F.array(*[F.col(f"`{c}`") for c in columns]), lambda v: v.contains(UNREADABLE))
    whole = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns])
    bad = F.coalesce(BAD_LINE, F.when(damaged, whole))
    return lines.withColumn(BAD_LINE, bad).withColumn(
        REASON, F.when(F.col(BAD_LINE).isNotNull(), line_reason(F.col(BAD_LINE), sep, len(columns)))
    )


def scan(
    spark: SparkSession, root: str, required: Sequence[str] = (),
    separators: Sequence[str] = (";",), pattern: str = "*.csv", encoding: str | None = None,
    only: DataFrame | None = None,
) -> Landing:
    """Read every file below ``root`` by its own header.

    ``required`` columns must be in a file's header, else the file is refused and named in
    ``files``.  ``only`` (a table with a ``path`` column) leaves out all other files.  The
    clean rows hold the union of all columns; one that a file lacks is NULL there.
    """
    listed = listing(spark, root, pattern)
    if only is not None:
        listed = listed.join(only.select("path").distinct(), "path", "left_semi")
    parsed = parsed_headers(probe(listed), separators)
    used = F.lit(encoding) if encoding else F.element_at(
        F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair]), F.col("codificacao")
    )
    files = parsed.select(
        "path", "length", "codificacao", "separador", "colunas", "linhas",
        used.alias("charset"), refusal(required).alias("recusa"),
    )
    groups = (
        files.filter("recusa IS NULL")
        .groupBy("colunas", "separador", "charset")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .collect()
    )
    groups.sort(key=lambda g: (-len(g["paths"]), g["colunas"], g["separador"], g["charset"]))
    base = root.rstrip("/")
    parts = [
        read_group(spark, base, g["paths"], g["colunas"], g["separador"], g["charset"]) for g in groups
    ]
    if not parts:
        marks = [f"{m} string" for m in (*required, *MARKS)]
        return Landing(spark.createDataFrame([], ", ".join(marks)), files)
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return Landing(lines, files)
