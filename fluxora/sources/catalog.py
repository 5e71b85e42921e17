"""Catalogue of the published tables, its rollups and the readiness report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.sources.files import footers, listing, path_value

# Granularity by exact base name, then by the first matching part (fixed values).
EXACT_GRANULARITY = {
    "tabela_resumo": "resumo",
    "tabela_uf": "uf",
    "tabela_municipio": "municipio",
    "tabela_setor": "setor",
    "tabela_ocupacao": "ocupacao",
    "tabela_pais": "pais",
    "tabela_continente": "continente",
}
PART_GRANULARITY = (
    ("salario", "salario"),
    ("racacor", "perfil_racacor"),
    ("sexo", "perfil_sexo"),
    ("faixa_etaria", "perfil_faixa_etaria"),
    ("graudeinstrucao", "perfil_instrucao"),
    ("grau_instrucao", "perfil_instrucao"),
    ("perfil", "perfil"),
)


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, "_(pr|rmc)$", "")


def scope_of(name: Column) -> Column:
    return F.when(name.endswith("_rmc"), "rmc").when(name.endswith("_pr"), "parana").otherwise("brasil")


def granularity_of(name: Column) -> Column:
    base = base_name(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for exact, label in EXACT_GRANULARITY.items():
        out = out.when(base == exact, label)
    for part, label in PART_GRANULARITY:
        out = out.when(F.lower(base).contains(part), label)
    return out.otherwise("desconhecida")


def is_legacy(name: Column) -> Column:
    return name.rlike("^tabela_perfil(_pr|_rmc)?$")


def catalog(
    spark: SparkSession, root: str, current: Sequence[str], period: Sequence[str] = ("ano", "mes")
) -> DataFrame:
    """One row per (table, period) from the file listing and the footers of the Parquet copy.

    Layout: ``root/{parquet,csv}/tabela=<name>/<period folders>/``.
    """
    period = list(period)
    files = listing(spark, f"{root}/parquet", "*.parquet").withColumn(
        "formato", F.lit("parquet")
    ).unionByName(
        listing(spark, f"{root}/csv", "*.csv").withColumn("formato", F.lit("csv"))
    )
    keyed = files.select(
        path_value("tabela").alias("tabela"),
        *[path_value(p).try_cast("int").alias(p) for p in period],
        "formato",
        "length",
        "modificationTime",
    )
    if "mes" in period:
        keyed = keyed.where(F.col("mes").between(1, 12))
    keys = ["tabela", *period]
    per_table = keyed.groupBy(*keys).agg(
        F.max(F.col("formato") == "csv").alias("has_csv"),
        F.max(F.col("formato") == "parquet").alias("has_parquet"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("modificado"),
    )
    # Folder columns are in no footer, so a file's columns are the table's own.
    parquet = files.where((F.col("formato") == "parquet") & (F.col("length") > 0))
    told = footers(parquet.repartition(F.col("path"))).select(
        path_value("tabela").alias("tabela"),
        *[path_value(p).try_cast("int").alias(p) for p in period],
        "row_count", "present",
    )
    counted = told.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"),
        # The columns of one table: as many as its schema has.
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("present")))).alias("columns"),
    )
    name = F.col("tabela")
    known = name.isin(*current)
    notes = F.array_compact(
        F.array(
            F.when(~known, "not_current"),
            F.when(is_legacy(name), "legacy"),
            F.when(F.col("has_csv") & ~F.col("has_parquet"), "csv_only"),
            F.when(F.col("has_parquet") & ~F.col("has_csv"), "parquet_only"),
        )
    )
    joined = per_table.join(counted, keys, "left")
    return joined.select(
        *keys,
        scope_of(name).alias("scope"),
        granularity_of(name).alias("granularity"),
        "has_csv",
        "has_parquet",
        F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"),
        F.coalesce(F.size("columns"), F.lit(0)).alias("column_count"),
        "columns",
        known.alias("is_current"),
        (is_legacy(name) | ~known).alias("is_legacy"),
        F.array_join(notes, ";").alias("notes"),
        "bytes",
        "modificado",
    )


def filter_catalog(
    table: DataFrame,
    year: int | None = None,
    month: int | None = None,
    scope: str | None = None,
    granularity: str | None = None,
    legacy: bool | None = None,
) -> DataFrame:
    """Optional filters; ``pr`` and ``br`` are accepted as scope aliases."""
    alias = {"pr": "parana", "br": "brasil"}
    wanted = {
        "ano": year,
        "mes": month,
        "scope": alias.get(scope, scope) if scope else None,
        "granularity": granularity,
        "is_legacy": legacy,
    }
    for column, value in wanted.items():
        if value is not None:
            table = table.where(F.col(column) == F.lit(value))
    return table


def partition_summary(table: DataFrame, period: Sequence[str]) -> DataFrame:
    """Per period: tables, format mismatches and tables other periods have.

    The sets hold table names, a list fixed by the matrix specification.
    """
    every = table.where("is_current").agg(F.collect_set("tabela")).scalar()

    def names(condition: Column, alias: str) -> Column:
        picked = F.collect_set(F.when(condition, F.col("tabela")))
        return F.array_join(F.sort_array(picked), ",").alias(alias)

    grouped = table.groupBy(*period).agg(
        F.count(F.lit(1)).alias("tabelas"),
        F.sum("row_count").alias("linhas"),
        names(F.col("has_csv") & ~F.col("has_parquet"), "csv_sem_parquet"),
        names(F.col("has_parquet") & ~F.col("has_csv"), "parquet_sem_csv"),
        names(F.col("is_legacy"), "suspeitas"),
        F.collect_set("tabela").alias("__names"),
    )
    missing = F.array_join(F.sort_array(F.array_except("__every", "__names")), ",")
    return grouped.withColumn("__every", every).withColumn("faltando", missing).drop(
        "__every", "__names"
    )


def rollup(table: DataFrame, period: Sequence[str]) -> DataFrame:
    """Per table: its periods in order and its total rows (one entry per calendar period)."""
    parts = [F.format_string("%02d", F.col(p)) for p in period]
    return table.groupBy("tabela").agg(
        F.array_join(F.sort_array(F.collect_set(F.concat_ws("-", *parts))), ",").alias("periodos"),
        F.sum("row_count").alias("linhas"),
        F.max("is_legacy").alias("is_legacy"),
    )


def available_tables(table: DataFrame) -> DataFrame:
    """Distinct base names with the scope suffix stripped."""
    return table.select(base_name(F.col("tabela")).alias("tabela")).distinct()


def catalog_issues(table: DataFrame, required: Sequence[str], period: Sequence[str]) -> DataFrame:
    """Required tables that are missing or incomplete are critical, the rest are warnings."""
    checked = table.select(
        *period,
        "tabela",
        F.when(F.col("row_count") == 0, "empty")
        .when(~F.col("has_parquet") | ~F.col("has_csv"), "format_mismatch")
        .when(F.col("is_legacy"), "legacy")
        .alias("problema"),
    ).where(F.col("problema").isNotNull())
    wanted = table.select(*period).distinct().withColumn(
        "tabela", F.explode(F.array(*[F.lit(n) for n in required]))
    )
    absent = wanted.join(table.select(*period, "tabela"), [*period, "tabela"], "left_anti")
    found = checked.unionByName(absent.withColumn("problema", F.lit("missing")))
    level = F.when(F.col("tabela").isin(*required), "critical").otherwise("warning")
    return found.withColumn("nivel", level)


def readiness(
    table: DataFrame, issues: DataFrame, default: dict[str, int], gold_status: DataFrame
) -> DataFrame:
    """Named checks and the problem list as one row."""
    period = list(default)
    is_default = F.lit(True)
    for name, value in default.items():
        is_default = is_default & (F.col(name) == value)
    checks = {
        "competencias_available": table.select(*period).distinct().agg(F.count(F.lit(1)) > 0),
        "default_available": table.agg(F.coalesce(F.max(is_default), F.lit(False))),
        "no_critical_issue": issues.agg(F.count_if(F.col("nivel") == "critical") == 0),
        "gold_status_ok": gold_status.agg(
            F.coalesce(F.max(F.col("status").isin("ok", "warning")), F.lit(False))
        ),
    }
    row = table.agg(F.count_distinct(*period).alias("n_competencias"))
    row = row.select("*", *[c.scalar().alias(n) for n, c in checks.items()])
    ready = F.lit(True)
    for name in checks:
        ready = ready & F.col(name)
    problems = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in checks]))
    return row.select(
        "*",
        F.when(ready, "ready").otherwise("not_ready").alias("status"),
        F.array_join(problems, ",").alias("problemas"),
    )
