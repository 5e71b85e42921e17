"""Movement and wage aggregates, alone and as one matrix of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxora.functions.numbers import ratio
from fluxora.operators.order_stats import join_null_safe, quantiles_of_counts
from fluxora.session import stage_counted

FLAGS = {"admissoes": "admissao", "desligamentos": "desligamento", "saldo": "saldomovimentacao"}
METRICS = tuple(FLAGS)
WAGE_QUANTILES = {"salario_mediano": 0.5, "salario_p25": 0.25, "salario_p75": 0.75}
WAGE_STATS = (
    "n_salarios_validos", "salario_medio", "salario_mediano",
    "salario_p25", "salario_p75", "salario_min", "salario_max",
)


def total(col: str) -> Column:
    """Sum as a long, 0 when nothing was summed."""
    return F.coalesce(F.sum(F.col(col).cast("long")), F.lit(0).cast("long"))


def movement_sums(prefix: str = "") -> list[Column]:
    return [total(prefix + source).alias(name) for name, source in FLAGS.items()]


def movement_aggregate(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Hires, separations and net by ``dims``; a NULL dimension is its own group."""
    return df.groupBy(*dims).agg(*movement_sums())


def ordered(df: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Net and hires descending, separations ascending, missing values last."""
    return df.orderBy(
        F.desc_nulls_last("saldo"),
        F.desc_nulls_last("admissoes"),
        F.asc_nulls_last("desligamentos"),
        *[F.asc_nulls_last(c) for c in tiebreak],
    )


def movement_total(df: DataFrame, period: str | None = None) -> DataFrame:
    row = df.agg(*movement_sums())
    return row.select(F.lit(period).alias("competencia"), *METRICS) if period else row


def _wage_counts(df: DataFrame, dims: Sequence[str], wage: str) -> DataFrame:
    """One row per (dims, wage) with its row count and movement sums."""
    clean = F.col(wage).cast("double")
    return df.groupBy(*dims, F.when(~F.isnan(clean), clean).alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"), *movement_sums()
    )


def _wage_sums() -> list[Column]:
    """Sums over (dims, wage) counts that can be added up further."""
    weight = F.when(F.col("__v").isNotNull(), F.col("__n"))
    return [
        *[F.sum(m).alias(m) for m in METRICS],
        F.coalesce(F.sum(weight), F.lit(0).cast("long")).alias("__nv"),
        F.sum(F.col("__v") * F.col("__n")).alias("__total"),
        F.min("__v").alias("salario_min"),
        F.max("__v").alias("salario_max"),
    ]


def _wage_rollup(groups: DataFrame, dims: Sequence[str]) -> DataFrame:
    rolled = groups.groupBy(*dims).agg(
        *[F.sum(m).alias(m) for m in METRICS],
        F.sum("__nv").alias("n_salarios_validos"),
        F.sum("__total").alias("__total"),
        F.min("salario_min").alias("salario_min"),
        F.max("salario_max").alias("salario_max"),
    )
    mean = ratio(F.col("__total"), F.col("n_salarios_validos"))
    return rolled.withColumn("salario_medio", mean).drop("__total")


def _wage_summary(counts: DataFrame, rows: int, dims: Sequence[str]) -> DataFrame:
    """Wage statistics per ``dims`` from staged (dims, wage) counts."""
    simple = counts.groupBy(*dims).agg(*_wage_sums())
    mean = ratio(F.col("__total"), F.col("__nv"))
    simple = simple.withColumn("salario_medio", mean).withColumnRenamed(
        "__nv", "n_salarios_validos"
    )
    valid = counts.where(F.col("__v").isNotNull())
    quantiles = quantiles_of_counts(valid, rows, dims, WAGE_QUANTILES)
    joined = join_null_safe(simple, quantiles, dims, "left")
    return joined.select(*dims, *METRICS, *WAGE_STATS)


def wage_aggregate(df: DataFrame, dims: Sequence[str], wage: str = "salario") -> DataFrame:
    """Movement sums plus count, mean, median, quartiles and range of the wage.

    The fact table is read once; the counts per (dims, wage) are staged because the
    summary and the quantiles both start from them.
    """
    counts, rows = stage_counted(_wage_counts(df, dims, wage), "wage-counts")
    return _wage_summary(counts, rows, dims)


@dataclass(frozen=True)
class TableSpec:
    name: str
    dims: tuple[str, ...]
    wages: bool = False
    scopes: tuple[str, ...] = ("br", "pr", "rmc")

    def full_name(self, scope: str) -> str:
        return self.name if scope == "br" else f"{self.name}_{scope}"


# Table names and their dimensions (fixed values).
_PROFILES = {
    "sexo": ("sexo",),
    "faixa_etaria": ("faixa_etaria",),
    "graudeinstrucao": ("graudeinstrucao",),
    "sexo_faixa_etaria": ("sexo", "faixa_etaria"),
    "sexo_instrucao": ("sexo", "graudeinstrucao"),
    "faixa_etaria_instrucao": ("faixa_etaria", "graudeinstrucao"),
}

TABLES: tuple[TableSpec, ...] = (
    TableSpec("tabela_resumo", (), scopes=("br",)),
    TableSpec("tabela_uf", ("uf",), scopes=("br",)),
    TableSpec("tabela_municipio", ("uf", "municipio")),
    TableSpec("tabela_setor", ("secao",)),
    TableSpec("tabela_ocupacao", ("cbo2002ocupacao",)),
    TableSpec("tabela_pais", ("pais",)),
    TableSpec("tabela_continente", ("continente",)),
    TableSpec("tabela_perfil_racacor", ("racacor",)),
    *(TableSpec(f"tabela_perfil_{name}", dims) for name, dims in _PROFILES.items()),
    *(
        TableSpec(f"tabela_perfil_{name}_salario", dims, wages=True)
        for name, dims in _PROFILES.items()
    ),
)


def matrix_dims(specs: Sequence[TableSpec] = TABLES) -> list[str]:
    return list(dict.fromkeys(d for s in specs for d in s.dims))


def _grouping_number(all_dims: Sequence[str], chosen: Sequence[str]) -> int:
    """Spark's grouping_id: one bit per column, set when the column is rolled up."""
    return sum(
        1 << (len(all_dims) - 1 - i) for i, d in enumerate(all_dims) if d not in chosen
    )


def _maximal_sets(specs: Sequence[TableSpec]) -> list[tuple[str, ...]]:
    """Dimension sets not contained in another one; every table rolls up from one of them."""
    sets = list(dict.fromkeys(s.dims for s in specs))
    return [s for s in sets if not any(set(s) < set(other) for other in sets)]


def _into_tables(
    df: DataFrame, specs: Sequence[TableSpec], dims: Sequence[str], kept: Sequence[str],
    source: dict[TableSpec, int] | None = None,
) -> DataFrame:
    """One copy of each row per (table, scope) it counts in, with foreign dims set to NULL.

    ``source`` names the grouping number (``__gid``) whose rows feed each table.
    """
    scope, gid = F.col("__scope"), F.col("__gid")
    marked = ["__gid"] if source else []
    rows = df.select(F.explode("__scopes").alias("__scope"), *marked, *dims, *kept)
    entries = []
    for spec in specs:
        cells = [
            (F.col(d) if d in spec.dims else F.lit(None).cast("string")).alias(d) for d in dims
        ]
        entry = F.struct(F.lit(spec.name).alias("tabela"), *cells)
        wanted = F.lit(True)
        if not set(spec.scopes) >= {"br", "pr", "rmc"}:
            wanted = wanted & scope.isin(*spec.scopes)
        if source:
            wanted = wanted & (gid == source[spec])
        entries.append(F.when(wanted, entry))
    rows = rows.select(
        scope, F.explode(F.array_compact(F.array(*entries))).alias("__t"), *kept
    )
    name = F.when(scope == "br", F.col("__t.tabela")).otherwise(
        F.concat_ws("_", "__t.tabela", scope)
    )
    return rows.select(name.alias("tabela"), *[F.col("__t")[d].alias(d) for d in dims], *kept)


def table_matrix(
    df: DataFrame,
    scopes: Column,
    specs: Sequence[TableSpec] = TABLES,
    period: Sequence[str] = (),
) -> DataFrame:
    """All tables of the matrix in long form: ``tabela``, period, dims, metrics, wage stats.

    ``scopes`` is the array of scope names a row belongs to.  The facts are aggregated
    only for the widest dimension sets, with the scope array as one more key; smaller
    tables and the scopes themselves roll up from those results.  With wage tables the
    counts per (their dims, wage) are written once and also feed every movement table
    over the same dims.
    """
    period = list(period)
    all_dims = matrix_dims(specs)
    tagged = df.withColumn("__scopes", scopes)
    waged = [s for s in specs if s.wages]
    wage_dims = [d for d in all_dims if any(d in s.dims for s in waged)]
    from_wages = [s for s in specs if waged and not s.wages and set(s.dims) <= set(wage_dims)]
    plain = [s for s in specs if not s.wages and s not in from_wages]
    keys = ["tabela", *period, *all_dims]

    def finish(part: DataFrame) -> DataFrame:
        missing = {
            s: F.lit(None).cast("long" if s == "n_salarios_validos" else "double")
            for s in WAGE_STATS
            if s not in part.columns
        }
        return part.withColumns(missing).select(*keys, *METRICS, *WAGE_STATS)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in METRICS])

    parts = []
    if plain:
        bases = _maximal_sets(plain)
        dims = [d for d in all_dims if any(d in b for b in bases)]
        fixed = ["__scopes", *period]
        widest = tagged.groupingSets([[*b, *fixed] for b in bases], *dims, *fixed).agg(
            F.grouping_id().alias("__gid"), *movement_sums()
        )
        absent = {d: F.lit(None).cast("string") for d in all_dims if d not in dims}
        widest = widest.withColumns(absent) if absent else widest
        source = {}
        for spec in plain:
            base = next(b for b in bases if set(spec.dims) <= set(b))
            source[spec] = _grouping_number([*dims, *fixed], [*base, *fixed])
        rows = _into_tables(widest, plain, all_dims, [*period, *METRICS], source)
        parts.append(finish(summed(rows)))
    if waged:
        fine = ["__scopes", *period, *wage_dims]
        counts, n_rows = stage_counted(_wage_counts(tagged, fine, "salario"), "matrix-wages")

        def into(tables: Sequence[TableSpec], rows: DataFrame, kept: Sequence[str]) -> DataFrame:
            return _into_tables(rows, tables, wage_dims, [*period, *kept])

        def complete(rows: DataFrame) -> DataFrame:
            absent = {d: F.lit(None).cast("string") for d in all_dims if d not in wage_dims}
            return rows.withColumns(absent) if absent else rows

        # One row per fine group carries everything but the quantiles.
        groups = counts.groupBy(*fine).agg(*_wage_sums())
        simple_columns = [*METRICS, "__nv", "__total", "salario_min", "salario_max"]
        if from_wages:
            parts.append(finish(summed(complete(into(from_wages, groups, simple_columns)))))
        table_keys = ["tabela", *period, *wage_dims]
        simple = _wage_rollup(into(waged, groups, simple_columns), table_keys)
        quantiles = quantiles_of_counts(
            counts.where(F.col("__v").isNotNull()),
            n_rows,
            table_keys,
            WAGE_QUANTILES,
            expand=lambda rows, kept: into(waged, rows, kept),
            copies=sum(len(s.scopes) for s in waged),
        )
        joined = join_null_safe(simple, quantiles, table_keys, "left")
        parts.append(finish(complete(joined)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def split_table(matrix: DataFrame, spec: TableSpec, scope: str = "br") -> DataFrame:
    """One table of a (staged) matrix with its own columns only."""
    stats = WAGE_STATS if spec.wages else ()
    name = spec.full_name(scope)
    return matrix.where(F.col("tabela") == name).select(*spec.dims, *METRICS, *stats)
