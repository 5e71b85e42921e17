"""Movement and wage aggregates, the table matrix and small second-stage aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.operators import movement as mv
from fluxora.operators.rank import top_within
from fluxora.plans.binding import movements, scopes
from fluxora.session import stage
from fluxora.workload.base import (
    MOV,
    SCOPE_WHERE,
    SUMS,
    WAGES,
    query,
    r,
    rounded,
)

FLAG_COLUMNS = ["admissao", "desligamento", "saldomovimentacao"]


def _movement(key: str, dims: list[str]) -> None:
    names = ", ".join(dims)

    @query(key, f"WITH {MOV} SELECT {names}, {SUMS} FROM mov GROUP BY {names}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = movements(spark, sf, [*dims, *FLAG_COLUMNS])
        return mv.ordered(mv.movement_aggregate(df, dims), dims)


def _wage(key: str, dims: list[str]) -> None:
    names = ", ".join(dims)

    @query(key, f"WITH {MOV} SELECT {names}, {SUMS}, {WAGES} FROM mov GROUP BY {names}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = movements(spark, sf, [*dims, *FLAG_COLUMNS, "salario"])
        return mv.ordered(rounded(mv.wage_aggregate(df, dims)), dims)


for _key, _dims in {
    "movement_by_uf": ["uf"],
    "movement_by_municipio": ["uf", "municipio"],
    "movement_by_setor": ["secao"],
    "movement_by_ocupacao": ["cbo2002ocupacao"],
    "movement_by_pais": ["pais"],
    "movement_by_continente": ["continente"],
    "movement_by_racacor": ["racacor"],
    "movement_by_sexo": ["sexo"],
    "movement_by_faixa_etaria": ["faixa_etaria"],
    "movement_by_graudeinstrucao": ["graudeinstrucao"],
    "movement_by_sexo_faixa_etaria": ["sexo", "faixa_etaria"],
    "movement_by_sexo_instrucao": ["sexo", "graudeinstrucao"],
    "movement_by_faixa_etaria_instrucao": ["faixa_etaria", "graudeinstrucao"],
    "movement_by_profile3": ["sexo", "faixa_etaria", "graudeinstrucao"],
    # A dimension with missing labels: NULL is kept as a group.
    "movement_by_parcial": ["indtrabparcial"],
}.items():
    _movement(_key, _dims)

for _key, _dims in {
    "wage_by_sexo": ["sexo"],
    "wage_by_faixa_etaria": ["faixa_etaria"],
    "wage_by_graudeinstrucao": ["graudeinstrucao"],
    "wage_by_sexo_faixa_etaria": ["sexo", "faixa_etaria"],
    "wage_by_sexo_instrucao": ["sexo", "graudeinstrucao"],
    "wage_by_faixa_etaria_instrucao": ["faixa_etaria", "graudeinstrucao"],
    "wage_by_municipio_mes": ["municipio", "ano", "mes"],
}.items():
    _wage(_key, _dims)


@query(
    "movement_total",
    f"WITH {MOV} SELECT min(competencia) || '/' || max(competencia) AS competencia, {SUMS} FROM mov",
)
def movement_total(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["competencia", *FLAG_COLUMNS])
    period = F.concat_ws("/", F.min("competencia"), F.max("competencia"))
    return df.agg(period.alias("competencia"), *mv.movement_sums())


def _matrix_sql() -> str:
    dims = mv.matrix_dims()
    parts = []
    for spec in mv.TABLES:
        for scope in spec.scopes:
            cols = ", ".join(d if d in spec.dims else f"NULL::VARCHAR AS {d}" for d in dims)
            stats = WAGES if spec.wages else ", ".join(
                f"NULL::{'BIGINT' if s == 'n_salarios_validos' else 'DOUBLE'} AS {s}"
                for s in mv.WAGE_STATS
            )
            group = f"GROUP BY {', '.join(spec.dims)}" if spec.dims else ""
            parts.append(
                f"SELECT '{spec.full_name(scope)}' AS tabela, {cols}, {SUMS}, {stats} "
                f"FROM mov WHERE {SCOPE_WHERE[scope]} {group}"
            )
    return f"WITH {MOV.replace('mov AS (', 'mov AS MATERIALIZED (', 1)} " + " UNION ALL ".join(parts)


MATRIX_COLUMNS = list(
    dict.fromkeys([*mv.matrix_dims(), "regiao", "uf", *FLAG_COLUMNS, "salario"])
)


@query("table_matrix", _matrix_sql())
def table_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mv.table_matrix(movements(spark, sf, MATRIX_COLUMNS), scopes()))


# Overview blocks: base table and how many rows are shown (fixed values).
OVERVIEW = {
    "tabela_uf": 12, "tabela_municipio": 15, "tabela_setor": 12, "tabela_ocupacao": 12,
    **{
        f"tabela_perfil_{name}{suffix}": n
        for suffix in ("", "_salario")
        for name, n in (
            ("sexo", 10), ("faixa_etaria", 20), ("graudeinstrucao", 20),
            ("sexo_faixa_etaria", 24), ("sexo_instrucao", 24), ("faixa_etaria_instrucao", 24),
        )
    },
}
OVERVIEW_SPECS = [s for s in mv.TABLES if s.name in OVERVIEW or s.name == "tabela_resumo"]


def _overview_sql() -> str:
    parts = []
    for scope, where in SCOPE_WHERE.items():
        parts.append(
            f"SELECT '{scope}' AS escopo, 'kpi' AS bloco, CAST(1 AS INTEGER) AS pos, '' AS rotulo, {SUMS}, "
            f"NULL::DOUBLE AS salario_mediano FROM mov WHERE {where}"
        )
    for spec in OVERVIEW_SPECS:
        if spec.name not in OVERVIEW:
            continue
        for scope in spec.scopes:
            label = "concat_ws(' | ', " + ", ".join(spec.dims) + ")"
            median = "quantile_cont(salario, 0.5::DOUBLE)" if spec.wages else "NULL"
            parts.append(
                f"SELECT * FROM (SELECT '{scope}' AS escopo, '{spec.full_name(scope)}' AS bloco, CAST(row_number() OVER "
                f"(ORDER BY saldo DESC, rotulo) AS INTEGER) AS pos, rotulo, admissoes, desligamentos, saldo, salario_mediano FROM "
                f"(SELECT {label} AS rotulo, {SUMS}, {r(median, 'salario_mediano')} FROM mov WHERE {SCOPE_WHERE[scope]} "
                f"GROUP BY {', '.join(spec.dims)})) WHERE pos <= {OVERVIEW[spec.name]}"
            )
    return f"WITH {MOV.replace('mov AS (', 'mov AS MATERIALIZED (', 1)} " + " UNION ALL ".join(parts)


@query("overview", _overview_sql())
def overview(spark: SparkSession, sf: str) -> DataFrame:
    """Key figures, rankings and profiles of all scopes as one long table."""
    df = movements(spark, sf, MATRIX_COLUMNS)
    matrix = stage(mv.table_matrix(df, scopes(), OVERVIEW_SPECS), "overview")
    name = F.col("tabela")
    scope = F.when(name.endswith("_rmc"), "rmc").when(name.endswith("_pr"), "pr").otherwise("br")
    limits = F.create_map(
        *[
            F.lit(v)
            for s in OVERVIEW_SPECS
            if s.name in OVERVIEW
            for x in s.scopes
            for v in (s.full_name(x), OVERVIEW[s.name])
        ]
    )
    blocks = matrix.where(name != "tabela_resumo").withColumn(
        "rotulo", F.concat_ws(" | ", *mv.matrix_dims(OVERVIEW_SPECS))
    )
    order = [F.desc_nulls_last("saldo"), F.asc("rotulo")]
    shown = top_within(blocks, ["tabela"], order, max(OVERVIEW.values())).where(
        F.col("pos") <= F.element_at(limits, name)
    )
    # The national figures have a table; those of a scope are summed over its territories.
    kpis = (
        matrix.where(name.isin("tabela_resumo", "tabela_municipio_pr", "tabela_municipio_rmc"))
        .groupBy(scope.alias("escopo"))
        .agg(*[F.sum(m).alias(m) for m in mv.METRICS])
    )
    columns = ["escopo", "bloco", "pos", "rotulo", *mv.METRICS, "salario_mediano"]
    rows = shown.withColumns({"escopo": scope, "bloco": name}).select(*columns)
    head = kpis.withColumns(
        {
            "bloco": F.lit("kpi"),
            "pos": F.lit(1),
            "rotulo": F.lit(""),
            "salario_mediano": F.lit(None).cast("double"),
        }
    )
    return rounded(head.select(*columns).unionByName(rows))
