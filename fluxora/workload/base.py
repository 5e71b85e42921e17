"""Registry of queries and their SQL twins, and the SQL text they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin (None: rows-only)."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key: {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, coarse: Sequence[str] = ()) -> DataFrame:
    """Round every double (2 digits for ``coarse`` columns); -0.0 becomes 0.0."""

    def show(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return (F.round(col, 2 if field.name in coarse else digits) + F.lit(0.0)).alias(
                field.name
            )
        return col

    return df.select(*[show(f) for f in df.schema.fields])


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


_BANDS = """CASE WHEN p_size + 14 < 18 THEN 'Até 17 anos' WHEN p_size + 14 <= 24 THEN '18 a 24 anos'
      WHEN p_size + 14 <= 29 THEN '25 a 29 anos' WHEN p_size + 14 <= 39 THEN '30 a 39 anos'
      WHEN p_size + 14 <= 49 THEN '40 a 49 anos' WHEN p_size + 14 <= 64 THEN '50 a 64 anos'
      ELSE '65 anos ou mais' END"""

MOV = f"""mov AS (
  SELECT l_orderkey AS chave, l_linenumber AS linha,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS saldomovimentacao,
    CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS admissao,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS desligamento,
    CAST(year(l_shipdate) AS INTEGER) AS ano, CAST(month(l_shipdate) AS INTEGER) AS mes,
    CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS semestre,
    strftime(l_shipdate, '%Y-%m') AS competencia, l_shipdate AS data,
    l_linestatus AS sexo, l_quantity AS horascontratuais,
    CASE WHEN l_discount <> 0 THEN l_extendedprice END AS salario,
    l_extendedprice AS valorsalariofixo,
    CASE WHEN l_tax = 0 THEN 'Sim' WHEN l_tax <> 0.08::DOUBLE THEN 'Não' END AS indtrabparcial,
    CASE WHEN l_discount >= 0.10::DOUBLE THEN 'Sim' ELSE 'Não' END AS indtrabintermitente,
    CASE WHEN length(l_suppkey::VARCHAR) < 7 THEN lpad(l_suppkey::VARCHAR, 7, '0')
      ELSE l_suppkey::VARCHAR END AS cod_municipio,
    s_name AS municipio, sn.n_name AS uf, sr.r_name AS regiao,
    o_orderstatus AS categoria, o_orderpriority AS graudeinstrucao, c_mktsegment AS racacor,
    cn.n_name AS pais, cr.r_name AS continente,
    p_type AS secao, p_brand AS subclasse, p_name AS cbo2002ocupacao,
    CAST(p_size + 14 AS DOUBLE) AS idade, {_BANDS} AS faixa_etaria
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region cr ON cn.n_regionkey = cr.r_regionkey)"""

PLACES = """places AS (
  SELECT CASE WHEN length(s_suppkey::VARCHAR) < 7 THEN lpad(s_suppkey::VARCHAR, 7, '0')
      ELSE s_suppkey::VARCHAR END AS cod_municipio,
    s_name AS municipio, n_name AS uf, r_name AS regiao, s_acctbal AS saldo_conta
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

IN_PR = "regiao = 'EUROPE'"
IN_RMC = "regiao = 'EUROPE' AND uf IN ('NATION_3', 'NATION_8', 'NATION_13')"
SCOPE_WHERE = {"br": "TRUE", "pr": IN_PR, "rmc": IN_RMC}

SUMS = """CAST(coalesce(sum(admissao), 0) AS BIGINT) AS admissoes,
  CAST(coalesce(sum(desligamento), 0) AS BIGINT) AS desligamentos,
  CAST(coalesce(sum(saldomovimentacao), 0) AS BIGINT) AS saldo"""

WAGES = f"""CAST(count(salario) AS BIGINT) AS n_salarios_validos,
  {r('avg(salario)', 'salario_medio')}, {r('quantile_cont(salario, 0.5::DOUBLE)', 'salario_mediano')},
  {r('quantile_cont(salario, 0.25::DOUBLE)', 'salario_p25')},
  {r('quantile_cont(salario, 0.75::DOUBLE)', 'salario_p75')},
  {r('min(salario)', 'salario_min')}, {r('max(salario)', 'salario_max')}"""


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"fluxora.workload.{name}")


MODULES: list[str] = [
    "aggregates",
    "cleaning",
    "ranking",
    "territories",
    "indices",
    "validation",
    "layers",
    "landing",
    "jobs",
    "geography",
]
