"""Binds the star-schema test tables to the flat movement schema.

A movement is a line item: the return flag is its sign, the supplier its territory, the
customer its origin and the part its activity.  Dimensions are joined only when one of
their columns is asked for, so a query over states never reads parts or orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.functions.labels import age_band
from fluxora.operators.index_frozen import IndexSpec, load_spec
from fluxora.operators.territory import scope_array

STAR_SPEC = Path(__file__).resolve().parent.parent / "spec" / "star.json"

AREA_STATES = ("NATION_3", "NATION_8", "NATION_13")
STATE_REGION = "EUROPE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_INPUT = 1 << 30
PART_BYTES = 4 << 20


def spread(df: DataFrame, key: str, joined: bool = False) -> DataFrame:
    """Hash a scan over all cores, in parts of some 4 MB of its files.

    A table under 1 GiB may be a single file with a single row group, which one task
    would read and then aggregate alone.  Larger inputs keep their own splits, unless they
    are ``joined`` by ``key`` next, which has to deal them out anyway.  The number of parts
    grows with the table, so that one part does not.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SMALL_INPUT and not joined:
        return df
    parts = max(df.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES)
    return df.repartition(parts, key)


def star_spec() -> IndexSpec:
    return load_spec(STAR_SPEC)


PLACE = ("municipio", "uf", "regiao")
ORDER = ("categoria", "graudeinstrucao")
CUSTOMER = ("racacor", "pais", "continente")
PART = ("secao", "subclasse", "cbo2002ocupacao", "idade", "faixa_etaria")


def padded_code(key: str) -> Column:
    text = F.col(key).cast("string")
    return F.when(F.length(text) < 7, F.lpad(text, 7, "0")).otherwise(text)


def column_rules() -> dict[str, Column]:
    """Movement column -> expression over the joined star tables."""
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1)
    month = F.month("l_shipdate")
    return {
        "chave": F.col("l_orderkey"),
        "linha": F.col("l_linenumber"),
        "saldomovimentacao": sign.otherwise(0),
        "admissao": (F.col("l_returnflag") == "A").cast("int"),
        "desligamento": (F.col("l_returnflag") == "R").cast("int"),
        "ano": F.year("l_shipdate"),
        "mes": month,
        "semestre": F.when(month <= 6, 1).otherwise(2),
        "competencia": F.date_format("l_shipdate", "yyyy-MM"),
        "data": F.col("l_shipdate"),
        "sexo": F.col("l_linestatus"),
        "horascontratuais": F.col("l_quantity"),
        "salario": F.when(F.col("l_discount") != 0, F.col("l_extendedprice")),
        "valorsalariofixo": F.col("l_extendedprice"),
        "indtrabparcial": F.when(F.col("l_tax") == 0, "Sim").when(F.col("l_tax") != 0.08, "Não"),
        "indtrabintermitente": F.when(F.col("l_discount") >= 0.10, "Sim").otherwise("Não"),
        "cod_municipio": padded_code("l_suppkey"),
        "municipio": F.col("s_name"),
        "uf": F.col("sn.n_name"),
        "regiao": F.col("sr.r_name"),
        "categoria": F.col("o_orderstatus"),
        "graudeinstrucao": F.col("o_orderpriority"),
        "racacor": F.col("c_mktsegment"),
        "pais": F.col("cn.n_name"),
        "continente": F.col("cr.r_name"),
        "secao": F.col("p_type"),
        "subclasse": F.col("p_brand"),
        "cbo2002ocupacao": F.col("p_name"),
        "idade": (F.col("p_size") + 14).cast("double"),
        "faixa_etaria": age_band(F.col("p_size") + 14),
    }


def movements(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """The movement table with the given columns and only the joins they need."""
    rules = column_rules()
    unknown = [c for c in columns if c not in rules]
    if unknown:
        raise ValueError(f"unknown movement columns: {unknown}")

    def wants(*names: str) -> bool:
        return any(c in columns for c in names)

    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    # Every foreign key has exactly one match, so inner joins keep all rows.  Orders come first:
    # their join finds the rows dealt out by its key.
    ordered = wants(*ORDER, *CUSTOMER)
    df = spread(t("lineitem"), "l_orderkey", ordered)
    if ordered:
        df = df.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if wants(*CUSTOMER):
        df = df.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        if wants("pais", "continente"):
            df = df.join(t("nation").alias("cn"), F.col("c_nationkey") == F.col("cn.n_nationkey"))
        if wants("continente"):
            df = df.join(t("region").alias("cr"), F.col("cn.n_regionkey") == F.col("cr.r_regionkey"))
    if wants(*PLACE):
        df = df.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        if wants("uf", "regiao"):
            df = df.join(t("nation").alias("sn"), F.col("s_nationkey") == F.col("sn.n_nationkey"))
        if wants("regiao"):
            df = df.join(t("region").alias("sr"), F.col("sn.n_regionkey") == F.col("sr.r_regionkey"))
    if wants(*PART):
        df = df.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return df.select(*[rules[c].alias(c) for c in columns])


def in_state() -> Column:
    return F.col("regiao") == STATE_REGION


def in_area() -> Column:
    return F.col("uf").isin(*AREA_STATES)


def scopes() -> Column:
    return scope_array(in_state(), in_area())


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The territory universe: one row per supplier with its code, state and region."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        padded_code("s_suppkey").alias("cod_municipio"),
        F.col("s_name").alias("municipio"),
        F.col("n_name").alias("uf"),
        F.col("r_name").alias("regiao"),
        F.col("s_acctbal").alias("saldo_conta"),
    )
