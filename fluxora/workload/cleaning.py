"""Text, numbers, periods, bands, filters and code decoding over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.functions import labels, numbers, text
from fluxora.operators import clean, territory
from fluxora.operators.index_frozen import join_floor
from fluxora.functions.scoring import wage_eligible
from fluxora.operators.movement import movement_sums
from fluxora.plans.binding import in_area, in_state, movements, spread, star_spec, table
from fluxora.workload.base import (
    MOV,
    SCOPE_WHERE,
    SUMS,
    query,
    r,
    rounded,
)

BLANKS_SQL = r"'[\t-\r\x1c-\x20\x{85}\p{Z}]+'"
CLEAN_SQL = f"trim(regexp_replace(text, {BLANKS_SQL}, ' ', 'g'))"


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query("clean_text", f"SELECT doc_id, {CLEAN_SQL} AS limpo FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", text.clean_text(F.col("text")).alias("limpo"))


_KEY_SQL = (
    f"trim(regexp_replace(regexp_replace(strip_accents(trim(text)), '[.,;:/\\-_|]+', ' ', 'g'), "
    f"{BLANKS_SQL}, ' ', 'g'))"
)


@query(
    "norm_key",
    f"""SELECT doc_id, regexp_replace(upper(strip_accents({CLEAN_SQL})), '[ßẞ]', 'SS', 'g') AS rotulo,
      CASE WHEN {_KEY_SQL} <> '' AND lower(trim(text)) <> 'nan'
        THEN regexp_replace(upper({_KEY_SQL}), '[ßẞ]', 'SS', 'g') END AS chave
    FROM documents""",
)
def norm_key(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select(
        "doc_id",
        text.upper_key(F.col("text")).alias("rotulo"),
        text.join_key(F.col("text")).alias("chave"),
    )


@query(
    "parse_number_br",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
      CASE WHEN l_discount = 0 THEN '-' WHEN l_tax = 0 THEN 'R$ ' || br ELSE br END AS texto,
      CASE WHEN l_discount <> 0 THEN l_extendedprice END AS valor
    FROM (SELECT *, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS br FROM lineitem)""",
)
def parse_number_br(spark: SparkSession, sf: str) -> DataFrame:
    br = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    shown = F.when(F.col("l_discount") == 0, "-").when(
        F.col("l_tax") == 0, F.concat(F.lit("R$ "), br)
    )
    lines = spread(table(spark, sf, "lineitem"), "l_orderkey")
    df = lines.select(
        "l_orderkey", "l_linenumber", "l_suppkey", shown.otherwise(br).alias("texto")
    )
    df = df.withColumn("valor", F.col("texto"))
    return numbers.to_numbers(df, ["valor"], "auto")


def _raw_code() -> Column:
    key = F.col("o_custkey").cast("string")
    return (
        F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit(".0")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("12345678"), key))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit(" NaN "))
        .otherwise(key)
    )


@query(
    "format_code",
    """SELECT o_orderkey, bruto,
      CASE WHEN lower(trim(bruto)) NOT IN ('', 'nan', 'none', 'null', '<na>') THEN
        CASE WHEN length(sem) < 7 THEN lpad(sem, 7, '0') ELSE sem END END AS codigo,
      lower(trim(bruto)) IN ('', 'nan', 'none', 'null', '<na>') AS ausente
    FROM (SELECT *, regexp_replace(trim(bruto), '\\.0$', '') AS sem FROM (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR || '.0'
        WHEN o_orderstatus = 'P' THEN '12345678' || o_custkey::VARCHAR
        WHEN o_orderpriority = '1-URGENT' THEN ' NaN ' ELSE o_custkey::VARCHAR END AS bruto
      FROM orders))""",
)
def format_code(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", _raw_code().alias("bruto"))
    return df.select(
        "o_orderkey",
        "bruto",
        text.format_code(F.col("bruto")).alias("codigo"),
        text.is_code_missing(F.col("bruto")).alias("ausente"),
    )


@query(
    "decode_dimensions",
    """SELECT c_custkey, coalesce(trim(n_name), c_nationkey::VARCHAR) AS pais,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'Construção' ELSE c_mktsegment END AS segmento
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""",
)
def decode_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    # The dictionary knows only part of the codes: the rest keeps its own text.
    nations = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.lit("pais").alias("domain"),
        F.col("n_nationkey").cast("string").alias("code"),
        F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("label"),
    )
    extra = spark.createDataFrame(
        [("segmento", "BUILDING", "Construção")], "domain string, code string, label string"
    )
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_nationkey").cast("double").alias("pais"),
        F.col("c_mktsegment").alias("segmento"),
    )
    return territory.decode(
        df, nations.unionByName(extra), {"pais": "pais", "segmento": "segmento"}
    )


def _period_text() -> Column:
    ym = F.date_format("o_orderdate", "yyyyMM")
    return (
        F.when(F.col("o_orderstatus") == "P", F.concat(ym, F.lit(".0")))
        .when(F.col("o_orderpriority") == "5-LOW", F.substring(ym, 1, 5))
        .otherwise(F.concat(F.lit(" "), ym))
    )


_PERIOD_SQL = """CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y%m') || '.0'
      WHEN o_orderpriority = '5-LOW' THEN left(strftime(o_orderdate, '%Y%m'), 5)
      ELSE ' ' || strftime(o_orderdate, '%Y%m') END"""


@query(
    "stamp_period",
    """SELECT o_orderkey, CASE WHEN ok THEN CAST(year(o_orderdate) AS INTEGER) END AS ano,
      CASE WHEN ok THEN CAST(month(o_orderdate) AS INTEGER) END AS mes,
      CASE WHEN ok THEN strftime(o_orderdate, '%Y-%m') END AS competencia_str,
      CASE WHEN ok THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') END AS inicio
    FROM (SELECT *, o_orderstatus = 'P' OR o_orderpriority <> '5-LOW' AS ok FROM orders)""",
)
def stamp_period(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumn("competenciamov", _period_text())
    df = clean.stamp_period(df, "competenciamov")
    start = F.date_format("competencia_date", "yyyy-MM-dd").alias("inicio")
    return df.select("o_orderkey", "ano", "mes", "competencia_str", start)


@query(
    "filter_period",
    f"""SELECT o_orderkey, o_totalprice FROM (SELECT *, {_PERIOD_SQL} AS p FROM orders)
    WHERE regexp_replace(trim(p), '\\.0$', '') = '199703'""",
)
def filter_period(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumn("p", _period_text())
    kept = df.where(clean.period_equals(F.col("p"), 1997, 3))
    return kept.select("o_orderkey", "o_totalprice")


@query(
    "period_range",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(month(o_orderdate) AS INTEGER) AS mes,
      count(*) AS n, strftime(o_orderdate, '%Y%m') <= '199806' AS ate_limite
    FROM orders WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199611' AND '199902'
    GROUP BY ALL""",
)
def period_range(spark: SparkSession, sf: str) -> DataFrame:
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    # The ends are given in the wrong order on purpose.
    kept = table(spark, sf, "orders").where(
        clean.in_period_range(year, month, (1999, 2), (1996, 11))
    )
    counted = kept.groupBy(year.alias("ano"), month.alias("mes")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.withColumn(
        "ate_limite", clean.up_to_period(F.col("ano"), F.col("mes"), (1998, 6))
    )


_AGE_SQL = "CASE WHEN p_brand = 'Brand#7' THEN NULL ELSE CAST(p_size * 2 - 5 AS DOUBLE) END"


@query(
    "age_band",
    f"""SELECT p_partkey, idade, CASE WHEN idade IS NULL THEN 'Ignorado' WHEN idade < 18 THEN 'Até 17 anos'
      WHEN idade <= 24 THEN '18 a 24 anos' WHEN idade <= 29 THEN '25 a 29 anos'
      WHEN idade <= 39 THEN '30 a 39 anos' WHEN idade <= 49 THEN '40 a 49 anos'
      WHEN idade <= 64 THEN '50 a 64 anos' ELSE '65 anos ou mais' END AS faixa_etaria
    FROM (SELECT p_partkey, {_AGE_SQL} AS idade FROM part)""",
)
def age_band(spark: SparkSession, sf: str) -> DataFrame:
    age = F.when(F.col("p_brand") != "Brand#7", (F.col("p_size") * 2 - 5).cast("double"))
    df = table(spark, sf, "part").select("p_partkey", age.alias("idade"))
    return df.withColumn("faixa_etaria", labels.age_band(F.col("idade")))


def _band_column() -> Column:
    size = F.col("p_size")
    number = F.ceil(size / 7).cast("int").cast("string")
    return (
        F.when(size > 49, "0NA")
        .when(F.col("p_type") == "ECONOMY", F.concat(number, F.lit(".0")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("0"), number))
        .otherwise(number)
    )


@query(
    "band_to_age",
    """SELECT p_partkey, codigo, CAST(CASE faixa WHEN 1 THEN 17 WHEN 2 THEN 21 WHEN 3 THEN 29 WHEN 4 THEN 39
      WHEN 5 THEN 49 WHEN 6 THEN 59 WHEN 7 THEN 65 END AS DOUBLE) AS idade
    FROM (SELECT *, CASE WHEN p_size > 49 THEN '0NA' WHEN p_type = 'ECONOMY' THEN faixa::VARCHAR || '.0'
      WHEN p_type = 'SMALL' THEN '0' || faixa::VARCHAR ELSE faixa::VARCHAR END AS codigo
      FROM (SELECT *, CAST(ceil(p_size / 7.0) AS INTEGER) AS faixa FROM part))""",
)
def band_to_age(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", _band_column().alias("codigo"))
    return clean.age_from_band(df, "codigo")


@query(
    "movement_flags",
    """SELECT sinal, CAST(CASE WHEN sinal = 1 THEN 1 ELSE 0 END AS INTEGER) AS admissao,
      CAST(CASE WHEN sinal = -1 THEN 1 ELSE 0 END AS INTEGER) AS desligamento, count(*) AS n
    FROM (SELECT CASE WHEN l_discount = 0 THEN NULL WHEN l_returnflag = 'A' THEN 1
      WHEN l_returnflag = 'R' THEN -1 ELSE 0 END AS sinal FROM lineitem)
    WHERE sinal IS NOT NULL GROUP BY ALL""",
)
def movement_flags(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1)
    df = table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") != 0, sign.otherwise(0)).alias("sinal")
    )
    flagged = clean.movement_flags(df, "sinal")
    return flagged.groupBy("sinal", "admissao", "desligamento").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "scope_filter",
    f"WITH {MOV} "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS escopo, count(*) AS n, {SUMS} FROM mov WHERE {w}"
        for s, w in SCOPE_WHERE.items()
    ),
)
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(
        spark, sf, ["regiao", "uf", "admissao", "desligamento", "saldomovimentacao"]
    )
    # One scan: each row is counted in every scope it belongs to.
    tagged = df.withColumn(
        "escopo", F.explode(territory.scope_array(in_state(), in_area()))
    )
    return tagged.groupBy("escopo").agg(F.count(F.lit(1)).alias("n"), *movement_sums())


@query(
    "valid_value",
    f"""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS valido FROM customer""",
)
def valid_value(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer")
    as_text = F.col("c_acctbal").cast("string")
    return df.select("c_custkey", numbers.valid_positive(as_text).alias("valido"))


@query(
    "finite_number",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'NaN' WHEN 'view' THEN 'Infinity' WHEN 'click' THEN ''
      ELSE value::VARCHAR END AS texto,
      CASE WHEN event_type NOT IN ('error', 'view', 'click') THEN value END AS numero FROM events""",
)
def finite_number(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    shown = (
        F.when(kind == "error", "NaN")
        .when(kind == "view", "Infinity")
        .when(kind == "click", "")
        .otherwise(F.col("value").cast("string"))
    )
    df = table(spark, sf, "events").select("event_id", shown.alias("texto"))
    return df.withColumn("numero", numbers.finite(F.col("texto")))


@query(
    "flag_share",
    f"""WITH {MOV} SELECT uf, CAST(sum(admissao) AS BIGINT) AS admissoes,
      count(*) FILTER (admissao = 1 AND indtrabparcial = 'Sim') AS n_parcial,
      {r("100.0 * count(*) FILTER (admissao = 1 AND indtrabparcial = 'Sim') / nullif(sum(admissao), 0)",
         "perc_sobre_admissoes")},
      {r("100.0 * avg(CASE WHEN admissao = 1 THEN CASE WHEN indtrabparcial = 'Sim' THEN 1.0 "
         "WHEN indtrabparcial IS NOT NULL THEN 0.0 END END)", "perc_sobre_informados")}
    FROM mov GROUP BY uf""",
)
def flag_share(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["uf", "admissao", "indtrabparcial"])
    hire, yes = F.col("admissao") == 1, text.is_yes(F.col("indtrabparcial"))
    counted = df.groupBy("uf").agg(
        F.sum(F.col("admissao").cast("long")).alias("admissoes"),
        F.count_if(hire & yes).alias("n_parcial"),
        (F.avg(F.when(hire, yes.cast("double"))) * 100.0).alias("perc_sobre_informados"),
    )
    share = numbers.ratio(F.col("n_parcial"), F.col("admissoes")) * 100.0
    return rounded(counted.withColumn("perc_sobre_admissoes", share))


@query(
    "wage_eligibility",
    f"""WITH {MOV}, piso AS (SELECT 1995 + i AS ano, 500.0 + 20 * i AS salario_minimo FROM range(7) t(i))
    SELECT ano, {r('salario_minimo', 'salario_minimo')},
      count(*) FILTER (indtrabintermitente <> 'Sim' AND salario >= 0.3::DOUBLE * salario_minimo
        AND salario <= 150.0 * salario_minimo) AS elegiveis, count(*) AS n
    FROM mov JOIN piso USING (ano) GROUP BY ano, salario_minimo""",
)
def wage_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    spec = star_spec()
    df = join_floor(movements(spark, sf, ["ano", "salario", "indtrabintermitente"]), spec)
    ok = wage_eligible(
        numbers.valid_positive(F.col("salario")),
        text.is_yes(F.col("indtrabintermitente")),
        F.col("salario_minimo"),
        spec.wage_low,
        spec.wage_high,
    )
    return df.groupBy("ano", "salario_minimo").agg(
        F.count_if(ok).alias("elegiveis"), F.count(F.lit(1)).alias("n")
    )


@query(
    "territorial_filter",
    f"""WITH {MOV} SELECT uf, {SUMS}, CAST(0 AS BIGINT) AS ignorados FROM mov WHERE uf <> 'NATION_0' GROUP BY uf
    UNION ALL SELECT 'IGNORADO', 0, 0, 0, count(*) FROM mov WHERE uf = 'NATION_0'""",
)
def territorial_filter(spark: SparkSession, sf: str) -> DataFrame:
    # One state plays the "no territory" category: its rows are counted, not listed.
    df = movements(spark, sf, ["uf", "admissao", "desligamento", "saldomovimentacao"])
    outside = F.col("uf").isin("NATION_0")
    zero = F.lit(0).cast("long")
    summed = df.groupBy(
        F.when(outside, territory.NON_TERRITORIAL[0]).otherwise(F.col("uf")).alias("uf")
    ).agg(*movement_sums(), F.count_if(outside).alias("ignorados"))
    real = ~F.col("uf").isin(*territory.NON_TERRITORIAL)
    return summed.select(
        "uf",
        *[
            F.when(real, F.col(c)).otherwise(zero).alias(c)
            for c in ("admissoes", "desligamentos", "saldo")
        ],
        "ignorados",
    )


@query(
    "resolve_code",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ZZ'
      WHEN n_nationkey < 20 THEN chr(65 + n_nationkey) || chr(90 - n_nationkey) END AS sigla
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def resolve_code(spark: SparkSession, sf: str) -> DataFrame:
    # Five states are left out of the lookup and stay NULL.
    by_name = {f"NATION {i}": chr(65 + i) + chr(90 - i) for i in range(20)}
    df = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    raw = F.when(F.col("c_mktsegment") == "BUILDING", " zz ").otherwise(F.lower("n_name"))
    return df.select(
        "c_custkey",
        labels.resolve_two_letter(raw, by_name, text.join_key).alias("sigla"),
    )


@query(
    "column_profile",
    f"""WITH {MOV}, t AS (SELECT CASE WHEN l_discount = 0 THEN '-' ELSE l_extendedprice::VARCHAR END AS salario,
        CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity::VARCHAR END AS horascontratuais FROM lineitem)
    SELECT 'salario' AS coluna, 'antes' AS etapa, 'string' AS tipo, count(*) - count(salario) AS nulos FROM t
    UNION ALL SELECT 'salario', 'depois', 'double', count(*) FILTER (salario = '-') FROM t
    UNION ALL SELECT 'horascontratuais', 'antes', 'string', count(*) - count(horascontratuais) FROM t
    UNION ALL SELECT 'horascontratuais', 'depois', 'double', count(*) - count(horascontratuais) FROM t""",
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") == 0, "-")
        .otherwise(F.col("l_extendedprice").cast("string"))
        .alias("salario"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("string")).alias(
            "horascontratuais"
        ),
    )
    after = numbers.to_numbers(raw, raw.columns, "plain")
    return profile(raw, "antes").unionByName(profile(after, "depois"))


def profile(df: DataFrame, step: str) -> DataFrame:
    """Type and NULL count of every column: one aggregate row, then unpivoted."""
    types = dict(df.dtypes)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    tall = nulls.unpivot([], df.columns, "coluna", "nulos")
    return tall.select(
        "coluna",
        F.lit(step).alias("etapa"),
        labels.lookup(F.col("coluna"), types).alias("tipo"),
        "nulos",
    )
