"""Territory indicators, universe, enrichment, serving views and key audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.functions.text import upper_key
from fluxora.operators import movement as mv
from fluxora.operators import territory
from fluxora.plans.binding import movements, spread, suppliers, table
from fluxora.session import stage
from fluxora.workload.base import MOV, PLACES, SUMS, query, r, rounded

FLAGS = ["admissao", "desligamento", "saldomovimentacao"]
KEYS = ["ano", "semestre", "municipio"]
INDICATOR_INPUT = [
    *KEYS, *FLAGS, "salario", "idade", "horascontratuais", "indtrabparcial",
    "indtrabintermitente", "cbo2002ocupacao", "subclasse", "secao", "categoria",
]

ROW_KEY = "chave"  # the key of the largest join


def entropy_ctes(keys: str, columns: dict[str, str]) -> str:
    """CTEs e_<name>(keys, n_<name>, shannon_<name>) over mov."""
    return ", ".join(
        f"""e_{n} AS (SELECT {keys}, count(*) AS n_{n},
          CASE WHEN count(*) = 1 THEN 0.0 ELSE -sum(c / t * ln(c / t)) END AS shannon_{n}
        FROM (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS t FROM (
          SELECT {keys}, {c}, CAST(count(*) AS DOUBLE) AS c FROM mov WHERE {c} IS NOT NULL GROUP BY {keys}, {c}))
        GROUP BY {keys})"""
        for n, c in columns.items()
    )


CATS = territory.CATEGORY_COLUMNS
_K = "ano, semestre, municipio"


@query(
    "territory_indicators",
    f"""WITH {MOV}, {entropy_ctes(_K, CATS)}, b AS (SELECT {_K}, count(*) AS n_movimentacoes, {SUMS},
      median(CASE WHEN admissao = 1 AND salario > 0 THEN salario END) AS ma,
      avg(CASE WHEN admissao = 1 AND salario > 0 THEN salario END) AS aa,
      median(CASE WHEN desligamento = 1 AND salario > 0 THEN salario END) AS md,
      avg(CASE WHEN desligamento = 1 AND salario > 0 THEN salario END) AS ad,
      avg(CASE WHEN admissao = 1 THEN idade END) AS ia, avg(CASE WHEN admissao = 1 THEN horascontratuais END) AS ha,
      100.0 * avg(CASE WHEN admissao = 1 THEN CASE WHEN indtrabparcial = 'Sim' THEN 1.0
        WHEN indtrabparcial IS NOT NULL THEN 0.0 END END) AS pp,
      100.0 * avg(CASE WHEN admissao = 1 THEN CASE WHEN indtrabintermitente = 'Sim' THEN 1.0 ELSE 0.0 END END) AS pi
      FROM mov GROUP BY {_K})
    SELECT {_K}, n_movimentacoes, admissoes, desligamentos, saldo,
      {r('ma', 'salario_mediano_admissao')}, {r('aa', 'salario_medio_admissao')},
      {r('md', 'salario_mediano_desligamento')}, {r('ad', 'salario_medio_desligamento')},
      {r('ma - md', 'gap_salarial_adm_des')}, {r('ia', 'idade_media_admissao')}, {r('ha', 'horas_media_admissao')},
      {r('pp', 'perc_parcial_admissao')}, {r('pi', 'perc_intermitente_admissao')},
      {", ".join(f"n_{n}" for n in CATS)}, {", ".join(r(f"shannon_{n}", f"shannon_{n}") for n in CATS)}
    FROM b {" ".join(f"LEFT JOIN e_{n} USING ({_K})" for n in CATS)}""",
)
def territory_indicators(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, [ROW_KEY, *INDICATOR_INPUT])
    return rounded(territory.territory_indicators(df, KEYS, ROW_KEY))


@query(
    "diversity",
    f"""WITH {MOV}, {entropy_ctes("uf", CATS)} SELECT uf, {", ".join(f"n_{n}" for n in CATS)},
      {", ".join(r(f"shannon_{n}", f"shannon_{n}") for n in CATS)}
    FROM e_cbo {" ".join(f"JOIN e_{n} USING (uf)" for n in list(CATS)[1:])}""",
)
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["uf", *CATS.values()])
    return rounded(territory.diversity(df, ["uf"], CATS))


@query(
    "distinct_categories",
    f"""WITH {MOV} SELECT municipio, ano, count(DISTINCT cbo2002ocupacao) AS n_cbo,
      count(DISTINCT indtrabparcial) AS n_parcial FROM mov GROUP BY municipio, ano""",
)
def distinct_categories(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["municipio", "ano", "cbo2002ocupacao", "indtrabparcial"])
    counted = territory.diversity(
        df, ["municipio", "ano"], {"cbo": "cbo2002ocupacao", "parcial": "indtrabparcial"}
    )
    return counted.select("municipio", "ano", "n_cbo", "n_parcial")


_CUSTOMER_MONTH = """WITH a AS (SELECT o_custkey AS cod, CAST(year(o_orderdate) AS INTEGER) AS ano,
      CAST(month(o_orderdate) AS INTEGER) AS mes, count(*) AS n_pedidos, sum(o_totalprice) AS valor
    FROM orders GROUP BY ALL)"""


@query(
    "expand_universe",
    f"""{_CUSTOMER_MONTH}, p AS (SELECT DISTINCT ano, mes FROM a)
    SELECT c_custkey AS cod, c_mktsegment AS segmento, p.ano, p.mes, coalesce(n_pedidos, 0) AS n_pedidos,
      {r('valor', 'valor', 2)} FROM customer CROSS JOIN p LEFT JOIN a ON a.cod = c_custkey AND a.ano = p.ano AND a.mes = p.mes""",
)
def expand_universe(spark: SparkSession, sf: str) -> DataFrame:
    # Customers play the territories: most of them have no order in a given month.
    orders = table(spark, sf, "orders")
    agg = orders.groupBy(
        F.col("o_custkey").alias("cod"),
        F.year("o_orderdate").alias("ano"),
        F.month("o_orderdate").alias("mes"),
    ).agg(F.count(F.lit(1)).alias("n_pedidos"), F.sum("o_totalprice").alias("valor"))
    universe = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cod"), F.col("c_mktsegment").alias("segmento")
    )
    periods = orders.select(
        F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes")
    ).distinct()
    spine = territory.periods_spine(universe, periods, "periodo")
    out = territory.expand_to_universe(agg, spine, ["cod", "ano", "mes"], ["n_pedidos"])
    return rounded(out, coarse=["valor"])


@query(
    "universe",
    """SELECT p_name AS municipio, upper(p_name) AS municipio_norm, cod FROM (
      SELECT p_name, p_partkey AS cod, row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_partkey) AS k FROM part)
    WHERE k = 1""",
)
def universe(spark: SparkSession, sf: str) -> DataFrame:
    # Part names repeat: the first row of each name is kept.
    source = table(spark, sf, "part").select(
        F.col("p_name").alias("municipio"), F.col("p_partkey").alias("cod")
    )
    return territory.load_universe(source, "municipio", [F.col("cod")])


_ENRICH_IN = f"""{PLACES}, f AS (SELECT l_orderkey, l_linenumber, l_suppkey,
      CASE l_returnflag WHEN 'A' THEN l_suppkey::VARCHAR || '.0' WHEN 'R' THEN 'nan' END AS cod,
      CASE WHEN p.uf = 'NATION_0' THEN 'Ignorado' WHEN p.uf = 'NATION_1' THEN '  Lugar-novo ' ELSE lower(p.municipio) END AS lugar
    FROM lineitem JOIN places p ON p.cod_municipio = lpad(l_suppkey::VARCHAR, 7, '0')),
  e AS (SELECT f.l_orderkey, f.l_linenumber, f.l_suppkey, f.lugar, f.cod IS NOT NULL AND lower(f.cod) <> 'nan' AS tem,
      upper(trim(f.lugar)) = 'IGNORADO' AS ign,
      CASE WHEN f.cod IS NOT NULL AND lower(f.cod) <> 'nan' THEN lpad(replace(f.cod, '.0', ''), 7, '0') END AS atual, p.cod_municipio AS achado
    FROM f LEFT JOIN places p ON upper(p.municipio) = upper(trim(f.lugar)))"""


def enrich_input(spark: SparkSession, sf: str) -> DataFrame:
    """Movements with a place name and a partly filled code."""
    lines = spread(table(spark, sf, "lineitem"), "l_orderkey").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.when(
            F.col("l_returnflag") == "A",
            F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")),
        )
        .when(F.col("l_returnflag") == "R", "nan")
        .alias("cod_municipio"),
    )
    places = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    name = (
        F.when(F.col("n_name") == "NATION_0", "Ignorado")
        .when(F.col("n_name") == "NATION_1", "  Lugar-novo ")
        .otherwise(F.lower("s_name"))
    )
    joined = lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(*lines.columns, name.alias("lugar"))


@query(
    "enrich_codes",
    f"""WITH {_ENRICH_IN} SELECT l_orderkey, l_linenumber, l_suppkey, lugar,
      CASE WHEN tem THEN atual WHEN NOT ign THEN achado END AS cod_municipio,
      CASE WHEN ign THEN 'ignored' WHEN tem THEN 'existing' WHEN achado IS NOT NULL THEN 'filled' ELSE 'unmatched' END AS situacao
    FROM e""",
)
def enrich_codes(spark: SparkSession, sf: str) -> DataFrame:
    lookup = territory.code_lookup(suppliers(spark, sf), "municipio", "cod_municipio")
    return territory.enrich_codes(enrich_input(spark, sf), lookup, "lugar", "cod_municipio")


@query(
    "enrich_report",
    f"""WITH {_ENRICH_IN} SELECT count(*) AS rows, count(*) FILTER (tem) AS before_filled,
      count(*) FILTER (tem OR (NOT ign AND achado IS NOT NULL)) AS after_filled,
      count(*) FILTER (NOT ign AND NOT tem AND achado IS NOT NULL) AS filled_this_run,
      count(*) FILTER (ign) AS ignored_rows, count(*) FILTER (NOT ign AND NOT tem AND achado IS NULL) AS unmatched_rows
    FROM e""",
)
def enrich_report(spark: SparkSession, sf: str) -> DataFrame:
    before = enrich_input(spark, sf)
    lookup = territory.code_lookup(suppliers(spark, sf), "municipio", "cod_municipio")
    after = territory.enrich_codes(before, lookup, "lugar", "cod_municipio")
    return territory.enrichment_report(before, after, "cod_municipio")


@query(
    "enrich_unmatched",
    f"""WITH {_ENRICH_IN} SELECT lugar AS nome, count(*) AS linhas FROM e
    WHERE NOT ign AND NOT tem AND achado IS NULL GROUP BY 1""",
)
def enrich_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    lookup = territory.code_lookup(suppliers(spark, sf), "municipio", "cod_municipio")
    after = territory.enrich_codes(enrich_input(spark, sf), lookup, "lugar", "cod_municipio")
    return territory.unmatched_names(after, "lugar")


@query(
    "lookup_collisions",
    """SELECT upper(p_name) AS chave, count(DISTINCT p_partkey) AS n_codigos FROM part
    GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1""",
)
def lookup_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return territory.lookup_collisions(table(spark, sf, "part"), "p_name", "p_partkey")


def monthly_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Territory facts as served: year, month, code and the three metrics."""
    dims = ["ano", "mes", "cod_municipio"]
    return mv.movement_aggregate(movements(spark, sf, [*dims, *FLAGS]), dims)


@query(
    "view_territory",
    f"""WITH {MOV}, {PLACES}, f AS (SELECT ano, mes, cod_municipio, {SUMS} FROM mov GROUP BY ano, mes, cod_municipio)
    SELECT f.*, p.municipio AS nome_municipio, p.uf FROM f LEFT JOIN places p
      ON p.cod_municipio = f.cod_municipio AND p.regiao <> 'ASIA'""",
)
def view_territory(spark: SparkSession, sf: str) -> DataFrame:
    facts = monthly_facts(spark, sf)
    places = suppliers(spark, sf).where("regiao <> 'ASIA'")
    return territory_view(facts, places)


def territory_view(facts: DataFrame, places: DataFrame) -> DataFrame:
    """Every fact with the name of its territory where the code is known."""
    names = places.select("cod_municipio", F.col("municipio").alias("nome_municipio"), "uf")
    return facts.join(names, "cod_municipio", "left")


@query(
    "view_state",
    f"""WITH {MOV} SELECT ano, mes, m.uf AS uf_sigla, n_nationkey AS cod_uf, r_name AS nome_regiao, {SUMS}
    FROM mov m LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 4) ON n_name = m.uf
      LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ano, mes, m.uf, n_nationkey, r_name""",
)
def view_state(spark: SparkSession, sf: str) -> DataFrame:
    dims = ["ano", "mes", "uf"]
    facts = mv.movement_aggregate(movements(spark, sf, [*dims, *FLAGS]), dims)
    states = table(spark, sf, "nation").where("n_nationkey <> 4").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    names = states.select(
        F.col("n_name").alias("uf"),
        F.col("n_nationkey").alias("cod_uf"),
        F.col("r_name").alias("nome_regiao"),
    )
    return facts.join(names, "uf", "left").withColumnRenamed("uf", "uf_sigla")


@query(
    "serve_territory",
    f"""WITH {MOV}, {PLACES}, f AS (SELECT cod_municipio, {SUMS} FROM mov WHERE ano = 1998 AND mes = 4 GROUP BY 1)
    SELECT coalesce(nullif(trim(CASE WHEN p.uf = 'NATION_8' THEN '  ' ELSE p.uf END), ''), 'sem nome') AS uf_nome,
      p.municipio, f.* FROM f JOIN places p USING (cod_municipio)
    WHERE p.regiao = 'EUROPE' ORDER BY saldo DESC NULLS LAST, municipio""",
)
def serve_territory(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["ano", "mes", "cod_municipio", *FLAGS]).where(
        "ano = 1998 AND mes = 4"
    )
    places = suppliers(spark, sf)
    wanted = places.where("regiao = 'EUROPE'").select("cod_municipio")
    # The code list prunes the facts before they are summed.
    facts = mv.movement_aggregate(
        df.join(wanted, "cod_municipio", "left_semi"), ["cod_municipio"]
    )
    label = F.when(F.col("uf") == "NATION_8", "  ").otherwise(F.col("uf"))
    names = places.select("cod_municipio", "municipio", label.alias("rotulo"))
    uf_name = F.coalesce(F.nullif(F.trim("rotulo"), F.lit("")), F.lit("sem nome"))
    served = facts.join(names, "cod_municipio", "left")
    return served.select(
        uf_name.alias("uf_nome"), "municipio", "cod_municipio", *mv.METRICS
    ).orderBy(F.desc_nulls_last("saldo"), "municipio")


@query(
    "serve_state",
    f"""WITH {MOV}, f AS (SELECT CASE uf WHEN 'NATION_1' THEN ' ni ' WHEN 'NATION_2' THEN 'NA' WHEN 'NATION_6' THEN ' '
        ELSE uf END AS uf, {SUMS} FROM mov WHERE ano = 1998 GROUP BY 1)
    SELECT uf, admissoes, desligamentos, saldo FROM f
    WHERE trim(uf) <> '' AND upper(trim(uf)) NOT IN ('NI', 'NA') ORDER BY saldo DESC, uf""",
)
def serve_state(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["ano", "uf", *FLAGS]).where("ano = 1998")
    odd = {"NATION_1": " ni ", "NATION_2": "NA", "NATION_6": " "}
    df = df.replace(odd, subset=["uf"])
    named = (F.trim("uf") != "") & ~F.upper(F.trim("uf")).isin("NI", "NA")
    facts = mv.movement_aggregate(df.where(named), ["uf"])
    return facts.orderBy(F.desc_nulls_last("saldo"), "uf")


@query(
    "map_query",
    f"""WITH {MOV} SELECT cod_municipio, municipio, uf, {SUMS} FROM mov
    WHERE ano = 1998 AND mes = 4 AND uf = 'NATION_3' GROUP BY ALL ORDER BY municipio""",
)
def map_query(spark: SparkSession, sf: str) -> DataFrame:
    dims = ["cod_municipio", "municipio", "uf"]
    df = movements(spark, sf, [*dims, "ano", "mes", *FLAGS])
    kept = df.where("ano = 1998 AND mes = 4 AND uf = 'NATION_3'")
    return mv.movement_aggregate(kept, dims).orderBy("municipio")


_COVER = """f AS (SELECT DISTINCT CASE o_orderpriority WHEN '5-LOW' THEN 'IGNORADO' WHEN '1-URGENT' THEN 'C' || o_custkey::VARCHAR
      ELSE 'X' || o_custkey::VARCHAR END AS chave FROM orders),
    p AS (SELECT DISTINCT 'C' || c_custkey::VARCHAR AS chave FROM customer)"""


def coverage_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Fact keys of all orders (some unknown, some non-territorial) and all customer keys."""
    priority, key = F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    fact_key = (
        F.when(priority == "5-LOW", "IGNORADO")
        .when(priority == "1-URGENT", F.concat(F.lit("C"), key))
        .otherwise(F.concat(F.lit("X"), key))
    )
    facts = table(spark, sf, "orders").select(fact_key.alias("chave"))
    places = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("chave")
    )
    return facts, places


@query(
    "key_coverage",
    f"""WITH {_COVER}, j AS (SELECT coalesce(f.chave, p.chave) AS chave, f.chave IS NOT NULL AS inf, p.chave IS NOT NULL AS inp
      FROM f FULL JOIN p ON f.chave = p.chave)
    SELECT *, {r('100.0 * matched / fact_territorial', 'coverage_pct', 2)},
      unmatched_fact = 0 AND fact_territorial > 0 AS ok FROM (
      SELECT count(*) FILTER (inf) AS fact_total, count(*) FILTER (inf AND chave <> 'IGNORADO') AS fact_territorial,
      count(*) FILTER (inf AND chave = 'IGNORADO') AS non_territorial, count(*) FILTER (inp) AS place_total,
      count(*) FILTER (inf AND inp AND chave <> 'IGNORADO') AS matched,
      count(*) FILTER (inf AND NOT inp AND chave <> 'IGNORADO') AS unmatched_fact,
      count(*) FILTER (inp AND NOT inf) AS unmatched_place FROM j)""",
)
def key_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return territory.key_coverage(*coverage_sides(spark, sf), "chave")


@query(
    "unmatched_keys",
    f"""WITH {_COVER} SELECT chave, 'fact' AS lado FROM (SELECT chave FROM f EXCEPT SELECT chave FROM p)
    UNION ALL SELECT chave, 'place' FROM (SELECT chave FROM p EXCEPT SELECT chave FROM f)""",
)
def unmatched_keys(spark: SparkSession, sf: str) -> DataFrame:
    return territory.unmatched_keys(*coverage_sides(spark, sf), "chave")


@query(
    "join_residue",
    f"""WITH {MOV}, {PLACES}, k AS (SELECT municipio FROM places WHERE saldo_conta > 0),
    s AS (SELECT CAST(sum(admissao) AS BIGINT) AS total_micro,
      CAST(coalesce(sum(admissao) FILTER (municipio IN (SELECT municipio FROM k)), 0) AS BIGINT) AS total_na_malha,
      count(DISTINCT municipio) FILTER (municipio NOT IN (SELECT municipio FROM k)) AS n_fora_da_malha FROM mov)
    SELECT *, total_micro - total_na_malha AS diferenca,
      {r('100.0 * (total_micro - total_na_malha) / total_micro', 'percentual_residuo')} FROM s""",
)
def join_residue(spark: SparkSession, sf: str) -> DataFrame:
    facts = movements(spark, sf, ["municipio", "admissao"])
    known = suppliers(spark, sf).where("saldo_conta > 0")
    return rounded(territory.join_residue(facts, known, "municipio", "admissao"))


@query(
    "feature_join",
    f"""WITH {MOV}, {PLACES}, m AS (SELECT cod_municipio, municipio, CAST(sum(saldomovimentacao) AS BIGINT) AS saldo
      FROM mov WHERE uf <> 'NATION_5' GROUP BY ALL)
    SELECT x.codigo, x.nome, coalesce(a.saldo, b.saldo) AS saldo, coalesce(a.saldo, b.saldo) IS NOT NULL AS matched
    FROM (SELECT CASE WHEN regiao = 'AFRICA' THEN 'X' || cod_municipio ELSE cod_municipio END AS codigo,
        upper(municipio) AS nome FROM places) x
      LEFT JOIN m a ON a.cod_municipio = x.codigo LEFT JOIN m b ON upper(b.municipio) = x.nome""",
)
def feature_join(spark: SparkSession, sf: str) -> DataFrame:
    # Features of one region carry an unknown code and must match by name.
    places = suppliers(spark, sf)
    code = F.when(
        F.col("regiao") == "AFRICA", F.concat(F.lit("X"), "cod_municipio")
    ).otherwise(F.col("cod_municipio"))
    features = places.select(code.alias("codigo"), upper_key(F.col("municipio")).alias("nome"))
    df = movements(spark, sf, ["cod_municipio", "municipio", "uf", *FLAGS])
    metrics = mv.movement_aggregate(
        df.where("uf <> 'NATION_5'"), ["cod_municipio", "municipio"]
    ).select(
        F.col("cod_municipio").alias("codigo"),
        upper_key(F.col("municipio")).alias("nome"),
        "saldo",
    )
    metrics = stage(metrics, "feature-metrics")
    return territory.feature_join(features, metrics, "codigo", "nome", ["saldo"])


@query(
    "feature_join_summary",
    f"""WITH {MOV}, m AS (SELECT municipio, sum(saldomovimentacao) AS saldo FROM mov WHERE uf <> 'NATION_5' GROUP BY 1)
    SELECT count(m.municipio) AS matched, count(*) - count(m.municipio) AS unmatched,
      CAST(max(abs(saldo)) AS BIGINT) AS max_abs FROM supplier LEFT JOIN m ON m.municipio = s_name""",
)
def feature_join_summary(spark: SparkSession, sf: str) -> DataFrame:
    joined = feature_join(spark, sf)
    return joined.agg(
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("unmatched"),
        F.max(F.abs("saldo")).alias("max_abs"),
    )
