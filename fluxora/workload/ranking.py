"""Ranks, classes, top lists, pages and comparisons between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.functions import scoring
from fluxora.functions.labels import AGE_ORDER, period_label
from fluxora.functions.numbers import ratio
from fluxora.operators import movement as mv
from fluxora.operators import rank
from fluxora.operators.order_stats import dense_rank_desc, rank_where
from fluxora.operators.territory import last_per_key
from fluxora.plans.binding import movements, table
from fluxora.session import stage
from fluxora.workload.base import MOV, SUMS, query, r, rounded

FLAGS = ["admissao", "desligamento", "saldomovimentacao"]


def by(spark: SparkSession, sf: str, dims: list[str]) -> DataFrame:
    return mv.movement_aggregate(movements(spark, sf, [*dims, *FLAGS]), dims)


def half_years(spark: SparkSession, sf: str) -> DataFrame:
    """Territory x half-year movements with the top wage at hire, staged for several readers."""
    dims = ["ano", "semestre", "municipio"]
    df = movements(spark, sf, [*dims, *FLAGS, "salario"])
    summed = df.groupBy(*dims).agg(
        *mv.movement_sums(),
        F.max(F.when(F.col("admissao") == 1, F.col("salario"))).alias("topo"),
    )
    # Few hires give no usable value: those rows carry a missing one.
    return stage(
        summed.withColumn("topo", F.when(F.col("admissoes") >= 10, F.col("topo"))), "half-years"
    )


HALF = f"""WITH {MOV}, h AS (SELECT ano, semestre, municipio, {SUMS},
    CASE WHEN sum(admissao) >= 10 THEN max(CASE WHEN admissao = 1 THEN salario END) END AS topo
  FROM mov GROUP BY ano, semestre, municipio)"""
PERIOD = ["ano", "semestre"]


@query(
    "dense_rank_desc",
    f"""{HALF} SELECT ano, semestre, municipio, admissoes, CASE WHEN admissoes >= 5 THEN
      dense_rank() OVER (PARTITION BY ano, semestre, admissoes >= 5 ORDER BY admissoes DESC) END AS posicao FROM h""",
)
def dense_ranks(spark: SparkSession, sf: str) -> DataFrame:
    # Hire counts tie heavily; territories with fewer than five stay unranked.
    df = half_years(spark, sf).select(*PERIOD, "municipio", "admissoes")
    df = df.withColumn("usado", F.when(F.col("admissoes") >= 5, F.col("admissoes")))
    return dense_rank_desc(df, PERIOD, "usado", "posicao").drop("usado")


@query(
    "rank_universes",
    f"""{HALF} SELECT ano, semestre, municipio, topo,
      CASE WHEN admissoes >= 10 AND topo IS NOT NULL THEN dense_rank() OVER (
        PARTITION BY ano, semestre, admissoes >= 10 AND topo IS NOT NULL ORDER BY topo DESC) END AS rank_n10,
      CASE WHEN admissoes >= 20 AND topo IS NOT NULL THEN dense_rank() OVER (
        PARTITION BY ano, semestre, admissoes >= 20 AND topo IS NOT NULL ORDER BY topo DESC) END AS rank_n20
    FROM h""",
)
def rank_universes(spark: SparkSession, sf: str) -> DataFrame:
    df = half_years(spark, sf).select(*PERIOD, "municipio", "admissoes", "topo")
    n = F.col("admissoes")
    out = rank_where(df, PERIOD, "topo", n >= 10, "rank_n10")
    return rank_where(out, PERIOD, "topo", n >= 20, "rank_n20").drop("admissoes")


@query(
    "minmax_score",
    f"""{HALF} SELECT ano, semestre, municipio, {r('''CASE WHEN topo IS NULL THEN NULL
      WHEN abs(lo - hi) <= 1e-8 + 1e-5 * abs(hi) THEN 50.0 ELSE (topo - lo) / (hi - lo) * 100 END''', 'percentil')}
    FROM (SELECT *, min(topo) OVER w AS lo, max(topo) OVER w AS hi FROM h WINDOW w AS (PARTITION BY ano, semestre))""",
)
def minmax_score(spark: SparkSession, sf: str) -> DataFrame:
    df = half_years(spark, sf).select(*PERIOD, "municipio", "topo")
    return rounded(rank.minmax_score(df, PERIOD, "topo", "percentil").drop("topo"))


_EDGES = ", ".join(f"quantile_cont(admissoes::DOUBLE, {p}::DOUBLE) AS e{i}" for i, p in enumerate((0, 0.2, 0.4, 0.6, 0.8, 1)))


@query(
    "quantile_classes",
    f"""{HALF}, e AS (SELECT ano, semestre, {_EDGES} FROM h WHERE topo IS NOT NULL GROUP BY ano, semestre),
    d AS (SELECT h.*, list_sort(list_distinct([e0, e1, e2, e3, e4, e5])) AS edges, e0, e5
      FROM h LEFT JOIN e USING (ano, semestre))
    SELECT ano, semestre, municipio, CASE WHEN topo IS NULL THEN 'Sem movimentação migratória suficiente'
      WHEN e0 = e5 THEN 'Médio'
      ELSE ['Muito baixo', 'Baixo', 'Médio', 'Alto', 'Muito alto'][
        greatest(1, len(list_filter(edges, lambda x: x < admissoes)))] END AS classe FROM d""",
)
def quantile_classes(spark: SparkSession, sf: str) -> DataFrame:
    # Hire counts tie, so some class edges coincide and collapse.
    df = half_years(spark, sf).select(
        *PERIOD,
        "municipio",
        F.when(F.col("topo").isNotNull(), F.col("admissoes").cast("double")).alias("x"),
    )
    return rank.quantile_classes(df, PERIOD, "x", "classe").drop("x")


@query(
    "score_frozen",
    f"""{HALF} SELECT ano, semestre, municipio,
      {r("CASE WHEN topo IS NOT NULL THEN 100 * least(greatest((topo - 80000) / 20000, 0), 1) END", "escore")} FROM h""",
)
def score_frozen(spark: SparkSession, sf: str) -> DataFrame:
    df = half_years(spark, sf)
    score = scoring.score_frozen(F.col("topo"), 80000.0, 100000.0)
    return rounded(df.select(*PERIOD, "municipio", score.alias("escore")))


@query(
    "absorption",
    f"""{HALF} SELECT ano, semestre, municipio, {r("ln(1 + admissoes)", "volume")},
      {r("100.0 * (admissoes + 5) / (admissoes + desligamentos + 10)", "saldo_suavizado")} FROM h""",
)
def absorption(spark: SparkSession, sf: str) -> DataFrame:
    df = half_years(spark, sf)
    balance = scoring.absorption_balance(F.col("admissoes"), F.col("desligamentos"), 5, 10)
    volume = F.log1p(F.col("admissoes").cast("double"))
    return rounded(
        df.select(*PERIOD, "municipio", volume.alias("volume"), balance.alias("saldo_suavizado"))
    )


@query(
    "contract_quality",
    f"""WITH {MOV} SELECT ano, semestre, municipio,
      {r("CASE WHEN p IS NOT NULL THEN 100 - least(100, 2 * p) END", "qualidade")}
    FROM (SELECT ano, semestre, municipio, 100.0 * count(*) FILTER (admissao = 1 AND indtrabparcial = 'Sim')
      / nullif(sum(admissao), 0) AS p FROM mov GROUP BY ano, semestre, municipio)""",
)
def contract_quality(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, [*PERIOD, "municipio", "admissao", "indtrabparcial"])
    partial = (F.col("admissao") == 1) & (F.col("indtrabparcial") == "Sim")
    share = ratio(F.count_if(partial), F.sum("admissao")) * 100.0
    shares = df.groupBy(*PERIOD, "municipio").agg(share.alias("p"))
    quality = scoring.quality_component(F.col("p"), 2)
    return rounded(shares.select(*PERIOD, "municipio", quality.alias("qualidade")))


@query(
    "reliability_class",
    f"""{HALF} SELECT CASE WHEN admissoes >= 20 THEN 'higher' WHEN admissoes >= 10 THEN 'reduced' END AS classe,
      admissoes >= 10 AS calculavel, count(*) AS n FROM h GROUP BY ALL""",
)
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    df = by(spark, sf, [*PERIOD, "municipio"])
    n = F.col("admissoes")
    return df.groupBy(
        scoring.reliability_class(n, 10, 20).alias("classe"),
        scoring.calculable(n, 10).alias("calculavel"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "zscore",
    f"""{HALF} SELECT ano, semestre, municipio, {r('''CASE WHEN sd IS NULL OR sd = 0 THEN 0
      ELSE (topo - m) / sd END''', 'z')}
    FROM (SELECT *, avg(topo) OVER w AS m, stddev_samp(topo) OVER w AS sd FROM h
      WINDOW w AS (PARTITION BY ano, semestre))""",
)
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    df = half_years(spark, sf).select(*PERIOD, "municipio", "topo")
    return rounded(rank.zscore(df, PERIOD, "topo", "z").drop("topo"))


@query(
    "impute_median",
    f"""{HALF} SELECT ano, semestre, municipio, {r("coalesce(topo, m, 0)", "topo")} FROM h
      LEFT JOIN (SELECT ano, semestre, median(topo::DOUBLE) AS m FROM h GROUP BY ALL) USING (ano, semestre)""",
)
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    df = half_years(spark, sf).select(*PERIOD, "municipio", "topo")
    return rounded(rank.impute_median(df, PERIOD, ["topo"]))


@query(
    "page",
    f"""WITH {MOV} SELECT municipio, {SUMS}, CAST((SELECT count(DISTINCT municipio) FROM mov) AS BIGINT) AS total
    FROM mov GROUP BY municipio ORDER BY saldo DESC NULLS LAST, municipio LIMIT 25 OFFSET 30""",
)
def page(spark: SparkSession, sf: str) -> DataFrame:
    df = by(spark, sf, ["municipio"])
    return rank.page(df, 25, 30, "saldo", True, ["municipio"])


_DEEP = """SELECT '{0}' AS ordem, l_orderkey, l_linenumber, l_quantity, CAST(total AS BIGINT) AS total FROM
    (SELECT *, row_number() OVER (ORDER BY {1}, l_orderkey, l_linenumber) AS n, count(*) OVER () AS total FROM lineitem) t
    WHERE n > {2} AND n <= {2} + 500"""


@query(
    "deep_page",
    " UNION ALL ".join(
        _DEEP.format(*x) for x in (
            ("quantidade", "l_quantity DESC", 4000), ("preco", "l_extendedprice", 3000), ("fim", "l_shipdate", 5900),
        )
    ),
)
def deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """Pages far into the line items: by a key of few values, by one of many, by a date."""
    lines = table(spark, sf, "lineitem")
    out = None
    for name, column, down, offset in (
        ("quantidade", "l_quantity", True, 4000), ("preco", "l_extendedprice", False, 3000), ("fim", "l_shipdate", False, 5900),
    ):
        found = rank.deep_page(lines, 500, offset, column, down, ["l_orderkey", "l_linenumber"], leaf=1000)
        one = found.select(F.lit(name).alias("ordem"), "l_orderkey", "l_linenumber", "l_quantity", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "top_k",
    f"""WITH {MOV} SELECT municipio, {SUMS} FROM mov GROUP BY municipio
    ORDER BY saldo DESC NULLS LAST, municipio LIMIT 12""",
)
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    # The asked metric does not exist in this table: the fallback is used.
    return rank.top_k(by(spark, sf, ["municipio"]), 12, "salario_medio", "saldo", ["municipio"])


@query(
    "top_abs",
    f"""WITH {MOV}, t AS (SELECT subclasse, {SUMS} FROM mov GROUP BY subclasse)
    SELECT subclasse, saldo, CAST(abs(saldo) AS DOUBLE) AS valor FROM t WHERE saldo <> 0
    ORDER BY abs(saldo) DESC, subclasse LIMIT 30""",
)
def top_abs(spark: SparkSession, sf: str) -> DataFrame:
    df = by(spark, sf, ["subclasse"]).select("subclasse", "saldo")
    return rank.top_abs(df, "saldo", 30, ["subclasse"])


@query(
    "top_bottom",
    f"""{HALF}, k AS (SELECT *, dense_rank() OVER (PARTITION BY ano, semestre ORDER BY topo DESC) AS posicao
      FROM h WHERE topo IS NOT NULL)
    SELECT * FROM (SELECT ano, semestre, municipio, posicao,
      CAST(row_number() OVER (PARTITION BY ano, semestre ORDER BY posicao, municipio) AS INTEGER) AS pos,
      'top' AS lista FROM k) WHERE pos <= 10
    UNION ALL SELECT * FROM (SELECT ano, semestre, municipio, posicao,
      CAST(row_number() OVER (PARTITION BY ano, semestre ORDER BY posicao DESC, municipio DESC) AS INTEGER) AS pos,
      'bottom' AS lista FROM k) WHERE pos <= 10""",
)
def top_bottom(spark: SparkSession, sf: str) -> DataFrame:
    df = half_years(spark, sf).select(*PERIOD, "municipio", "topo")
    ranked = stage(dense_rank_desc(df, PERIOD, "topo", "posicao").drop("topo"), "ranked")
    return rank.top_bottom(ranked, PERIOD, "posicao", ["municipio"])


@query(
    "previous_period",
    f"""WITH {MOV} SELECT competencia, lag(competencia) OVER (ORDER BY competencia) AS anterior
    FROM (SELECT DISTINCT competencia FROM mov)""",
)
def previous_period(spark: SparkSession, sf: str) -> DataFrame:
    return rank.period_pairs(movements(spark, sf, ["competencia"]), "competencia")


@query(
    "period_delta",
    f"""WITH {MOV}, m AS (SELECT municipio, competencia, CAST(sum(saldomovimentacao) AS DOUBLE) AS v
      FROM mov GROUP BY ALL),
    p AS (SELECT competencia, lag(competencia) OVER (ORDER BY competencia) AS anterior
      FROM (SELECT DISTINCT competencia FROM m)),
    d AS (SELECT c.municipio, c.competencia, p.anterior, b.v AS previo, c.v AS atual, c.v - b.v AS delta,
        {r("(c.v - b.v) / nullif(b.v, 0) * 100", "delta_pct")}
      FROM m c JOIN p USING (competencia) JOIN m b ON b.municipio = c.municipio AND b.competencia = p.anterior)
    SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY competencia ORDER BY delta, municipio) AS k
      FROM d WHERE delta < 0) WHERE k <= 8
    UNION ALL SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY competencia
      ORDER BY delta DESC, municipio) AS k FROM d WHERE delta > 0) WHERE k <= 8""",
)
def period_delta(spark: SparkSession, sf: str) -> DataFrame:
    values = stage(by(spark, sf, ["municipio", "competencia"]), "monthly")
    pairs = rank.period_pairs(values, "competencia")
    delta = rank.period_delta(values, pairs, "municipio", "competencia", "saldo")
    return rounded(rank.largest_changes(delta, "municipio", "competencia"))


@query(
    "positive_share",
    f"""WITH {MOV}, t AS (SELECT pais, {SUMS} FROM mov GROUP BY pais)
    SELECT pais, saldo, {r("CASE WHEN saldo > 0 THEN 100.0 * saldo / "
                           "(SELECT sum(saldo) FROM t WHERE saldo > 0) END", "participacao")} FROM t""",
)
def positive_share(spark: SparkSession, sf: str) -> DataFrame:
    df = by(spark, sf, ["pais"]).select("pais", "saldo")
    return rounded(rank.positive_share(df, "saldo"))


@query(
    "pivot_pairs",
    f"""WITH {MOV} SELECT graudeinstrucao,
      CAST(sum(admissao) FILTER (sexo = 'F') AS BIGINT) AS "F",
      CAST(sum(admissao) FILTER (sexo = 'O') AS BIGINT) AS "O" FROM mov GROUP BY graudeinstrucao""",
)
def pivot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = by(spark, sf, ["graudeinstrucao", "sexo"])
    return rank.pivot_pairs(df, "graudeinstrucao", "sexo", "admissoes", ["F", "O"])


@query(
    "heatmap_matrix",
    f"""WITH {MOV}, t AS (SELECT sexo, faixa_etaria, round(avg(salario), 6) AS salario_medio FROM mov GROUP BY ALL)
    SELECT sexo, faixa_etaria, salario_medio, CASE sexo WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS linha,
      CASE faixa_etaria {" ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(AGE_ORDER))} ELSE 7 END AS coluna,
      {r("CASE WHEN lo = hi THEN 0.65 ELSE (salario_medio - lo) / (hi - lo) END", "intensidade")}
    FROM t, (SELECT min(salario_medio) AS lo, max(salario_medio) AS hi FROM t)""",
)
def heatmap_matrix(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["sexo", "faixa_etaria", "salario"])
    cells = df.groupBy("sexo", "faixa_etaria").agg(
        F.round(F.avg("salario"), 6).alias("salario_medio")
    )
    return rounded(
        rank.heatmap(cells, "salario_medio", "sexo", "faixa_etaria", ["O", "F"], AGE_ORDER)
    )


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.where(F.col("n") > 1)


@query(
    "totals_by_state",
    f"WITH {MOV} SELECT uf, ano, count(*) AS n, {SUMS} FROM mov GROUP BY uf, ano",
)
def totals_by_state(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["uf", "ano", *FLAGS])
    return df.groupBy("uf", "ano").agg(F.count(F.lit(1)).alias("n"), *mv.movement_sums())


@query(
    "category_share",
    f"""WITH {MOV} SELECT ano, {r("100.0 * sum(admissao) FILTER (uf = 'NATION_0') / nullif(sum(admissao), 0)", "adm_pct")},
      {r("100.0 * sum(desligamento) FILTER (uf = 'NATION_0') / nullif(sum(desligamento), 0)", "des_pct")},
      {r("100.0 * sum(saldomovimentacao) FILTER (uf = 'NATION_0') / nullif(sum(saldomovimentacao), 0)", "saldo_pct")}
    FROM mov GROUP BY ano""",
)
def category_share(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, ["uf", "ano", *FLAGS])
    chosen = F.col("uf") == "NATION_0"

    def share(flag: str, name: str):
        part = F.sum(F.when(chosen, F.col(flag)))
        return (ratio(part, F.sum(flag)) * 100.0).alias(name)

    return rounded(
        df.groupBy("ano").agg(
            share("admissao", "adm_pct"),
            share("desligamento", "des_pct"),
            share("saldomovimentacao", "saldo_pct"),
        )
    )


@query(
    "event_counters",
    """SELECT CASE WHEN grouping(event_type) = 0 THEN 'tipo' WHEN grouping(user_id) = 0 THEN 'usuario' ELSE 'k' END AS grupo,
      coalesce(event_type, user_id::VARCHAR, k) AS valor, count(*) AS n
    FROM (SELECT event_type, user_id, json_extract_string(props, '$.k') AS k FROM events)
    GROUP BY GROUPING SETS ((event_type), (user_id), (k))
    UNION ALL SELECT 'recente', event_id::VARCHAR, pos FROM (
      SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos <= 20""",
)
def event_counters(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    keyed = events.select(
        "event_type",
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    kinds = F.array(*[F.lit(x) for x in ("tipo", "usuario", "k")])
    # Each grouping number leaves exactly one of the three columns.
    counts = (
        keyed.groupingSets([["event_type"], ["user_id"], ["k"]], "event_type", "user_id", "k")
        .agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
        .select(
            F.element_at(kinds, F.when(F.col("g") == 3, 1).when(F.col("g") == 5, 2).otherwise(3)).alias("grupo"),
            F.coalesce("event_type", "user_id", "k").alias("valor"),
            "n",
        )
    )
    latest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    # At most twenty rows are numbered here.
    latest = rank.top_within(latest, [], [F.desc("ts"), F.desc("event_id")], 20)
    return counts.unionByName(
        latest.select(
            F.lit("recente").alias("grupo"),
            F.col("event_id").cast("string").alias("valor"),
            F.col("pos").cast("long").alias("n"),
        )
    )


@query(
    "kpi_summary",
    f"WITH {MOV} SELECT CAST(sum(admissao) AS DOUBLE) AS admissoes, CAST(sum(desligamento) AS DOUBLE) AS desligamentos, "
    "CAST(sum(saldomovimentacao) AS DOUBLE) AS saldo FROM mov WHERE uf = 'NATION_3'",
)
def kpi_summary(spark: SparkSession, sf: str) -> DataFrame:
    states = by(spark, sf, ["uf"])
    # The short code of the state is preferred, its name is the fallback.
    code, name = F.upper("uf") == "N3", F.lower(F.trim("uf")) == "nation_3"
    metrics = ("admissoes", "desligamentos", "saldo")

    def kpi(m: str):
        value = F.col(m).cast("double")
        by_code = F.sum(F.when(code, value))
        by_name = F.sum(F.when(name, value))
        return F.coalesce(by_code, by_name, F.lit(0.0)).alias(m)

    return states.agg(*[kpi(m) for m in metrics])


@query(
    "dedup_keep_last",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
        l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1""",
)
def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return last_per_key(df, ["l_orderkey", "l_linenumber"], order).drop("l_shipdate")


_MONTH_SQL = "['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro','Novembro','Dezembro']"


@query(
    "list_periods",
    f"""WITH p AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(month(o_orderdate) AS INTEGER) AS mes FROM orders)
    SELECT ano, mes, {_MONTH_SQL}[mes] || ' de ' || ano::VARCHAR AS rotulo,
      (ano, mes) = (SELECT (1998, 4)) AS padrao, (ano, mes) = (SELECT max((ano, mes)) FROM p) AS ultimo FROM p""",
)
def list_periods(spark: SparkSession, sf: str) -> DataFrame:
    months = (
        table(spark, sf, "orders")
        .select(F.year("o_orderdate").alias("ano"), F.month("o_orderdate").alias("mes"))
        .distinct()
    )
    number = F.col("ano") * 100 + F.col("mes")
    marked = rank.with_stats(months, [], __last=F.max(number))
    return marked.select(
        "ano",
        "mes",
        period_label(F.col("ano"), F.col("mes")).alias("rotulo"),
        (number == 199804).alias("padrao"),
        (number == F.col("__last")).alias("ultimo"),
    )
