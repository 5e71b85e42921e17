"""Both composite indices, their specification checks and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.operators import index_frozen as fi
from fluxora.operators import index_pca as pca
from fluxora.operators import rank, report, territory
from fluxora.plans.binding import movements, star_spec, suppliers
from fluxora.session import stage
from fluxora.workload.base import MOV, PLACES, query, r, rounded
from fluxora.workload.territories import INDICATOR_INPUT, ROW_KEY, entropy_ctes

PERIOD = ["ano", "semestre"]
PLACE = ["cod_municipio"]
INPUT = [
    *PERIOD, "cod_municipio", "saldomovimentacao", "admissao", "desligamento", "salario",
    "indtrabparcial", "indtrabintermitente", "cbo2002ocupacao", "subclasse", "secao",
]
COMPONENTS = ["absorcao", "remuneracao", "qualidade_contratual", "diversificacao"]


def index_inputs(spark: SparkSession, sf: str) -> DataFrame:
    # Codes identify the territory; names and states come from the universe.
    df = movements(spark, sf, INPUT).withColumns(
        {"municipio": F.col("cod_municipio"), "uf": F.lit(None).cast("string")}
    )
    return stage(fi.index_inputs(df, PERIOD, PLACE, star_spec()), "index-inputs")


def scored_index(spark: SparkSession, sf: str) -> DataFrame:
    spec = star_spec()
    inputs = index_inputs(spark, sf)
    universe = suppliers(spark, sf).select("cod_municipio", "municipio", "uf")
    spine = territory.periods_spine(universe, inputs.select(*PERIOD).distinct(), "periodo")
    expanded = fi.expand_index(inputs, spine, PERIOD)
    return stage(fi.score_index(expanded, PERIOD, spec), "scored-index")


def ranked_index(spark: SparkSession, sf: str) -> DataFrame:
    return fi.rank_index(scored_index(spark, sf), PERIOD, star_spec())


def staged_index(spark: SparkSession, sf: str) -> DataFrame:
    """The published table the reports read."""
    return stage(ranked_index(spark, sf), "index")


_K = "ano, semestre, cod_municipio"
_CATS = {"cbo": "cbo2002ocupacao", "subclasse": "subclasse", "secao": "secao"}
_OK = ("admissao = 1 AND indtrabintermitente <> 'Sim' AND salario > 0 AND salario >= 0.3::DOUBLE * piso "
       "AND salario <= 150.0 * piso")


def _score(x: str, bound: str) -> str:
    lo, hi = star_spec().bounds[bound]
    return (f"CASE WHEN {x} IS NOT NULL THEN 100 * least(greatest(({x} - {lo}::DOUBLE) / "
            f"({hi}::DOUBLE - {lo}::DOUBLE), 0), 1) END")


INDEX = f"""WITH {MOV}, {PLACES}, {entropy_ctes(_K, _CATS)},
  b AS (SELECT {_K}, count(*) AS n_movimentacoes, CAST(sum(admissao) AS BIGINT) AS admissoes,
      CAST(sum(desligamento) AS BIGINT) AS desligamentos, CAST(sum(saldomovimentacao) AS BIGINT) AS saldo,
      count(*) FILTER (admissao = 1 AND indtrabparcial = 'Sim') AS n_parcial,
      count(*) FILTER (admissao = 1 AND indtrabintermitente = 'Sim') AS n_intermitente FROM mov GROUP BY {_K}),
  w AS (SELECT ano, semestre, cod_municipio, salario FROM (SELECT *, 500.0 + 20 * (ano - 1995) AS piso FROM mov) WHERE {_OK}),
  wl AS (SELECT {_K}, count(*) AS n_salarios_r4, median(salario) AS salario_mediano_r4_municipio FROM w GROUP BY {_K}),
  wp AS (SELECT ano, semestre, median(salario) AS salario_mediano_r4_escopo FROM w GROUP BY ano, semestre),
  per AS (SELECT DISTINCT ano, semestre FROM mov),
  x AS (SELECT per.ano, per.semestre, p.cod_municipio, p.municipio, p.uf,
      coalesce(admissoes, 0) AS admissoes, coalesce(desligamentos, 0) AS desligamentos,
      coalesce(n_movimentacoes, 0) AS n_movimentacoes, coalesce(saldo, 0) AS saldo,
      coalesce(n_parcial, 0) AS n_parcial, coalesce(n_intermitente, 0) AS n_intermitente,
      coalesce(n_salarios_r4, 0) AS n_salarios_r4, salario_mediano_r4_municipio, salario_mediano_r4_escopo,
      salario_mediano_r4_municipio / nullif(salario_mediano_r4_escopo, 0) AS salario_relativo_r4,
      shannon_cbo, shannon_subclasse, shannon_secao
    FROM places p CROSS JOIN per LEFT JOIN wp ON wp.ano = per.ano AND wp.semestre = per.semestre
      {" ".join(f"LEFT JOIN {t} ON {t}.cod_municipio = p.cod_municipio AND {t}.ano = per.ano AND {t}.semestre = per.semestre" for t in ("b", "wl", "e_cbo", "e_subclasse", "e_secao"))}),
  y AS (SELECT *, admissoes >= 10 AS calculavel,
      CASE WHEN admissoes >= 20 THEN 'higher' WHEN admissoes >= 10 THEN 'reduced' END AS reliability_class,
      ln(1 + admissoes) AS a_volume_raw, {_score("ln(1 + admissoes)", "a_volume_raw")} AS a_volume_score,
      100.0 * (admissoes + 5) / (admissoes + desligamentos + 10) AS a_saldo,
      {_score("salario_relativo_r4", "salario_relativo_r4")} AS remuneracao,
      100.0 * n_parcial / nullif(admissoes, 0) AS perc_parcial_admissao,
      100.0 * n_intermitente / nullif(admissoes, 0) AS perc_intermitente_admissao,
      {_score("shannon_cbo", "shannon_cbo")} AS d_cbo, {_score("shannon_subclasse", "shannon_subclasse")} AS d_subclasse,
      {_score("shannon_secao", "shannon_secao")} AS d_secao FROM x),
  z AS (SELECT *, 0.5 * a_volume_score + 0.5 * a_saldo AS absorcao,
      CASE WHEN admissoes > 0 THEN 100 - least(100, 2 * perc_parcial_admissao) END AS q_parcial,
      CASE WHEN admissoes > 0 THEN 100 - least(100, 4 * perc_intermitente_admissao) END AS q_intermitente,
      (d_cbo + d_subclasse + d_secao) / 3.0 AS diversificacao FROM y),
  i AS (SELECT *, 0.5 * q_parcial + 0.5 * q_intermitente AS qualidade_contratual FROM z),
  idx0 AS (SELECT *, CASE WHEN calculavel THEN 0.25 * (absorcao + remuneracao + qualidade_contratual + diversificacao) END AS indice FROM i),
  idx AS (SELECT *,
      CASE WHEN admissoes >= 10 AND indice IS NOT NULL THEN dense_rank() OVER (
        PARTITION BY ano, semestre, admissoes >= 10 AND indice IS NOT NULL ORDER BY indice DESC) END AS rank_n10,
      CASE WHEN admissoes >= 20 AND indice IS NOT NULL THEN dense_rank() OVER (
        PARTITION BY ano, semestre, admissoes >= 20 AND indice IS NOT NULL ORDER BY indice DESC) END AS rank_n20,
      '2.0' AS methodology_version, 'STAR.1995-1_2001-2' AS normalization_version, '1995-1/2001-2' AS reference_period
    FROM idx0)"""

_TEXT = {"reliability_class", "methodology_version", "normalization_version", "reference_period"}
_EXACT = {
    "admissoes", "desligamentos", "n_movimentacoes", "saldo", "calculavel", "n_salarios_r4",
    "n_parcial", "n_intermitente", "rank_n10", "rank_n20",
} | _TEXT
_INDEX_SELECT = ", ".join(c if c in _EXACT else r(c, c) for c in fi.SCORE_COLUMNS)
ID = [*PERIOD, "cod_municipio", "municipio", "uf"]


@query("frozen_index", f"{INDEX} SELECT {', '.join(ID)}, {_INDEX_SELECT} FROM idx")
def frozen_index(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranked_index(spark, sf).select(*ID, *fi.SCORE_COLUMNS))


@query(
    "wage_relative",
    f"""{INDEX} SELECT wl.ano, wl.semestre, wl.cod_municipio, n_salarios_r4,
      {r('salario_mediano_r4_municipio', 'salario_mediano_r4_municipio')},
      {r('salario_mediano_r4_escopo', 'salario_mediano_r4_escopo')},
      {r('salario_mediano_r4_municipio / salario_mediano_r4_escopo', 'salario_relativo_r4')}
    FROM wl JOIN wp USING (ano, semestre)""",
)
def wage_relative(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(
        spark, sf, [*PERIOD, "cod_municipio", "admissao", "salario", "indtrabintermitente"]
    )
    return rounded(fi.relative_wages(df, PERIOD, PLACE, star_spec()))


@query(
    "spec_join",
    f"""WITH {MOV} SELECT ano, {r('500.0 + 20 * (ano - 1995)', 'salario_minimo')}, CAST('conhecido' AS VARCHAR) AS situacao,
      count(*) AS n FROM mov WHERE ano < 2001 GROUP BY ano
    UNION ALL SELECT ano, NULL, 'sem piso', count(*) FROM mov WHERE ano = 2001 GROUP BY ano""",
)
def spec_join(spark: SparkSession, sf: str) -> DataFrame:
    # A specification without the last year: its movements must be reported.
    spec = star_spec()
    known = {y: v for y, v in spec.wage_floor.items() if y < 2001}
    spec = fi.replace(spec, wage_floor=known)
    df = movements(spark, sf, ["ano"])
    counted = df.groupBy("ano").agg(F.count(F.lit(1)).alias("n"))
    joined = fi.join_floor(counted, spec)
    known_rows = joined.where(F.col("salario_minimo").isNotNull()).select(
        "ano", "salario_minimo", F.lit("conhecido").alias("situacao"), "n"
    )
    unknown = fi.unknown_years(df, spec).select(
        "ano",
        F.lit(None).cast("double").alias("salario_minimo"),
        F.lit("sem piso").alias("situacao"),
        "n",
    )
    return known_rows.unionByName(unknown)


@query(
    "version_check",
    f"""{INDEX} SELECT ano, semestre, count(*) AS linhas, count(DISTINCT methodology_version) AS n_methodology,
      count(DISTINCT normalization_version) AS n_normalization, max(methodology_version) AS methodology_version,
      max(normalization_version) AS normalization_version, TRUE AS compativel FROM idx GROUP BY ano, semestre""",
)
def version_check(spark: SparkSession, sf: str) -> DataFrame:
    return fi.version_check(scored_index(spark, sf), PERIOD, star_spec())


@query(
    "fit_bounds",
    f"{INDEX}, t AS (UNPIVOT (SELECT a_volume_raw::DOUBLE AS a_volume_raw, salario_relativo_r4, shannon_cbo, shannon_subclasse, "
    f"shannon_secao FROM idx WHERE admissoes >= 10) ON COLUMNS(*) INTO NAME variavel VALUE valor) "
    f"SELECT variavel, {r('quantile_cont(valor, 0.05::DOUBLE)', 'p05')}, {r('quantile_cont(valor, 0.95::DOUBLE)', 'p95')} "
    "FROM t GROUP BY variavel",
)
def fit_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fi.fit_bounds(index_inputs(spark, sf), star_spec()))


_PUBLIC = [
    *ID, "calculavel", "reliability_class", "admissoes", "desligamentos", "saldo", *COMPONENTS,
    "indice", "rank_n10", "rank_n20",
]


def _public_sql(columns: list[str]) -> str:
    return ", ".join(
        c if c in _EXACT or c in ID else r(c, c) for c in columns
    )


@query("index_public_view", f"{INDEX} SELECT {_public_sql(_PUBLIC)} FROM idx")
def index_public_view(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fi.public_view(ranked_index(spark, sf), _PUBLIC))


@query(
    "index_lookup",
    f"{INDEX} SELECT {_public_sql(_PUBLIC)} FROM idx WHERE cod_municipio = '0000003' OR "
    "(ano = 1998 AND semestre = 1 AND reliability_class = 'higher')",
)
def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    code = "0000003"
    by_code = F.col("cod_municipio").rlike(r"^\d{7}$") & (F.col("cod_municipio") == code)
    by_class = (
        (F.col("ano") == 1998)
        & (F.col("semestre") == 1)
        & (F.col("reliability_class") == "higher")
    )
    index = fi.public_view(ranked_index(spark, sf), _PUBLIC)
    return rounded(index.where(by_code | by_class))


@query(
    "ranking_list",
    f"""{INDEX} SELECT ano, semestre, 'n10' AS universo, rank_n10 AS posicao, cod_municipio, {r('indice', 'indice')}
      FROM idx WHERE rank_n10 IS NOT NULL
    UNION ALL SELECT ano, semestre, 'n20', rank_n20, cod_municipio, round(indice, 6) + 0.0 FROM idx WHERE rank_n20 IS NOT NULL""",
)
def ranking_list(spark: SparkSession, sf: str) -> DataFrame:
    index = staged_index(spark, sf)

    def universe(name: str) -> DataFrame:
        column = f"rank_{name}"
        return index.where(F.col(column).isNotNull()).select(
            *PERIOD,
            F.lit(name).alias("universo"),
            F.col(column).alias("posicao"),
            "cod_municipio",
            "indice",
        )

    both = universe("n10").unionByName(universe("n20"))
    return rounded(both).orderBy("universo", *PERIOD, "posicao", "cod_municipio")


@query(
    "view_index_map",
    f"""{INDEX} SELECT idx.ano, idx.semestre, idx.cod_municipio, CASE WHEN indice IS NULL THEN 'sem_dados_suficientes'
      ELSE 'calculado' END AS status_calculo, {r('indice', 'indice')}, rank_n10, admissoes, desligamentos, saldo,
      CASE WHEN p.regiao <> 'ASIA' THEN p.municipio END AS nome_municipio
    FROM idx JOIN places p USING (cod_municipio)""",
)
def view_index_map(spark: SparkSession, sf: str) -> DataFrame:
    index = ranked_index(spark, sf)
    places = suppliers(spark, sf).where("regiao <> 'ASIA'")
    names = places.select("cod_municipio", F.col("municipio").alias("nome_municipio"))
    status = F.when(F.col("indice").isNull(), pca.INSUFFICIENT).otherwise(pca.CALCULATED)
    joined = index.join(names, "cod_municipio", "left")
    return rounded(
        joined.select(
            *PERIOD, "cod_municipio", status.alias("status_calculo"), "indice", "rank_n10",
            "admissoes", "desligamentos", "saldo", "nome_municipio",
        )
    )


@query(
    "index_kpis",
    f"""{INDEX} SELECT ano, semestre, count(indice) AS calculados, {r('avg(indice)', 'media')},
      arg_max(municipio, indice) AS municipio_topo, {r('max(indice)', 'indice_topo')},
      count(*) FILTER (indice IS NULL) AS insuficientes, count(*) FILTER (reliability_class = 'reduced') AS n_reduced,
      count(*) FILTER (reliability_class = 'higher') AS n_higher FROM idx GROUP BY ano, semestre""",
)
def index_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.index_kpis(scored_index(spark, sf), PERIOD, "indice"))


_SUMMARY = f"""SELECT ano, semestre, count(*) AS municipios_total, count(indice) AS municipios_com_indice,
      count(*) - count(indice) AS municipios_sem_base, {r('100.0 * count(indice) / count(*)', 'percentual_com_indice')},
      {r('avg(indice)', 'media')}, {r('median(indice)', 'mediana')}, {r('min(indice)', 'minimo')}, {r('max(indice)', 'maximo')},
      arg_min(municipio, rank_n10) FILTER (indice IS NOT NULL) AS municipio_lider, min(rank_n10) AS ranking_lider,
      CAST(coalesce(sum(admissoes) FILTER (indice IS NOT NULL), 0) AS BIGINT) AS admissoes_total,
      CAST(coalesce(sum(desligamentos) FILTER (indice IS NOT NULL), 0) AS BIGINT) AS desligamentos_total,
      CAST(coalesce(sum(saldo) FILTER (indice IS NOT NULL), 0) AS BIGINT) AS saldo_total FROM idx"""


@query("index_summary", f"{INDEX} {_SUMMARY} GROUP BY ano, semestre")
def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.index_summary(staged_index(spark, sf), PERIOD, "indice", "rank_n10"))


@query(
    "monthly_evolution",
    f"{INDEX} {_SUMMARY} WHERE ano < 1999 OR (ano = 1999 AND semestre <= 1) GROUP BY ano, semestre",
)
def monthly_evolution(spark: SparkSession, sf: str) -> DataFrame:
    upto = (F.col("ano") < 1999) | ((F.col("ano") == 1999) & (F.col("semestre") <= 1))
    index = staged_index(spark, sf)
    return rounded(report.monthly_evolution(index, PERIOD, "indice", "rank_n10", upto))


_CLASS = """CASE WHEN indice IS NULL THEN 'Sem movimentação migratória suficiente' WHEN e0 = e5 THEN 'Médio' ELSE
      ['Muito baixo', 'Baixo', 'Médio', 'Alto', 'Muito alto'][greatest(1,
        len(list_filter(list_distinct([e0, e1, e2, e3, e4, e5]), lambda x: x < indice)))] END"""
_EDGES = ", ".join(
    f"quantile_cont(indice, {p}::DOUBLE) AS e{i}" for i, p in enumerate((0, 0.2, 0.4, 0.6, 0.8, 1))
)
CLASSED = f"""{INDEX}, e AS (SELECT ano, semestre, {_EDGES} FROM idx GROUP BY ano, semestre),
  k AS (SELECT idx.*, {_CLASS} AS classe FROM idx JOIN e USING (ano, semestre))"""


def classed_index(spark: SparkSession, sf: str) -> DataFrame:
    return rank.quantile_classes(staged_index(spark, sf), PERIOD, "indice", "classe")


@query(
    "class_distribution",
    f"{CLASSED} SELECT ano, semestre, classe, count(*) AS n FROM k GROUP BY ALL",
)
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return report.class_distribution(classed_index(spark, sf), PERIOD, "classe")


@query(
    "dimension_summary",
    f"""{INDEX}, t AS (UNPIVOT (SELECT ano, semestre, municipio, absorcao::DOUBLE AS absorcao, remuneracao,
        qualidade_contratual, diversificacao FROM idx WHERE indice IS NOT NULL)
      ON absorcao, remuneracao, qualidade_contratual, diversificacao INTO NAME dimensao VALUE valor)
    SELECT ano, semestre, dimensao, {r('avg(valor)', 'media')}, {r('min(valor)', 'minimo')}, {r('max(valor)', 'maximo')},
      first(municipio ORDER BY valor DESC, municipio) AS municipio_maior,
      first(municipio ORDER BY valor, municipio) AS municipio_menor, {r('median(valor)', 'mediana')}
    FROM t GROUP BY ano, semestre, dimensao""",
)
def dimension_summary(spark: SparkSession, sf: str) -> DataFrame:
    index = stage(scored_index(spark, sf), "index")
    return rounded(report.dimension_summary(index, PERIOD, "indice", COMPONENTS))


RULES = {
    "lideres_com_contrato_fraco": ("rank_n10", "qualidade_contratual"),
    "lideres_com_remuneracao_fraca": ("rank_n10", "remuneracao"),
    "absorcao_alta_contrato_fraco": ("absorcao", "qualidade_contratual"),
    "diversificacao_alta_remuneracao_fraca": ("diversificacao", "remuneracao"),
}
LOW = 50.0


def _flags_sql() -> str:
    parts = []
    for flag, (strong, weak) in RULES.items():
        head = f"SELECT ano, semestre, '{flag}' AS alerta, municipio, round(indice, 6) + 0.0 AS indice, rank_n10 AS ranking, round({weak}, 6) + 0.0 AS valor"
        if strong == "rank_n10":
            parts.append(
                f"{head} FROM (SELECT *, row_number() OVER (PARTITION BY ano, semestre ORDER BY rank_n10, municipio) AS k "
                f"FROM idx WHERE indice IS NOT NULL) WHERE k <= 20 AND {weak} < 50"
            )
        else:
            parts.append(
                f"{head} FROM idx JOIN (SELECT ano, semestre, quantile_cont({strong}::DOUBLE, 0.75::DOUBLE) AS p75 FROM idx "
                f"WHERE indice IS NOT NULL GROUP BY ano, semestre) USING (ano, semestre) "
                f"WHERE indice IS NOT NULL AND {strong} > p75 AND {weak} < 50"
            )
    return f"{INDEX} " + " UNION ALL ".join(parts)


@query("diagnostic_flags", _flags_sql())
def diagnostic_flags(spark: SparkSession, sf: str) -> DataFrame:
    index = staged_index(spark, sf)
    return rounded(report.diagnostic_flags(index, PERIOD, "indice", "rank_n10", RULES, LOW))


@query(
    "run_summary",
    f"""{CLASSED}, s AS (SELECT *, CASE WHEN indice IS NULL THEN 'sem_dados_suficientes' ELSE 'calculado' END AS status FROM k)
    SELECT ano, semestre, 'status' AS bloco, status AS rotulo, count(*) AS n FROM s GROUP BY ALL
    UNION ALL SELECT ano, semestre, 'classe', classe, count(*) FROM s GROUP BY ALL
    UNION ALL SELECT ano, semestre, 'ranking', municipio, k FROM (SELECT *, row_number() OVER (
      PARTITION BY ano, semestre ORDER BY rank_n10, municipio) AS k FROM s WHERE rank_n10 IS NOT NULL) WHERE k <= 10
    UNION ALL SELECT ano, semestre, 'amostra_' || status, municipio, k FROM (SELECT *, row_number() OVER (
      PARTITION BY ano, semestre, status ORDER BY municipio) AS k FROM s) WHERE k <= 5""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("indice").isNull(), pca.INSUFFICIENT).otherwise(pca.CALCULATED)
    index = stage(classed_index(spark, sf).withColumn("status", status), "classed")
    return report.run_summary(index, PERIOD, "status", "classe", "rank_n10")


@query(
    "row_summary_text",
    f"""{CLASSED}, m AS (SELECT *, min(indice) OVER w AS lo, max(indice) OVER w AS hi FROM k WINDOW w AS (PARTITION BY ano, semestre)),
    t AS (SELECT *, CASE WHEN abs(lo - hi) <= 1e-8 + 1e-5 * abs(hi) THEN 50 ELSE (indice - lo) / (hi - lo) * 100 END AS percentil FROM m),
    f AS (SELECT *, {", ".join(f"coalesce(translate(format('{{:,.{d}f}}', {c}::DOUBLE), ',.', '.,'), '--') AS f_{c}" for c, d in dict(indice=1, percentil=1, admissoes=0, desligamentos=0, saldo=0, salario_mediano_r4_municipio=2, absorcao=2, remuneracao=2, qualidade_contratual=2, diversificacao=2, shannon_cbo=2).items())} FROM t)
    SELECT ano, semestre, cod_municipio, CASE WHEN indice IS NULL THEN municipio || chr(10) || 'Status: Sem movimentação migratória suficiente'
      ELSE municipio || chr(10) || 'Índice: ' || f_indice || ' | Classe: ' || classe || ' | Ranking: ' || rank_n10::VARCHAR || 'º | Percentil: ' || f_percentil
        || chr(10) || 'Admissões: ' || f_admissoes || ' | Desligamentos: ' || f_desligamentos || ' | Saldo: ' || f_saldo
        || chr(10) || 'Salário admissão: R$ ' || f_salario_mediano_r4_municipio
        || chr(10) || 'Dimensões: Absorção ' || f_absorcao || ' | Remuneração ' || f_remuneracao || ' | Contrato ' || f_qualidade_contratual || ' | Diversificação ' || f_diversificacao
        || chr(10) || 'Shannon CBO: ' || f_shannon_cbo END AS resumo FROM f""",
)
def row_summary_text(spark: SparkSession, sf: str) -> DataFrame:
    index = classed_index(spark, sf).withColumnRenamed("rank_n10", "ranking")
    index = rank.minmax_score(stage(index, "classed"), PERIOD, "indice", "percentil")
    parts = {
        "Absorção": "absorcao",
        "Remuneração": "remuneracao",
        "Contrato": "qualidade_contratual",
        "Diversificação": "diversificacao",
    }
    text = pca.summary_text(parts, wage="salario_mediano_r4_municipio")
    return index.select(*PERIOD, "cod_municipio", text.alias("resumo"))


@query("report_json")
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    index = stage(classed_index(spark, sf), "classed")
    return report.report_json(
        index, PERIOD, "indice", "rank_n10", "classe", COMPONENTS, RULES, LOW
    )


@query(
    "report_blocks",
    f"""{_flags_sql().replace(INDEX, CLASSED, 1).replace(" SELECT ano, semestre, 'lideres_com_contrato_fraco'", ", flags AS (SELECT ano, semestre, 'lideres_com_contrato_fraco'", 1)}),
    n AS (SELECT ano, semestre, 'summary' AS bloco, CAST(1 AS BIGINT) AS linhas FROM k GROUP BY ALL
      UNION ALL SELECT ano, semestre, 'classes', count(DISTINCT classe) FROM k GROUP BY ALL
      UNION ALL SELECT ano, semestre, 'top_bottom', 2 * least(10, count(rank_n10)) FROM k GROUP BY ALL
      UNION ALL SELECT ano, semestre, 'dimensions', 4 FROM k GROUP BY ALL
      UNION ALL SELECT ano, semestre, 'alerts', count(*) FROM flags GROUP BY ALL)
    SELECT *, CAST(0 AS BIGINT) AS linhas_nan FROM n WHERE linhas > 0""",
)
def report_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = report_json(spark, sf)
    return lines.groupBy(*PERIOD, "bloco").agg(
        F.count(F.lit(1)).alias("linhas"),
        F.count_if(F.col("documento").contains("NaN")).alias("linhas_nan"),
    )


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    df = movements(spark, sf, [ROW_KEY, *INDICATOR_INPUT])
    return territory.territory_indicators(df, [*PERIOD, "municipio"], ROW_KEY)


@query("pca_dimensions")
def pca_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    staged = stage(indicators(spark, sf), "indicators")
    scores = pca.dimension_scores(staged, PERIOD, ["municipio"])
    return rounded(scores.select(*PERIOD, "municipio", *pca.DIMENSION_NAMES))


@query("pca_index")
def pca_index(spark: SparkSession, sf: str) -> DataFrame:
    index = pca.pca_index(indicators(spark, sf), PERIOD, ["municipio"])
    return rounded(
        index.select(
            *PERIOD, "municipio", *pca.DIMENSION_NAMES, "indice", "status_calculo", "ranking",
            "percentil", "classe", "resumo",
        )
    )
