"""Validations, gates and reconciliations over the bound movement table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.operators import movement as mv
from fluxora.operators import quality
from fluxora.plans.binding import movements, scopes, suppliers, table
from fluxora.session import stage
from fluxora.workload.aggregates import MATRIX_COLUMNS
from fluxora.workload.base import MOV, SCOPE_WHERE, SUMS, query, r, rounded
from fluxora.workload.indices import CLASSED, PERIOD, classed_index

FLAGS = ["admissao", "desligamento", "saldomovimentacao"]


def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned table with faults planted in three years.

    1996 has hire flags that ignore the sign, 1997 no usable wage and 1999 rows that
    claim another month.
    """
    df = movements(
        spark, sf,
        ["ano", "mes", "data", *FLAGS, "sexo", "uf", "municipio", "secao", "cbo2002ocupacao",
         "racacor", "graudeinstrucao", "idade", "faixa_etaria", "horascontratuais", "salario",
         "valorsalariofixo"],
    )
    wrong_month = (F.col("ano") == 1999) & (F.col("mes") == 5) & (F.col("sexo") == "F")
    text = F.concat(F.date_format("data", "yyyyMM"), F.lit(".0"))
    return df.withColumns(
        {
            "competencia_date": F.trunc("data", "month"),
            "competenciamov": F.when(wrong_month, "199904").otherwise(text),
            "admissao": F.when((F.col("ano") == 1996) & (F.col("mes") == 2), 1).otherwise(
                F.col("admissao")
            ),
            "salario": F.when(F.col("ano") != 1997, F.col("salario")),
        }
    )


_CLEAN = f"""{MOV}, c AS (SELECT * REPLACE (CASE WHEN ano = 1996 AND mes = 2 THEN 1 ELSE admissao END AS admissao,
      CASE WHEN ano <> 1997 THEN salario END AS salario),
      CASE WHEN ano = 1999 AND mes = 5 AND sexo = 'F' THEN '199904' ELSE strftime(data, '%Y%m') END AS mov_txt FROM mov),
  v0 AS (SELECT ano, mes, count(*) AS linhas, CAST(sum(admissao) AS BIGINT) AS admissao_sum,
      CAST(sum(desligamento) AS BIGINT) AS desligamento_sum, CAST(sum(admissao) - sum(desligamento) AS BIGINT) AS saldo_sum,
      CAST(sum(saldomovimentacao) AS BIGINT) AS unit,
      count(*) FILTER (saldomovimentacao = 0) AS fora_do_sinal,
      count(*) FILTER (admissao <> CASE WHEN saldomovimentacao = 1 THEN 1 ELSE 0 END) AS adm_divergente,
      count(*) FILTER (desligamento <> CASE WHEN saldomovimentacao = -1 THEN 1 ELSE 0 END) AS des_divergente,
      count(*) FILTER (mov_txt <> strftime(data, '%Y%m')) AS periodo_divergente, count(salario) AS n_sal
    FROM c GROUP BY ano, mes),
  v AS (SELECT ano, mes, linhas, admissao_sum, desligamento_sum, saldo_sum, fora_do_sinal, adm_divergente, des_divergente,
      periodo_divergente, array_to_string(list_sort(list_filter([
        'missing_recommended:regiao', 'missing_recommended:subclasse', 'missing_recommended:tipomovimentacao',
        CASE WHEN n_sal = 0 THEN 'all_null:salario' END, CASE WHEN periodo_divergente > 0 THEN 'period_mismatch' END,
        CASE WHEN fora_do_sinal > 0 THEN 'sign_outside' END,
        CASE WHEN adm_divergente + des_divergente > 0 THEN 'flag_mismatch' END,
        CASE WHEN saldo_sum <> unit THEN 'net_differs' END], lambda x: x IS NOT NULL)), ',') AS codigos,
      CASE WHEN n_sal = 0 OR periodo_divergente > 0 OR adm_divergente + des_divergente > 0 THEN 'error' ELSE 'warning' END AS status
    FROM v0)"""


def validation(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.format_string("%04d%02d", F.col("ano"), F.col("mes"))
    return quality.validate_clean(clean_table(spark, sf), ["ano", "mes"], expected)


@query("validate_clean", f"WITH {_CLEAN} SELECT * FROM v")
def validate_clean(spark: SparkSession, sf: str) -> DataFrame:
    return validation(spark, sf)


@query(
    "gate_periods",
    f"""WITH {_CLEAN} SELECT ano, mes, nota, count(*) AS n, {SUMS} FROM (
      SELECT c.*, CASE WHEN v.status = 'warning' THEN 'warning' WHEN v.status IS NULL THEN 'not validated' ELSE '' END AS nota
      FROM c LEFT JOIN (SELECT * FROM v WHERE ano <> 2001) v USING (ano, mes) WHERE coalesce(v.status, '') <> 'error')
    GROUP BY ano, mes, nota""",
)
def gate_periods(spark: SparkSession, sf: str) -> DataFrame:
    # The last year has not been validated: it passes with a note.
    known = stage(validation(spark, sf).where("ano <> 2001"), "validation")
    passed = quality.gate_periods(clean_table(spark, sf), known, ["ano", "mes"])
    return passed.groupBy("ano", "mes", "nota").agg(
        F.count(F.lit(1)).alias("n"), *mv.movement_sums()
    )


@query(
    "table_invariants",
    f"""WITH {MOV}, t AS (SELECT indtrabparcial, uf, ano, {SUMS} FROM mov GROUP BY ALL),
    d AS (SELECT indtrabparcial, uf, count(*) AS n, count(*) FILTER (saldo <> admissoes - desligamentos) AS net FROM t GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS linhas, CAST(0 AS BIGINT) AS metricas_nulas, CAST(sum(net) AS BIGINT) AS saldo_incoerente,
      CAST(0 AS BIGINT) AS negativos, CAST(sum(n) FILTER (indtrabparcial IS NULL) AS BIGINT) AS chaves_nulas,
      count(*) FILTER (n > 1) AS chaves_duplicadas FROM d""",
)
def table_invariants(spark: SparkSession, sf: str) -> DataFrame:
    # The key leaves the year out, so it repeats and the duplicate check must fire.
    df = movements(spark, sf, ["indtrabparcial", "uf", "ano", *FLAGS])
    aggregated = mv.movement_aggregate(df, ["indtrabparcial", "uf", "ano"])
    return quality.table_invariants(aggregated, ["indtrabparcial", "uf"])


RECONCILE = {
    "tabela_resumo": ["tabela_uf", "tabela_municipio", "tabela_setor", "tabela_ocupacao"],
    "tabela_municipio_pr": ["tabela_setor_pr", "tabela_perfil_sexo_pr"],
    "tabela_municipio_rmc": ["tabela_setor_rmc", "tabela_perfil_sexo_rmc"],
}
_SCOPE_OF = {"tabela_resumo": "br", "tabela_municipio_pr": "pr", "tabela_municipio_rmc": "rmc"}


def movement_matrix(spark: SparkSession, sf: str) -> DataFrame:
    plain = [s for s in mv.TABLES if not s.wages]
    columns = [c for c in MATRIX_COLUMNS if c != "salario"]
    return mv.table_matrix(movements(spark, sf, columns), scopes(), plain)


@query(
    "reconcile_totals",
    f"WITH {MOV} "
    + " UNION ALL ".join(
        f"SELECT '{base}' AS referencia, '{peer}' AS tabela, {SUMS}, "
        f"CAST(sum(admissao) AS BIGINT) AS ref_admissoes, CAST(sum(desligamento) AS BIGINT) AS ref_desligamentos, "
        f"CAST(sum(saldomovimentacao) AS BIGINT) AS ref_saldo, TRUE AS confere FROM mov WHERE {SCOPE_WHERE[_SCOPE_OF[base]]}"
        for base, peers in RECONCILE.items()
        for peer in peers
    ),
)
def reconcile_totals(spark: SparkSession, sf: str) -> DataFrame:
    matrix = stage(movement_matrix(spark, sf), "matrix")
    return quality.reconcile_totals(matrix, RECONCILE)


@query(
    "validate_gold",
    f"""WITH {MOV}, s AS (SELECT {SUMS} FROM mov) SELECT CAST(38 AS BIGINT) AS tabelas, CAST(1 AS BIGINT) AS n_faltando, s.*,
      CASE WHEN saldo <> admissoes - desligamentos THEN 'missing_tables,net_differs' ELSE 'missing_tables' END AS codigos,
      'error' AS status FROM s""",
)
def validate_gold(spark: SparkSession, sf: str) -> DataFrame:
    # One wage table is required but was not built.
    totals = stage(quality.table_totals(movement_matrix(spark, sf)), "totals")
    clean = mv.movement_total(movements(spark, sf, FLAGS))
    required = ["tabela_resumo", "tabela_uf", "tabela_municipio", "tabela_perfil_sexo_salario"]
    return quality.validate_gold(totals, clean, required)


@query(
    "compare_copies",
    f"""WITH {MOV}, g AS (SELECT municipio, ano, CAST(sum(admissao) AS BIGINT) AS admissoes,
      CAST(sum(desligamento) AS BIGINT) AS desligamentos, max(salario) AS topo FROM mov WHERE ano < 2001 GROUP BY ALL),
    s AS (SELECT municipio, ano, admissoes + CASE WHEN ano = 1998 THEN 1 ELSE 0 END AS admissoes, desligamentos,
      topo + 0.0005 AS topo FROM g),
    m AS (SELECT 'linhas' AS medida, (SELECT count(*) FROM g)::DOUBLE AS esquerda, (SELECT count(*) FROM s)::DOUBLE AS direita
      UNION ALL SELECT 'admissoes_soma', (SELECT sum(admissoes) FROM g), (SELECT sum(admissoes) FROM s)
      UNION ALL SELECT 'desligamentos_soma', (SELECT sum(desligamentos) FROM g), (SELECT sum(desligamentos) FROM s)
      UNION ALL SELECT 'topo_media', (SELECT avg(topo) FROM g), (SELECT avg(topo) FROM s)
      UNION ALL SELECT 'topo_min', (SELECT min(topo) FROM g), (SELECT min(topo) FROM s)
      UNION ALL SELECT 'topo_max', (SELECT max(topo) FROM g), (SELECT max(topo) FROM s))
    SELECT medida, {r('esquerda', 'esquerda', 4)}, {r('direita', 'direita', 4)},
      CASE WHEN medida LIKE 'topo%' THEN 'warning' WHEN esquerda = direita THEN 'ok' ELSE 'fail' END AS resultado FROM m""",
)
def compare_copies(spark: SparkSession, sf: str) -> DataFrame:
    # The served copy has one year more, a count that is off and slightly moved wages.
    df = movements(spark, sf, ["municipio", "ano", *FLAGS, "salario"])
    facts = df.groupBy("municipio", "ano").agg(
        F.sum(F.col("admissao").cast("long")).alias("admissoes"),
        F.sum(F.col("desligamento").cast("long")).alias("desligamentos"),
        F.max("salario").alias("topo"),
    )
    facts = stage(facts, "facts")
    served = facts.withColumns(
        {
            "admissoes": F.col("admissoes") + F.when(F.col("ano") == 1998, 1).otherwise(0),
            "topo": F.col("topo") + 0.0005,
        }
    )
    compared = quality.compare_copies(
        facts.where("ano < 2001"),
        served,
        ["municipio", "ano"],
        ["admissoes", "desligamentos"],
        ["topo"],
    )
    return rounded(compared, 4)


@query(
    "validate_index",
    f"""{CLASSED} SELECT ano, semestre, CAST(count(*) AS BIGINT) AS linhas, CAST(0 AS BIGINT) AS sem_chave,
      CAST(0 AS BIGINT) AS chaves_duplicadas, CAST(count(*) FILTER (trim(coalesce(classe, '')) = '') AS BIGINT) AS vazio_classe,
      (SELECT count(*) FROM places) AS esperadas, count(*) = (SELECT count(*) FROM places) AS valido
    FROM k GROUP BY ano, semestre""",
)
def validate_index(spark: SparkSession, sf: str) -> DataFrame:
    expected = suppliers(spark, sf).agg(F.count(F.lit(1))).scalar()
    index = stage(classed_index(spark, sf), "classed")
    return quality.validate_index(index, PERIOD, "cod_municipio", ["classe"], expected)


CONTRACT_TABLES = ("lineitem", "orders", "customer", "supplier", "part")
NEEDED = sorted({*quality.REQUIRED_INPUT, *quality.DERIVED})


@query(
    "contract_columns",
    " UNION ALL ".join(
        f"SELECT '{t}' AS tabela, (SELECT count(*) FROM {t}) AS linhas, (SELECT count(*) FROM (DESCRIBE {t})) AS n_colunas, "
        f"'{','.join(NEEDED)}' AS faltando, FALSE AS ok"
        for t in CONTRACT_TABLES
    )
    + " UNION ALL SELECT 'movimentos', (SELECT count(*) FROM lineitem), 20, '', TRUE",
)
def contract_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Every given table and the bound movements against the movement contract."""
    frames = {name: table(spark, sf, name) for name in CONTRACT_TABLES}
    frames["movimentos"] = clean_table(spark, sf)
    out = None
    for name, df in frames.items():
        # The column list comes from the schema, the row count from the data.
        found = F.array(*[F.lit(c) for c in df.columns])
        missing = F.array_except(F.array(*[F.lit(c) for c in NEEDED]), found)
        one = df.agg(F.count(F.lit(1)).alias("linhas")).select(
            F.lit(name).alias("tabela"),
            "linhas",
            F.size(found).cast("long").alias("n_colunas"),
            F.array_join(missing, ",").alias("faltando"),
            (F.size(missing) == 0).alias("ok"),
        )
        out = one if out is None else out.unionByName(one)
    return out
