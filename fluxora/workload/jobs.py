"""The monthly job and its backfill over all months of the movement table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.operators import movement as mv
from fluxora.plans import job as jobs
from fluxora.plans.binding import movements, scopes, suppliers
from fluxora.session import scratch_path, stage
from fluxora.sources import lake, manifest
from fluxora.workload.base import IN_PR, IN_RMC, MOV, SUMS, query

SPECS = [
    s for s in mv.TABLES
    if s.name in ("tabela_resumo", "tabela_uf", "tabela_perfil_sexo", "tabela_municipio")
]
RENAMES = {"competenciamov": "competênciamov", "salario": "Salário", "municipio": "Município"}
LACKING_YEAR, SHORT_YEAR = 1999, 1998


def landing_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = movements(
        spark, sf,
        ["ano", "mes", "data", "saldomovimentacao", "horascontratuais", "salario",
         "valorsalariofixo", "uf", "regiao", "municipio", "secao", "sexo"],
    )

    def br(c: str):
        return F.translate(F.format_number(c, 2), ",.", ".,").alias(c)

    return rows.select(
        "ano", lake.month_text(F.col("mes")).alias("mes"),
        F.date_format("data", "yyyyMM").alias("competenciamov"),
        F.col("saldomovimentacao").cast("string").alias("saldomovimentacao"),
        br("horascontratuais"), br("salario"), br("valorsalariofixo"),
        "uf", "regiao", "municipio", "secao", "sexo", F.lit("30").alias("idade"),
    ).withColumnsRenamed(RENAMES)


def monthly_job(spark: SparkSession, sf: str) -> jobs.MonthlyJob:
    """A landing zone of all months: one year without a required column, one damaged."""
    root = scratch_path(spark, "job")
    rows = stage(landing_text(spark, sf), "landing")
    whole = rows.filter(F.col("ano") != LACKING_YEAR)
    spoilt = (F.col("ano") == SHORT_YEAR) & F.col("horascontratuais").endswith("0,00")
    lines = whole.withColumn("line", F.concat_ws(";", *[
        F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in whole.columns if c not in ("ano", "mes")
    ]))
    header = ";".join(c for c in whole.columns if c not in ("ano", "mes"))
    text = lines.select(
        "ano", "mes",
        F.when(spoilt, F.substring_index("line", ";", 3)).otherwise(F.col("line")).alias(header),
    )
    lake.balanced(text, ["ano", "mes"]).write.options(
        header=True, sep="\x01", quote="", escape="\x02"
    ).partitionBy("ano", "mes").csv(f"{root}/landing")
    lacking = rows.filter(F.col("ano") == LACKING_YEAR).drop("valorsalariofixo")
    lake.write_delimited(lacking, f"{root}/landing", ["ano", "mes"])
    places = suppliers(spark, sf).select("municipio", "cod_municipio")
    dictionary = spark.createDataFrame(
        [("sexo", "F", "Fechado"), ("sexo", "O", "Aberto")], "domain string, code string, label string"
    )
    return jobs.MonthlyJob(
        root, dictionary, {"sexo": "sexo"}, scopes(), places, SPECS,
        required=("tabela_resumo", "tabela_uf", "tabela_municipio"), min_bytes=1,
    )


_SPOILT = f"(ano = {SHORT_YEAR} AND horascontratuais % 10 = 0)"
_GOOD = f"good AS (SELECT * FROM mov WHERE ano <> {LACKING_YEAR} AND NOT {_SPOILT})"


@query(
    "monthly_job_gold",
    f"""WITH {MOV}, {_GOOD}
    SELECT 'tabela_uf' AS tabela, ano, mes, CAST(count(DISTINCT uf) AS BIGINT) AS linhas, {SUMS}, CAST(NULL AS BIGINT) AS codigos FROM good GROUP BY ano, mes
    UNION ALL SELECT 'tabela_resumo', ano, mes, 1, {SUMS}, NULL FROM good GROUP BY ano, mes
    {" ".join(f"UNION ALL SELECT 'tabela_perfil_sexo{s}', ano, mes, CAST(count(DISTINCT sexo) AS BIGINT), {SUMS}, NULL FROM good WHERE {w} GROUP BY ano, mes"
              for s, w in (("", "TRUE"), ("_pr", IN_PR), ("_rmc", IN_RMC)))}
    {" ".join(f"UNION ALL SELECT 'tabela_municipio{s}', ano, mes, CAST(count(DISTINCT municipio) AS BIGINT), {SUMS}, CAST(count(DISTINCT cod_municipio) AS BIGINT) FROM good WHERE {w} GROUP BY ano, mes"
              for s, w in (("", "TRUE"), ("_pr", IN_PR), ("_rmc", IN_RMC)) if f"tabela_municipio{s}" in [t.full_name(x) for t in SPECS for x in t.scopes])}""",
)
def monthly_job_gold(spark: SparkSession, sf: str) -> DataFrame:
    """All stages over all months: the published tables, with the codes of the places."""
    job = monthly_job(spark, sf)
    jobs.run(spark, job)
    gold = spark.read.parquet(job.path("gold/parquet"))
    keys = ["tabela", "ano", "mes"]
    codes = spark.read.parquet(job.path("enriched")).groupBy(*keys).agg(
        F.count_distinct("cod_municipio").alias("codigos")
    )
    return gold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("linhas"), *[F.sum(m).alias(m) for m in mv.METRICS]
    ).join(codes, keys, "left")


_MONTHS = "months AS (SELECT DISTINCT ano, mes FROM mov)"


@query(
    "monthly_job_ledger",
    f"""WITH {MOV}, {_MONTHS}, s(etapa, n) AS (VALUES ('landing', 1), ('clean', 2), ('gold', 3), ('enrich', 4), ('catalog', 5))
    SELECT ano, mes, etapa,
      CASE WHEN ano = {LACKING_YEAR} THEN CASE n WHEN 1 THEN 'error' ELSE 'blocked' END
        WHEN etapa = 'clean' THEN 'warning' ELSE 'ok' END AS primeira,
      CASE WHEN ano = {LACKING_YEAR} THEN CASE n WHEN 1 THEN 'error' ELSE 'blocked' END ELSE 'skipped' END AS segunda
    FROM months, s""",
)
def monthly_job_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every month at every stage, and of a second run over the same files."""
    job = monthly_job(spark, sf)
    keys = ["ano", "mes", "etapa"]
    first = jobs.run(spark, job).select(*keys, F.col("situacao").alias("primeira"))
    second = jobs.run(spark, job).select(*keys, F.col("situacao").alias("segunda"))
    return first.join(second, keys, "full")


@query(
    "backfill_run",
    f"""WITH {MOV}, {_MONTHS}, q AS (SELECT ano, mes, count(*) AS n FROM mov WHERE {_SPOILT} GROUP BY ALL),
    c AS (SELECT ano, mes, count(*) AS n FROM mov WHERE ano <> {LACKING_YEAR} AND NOT {_SPOILT} GROUP BY ALL),
    w AS (SELECT CAST(1997 + i // 12 AS INTEGER) AS ano, CAST(i % 12 + 1 AS INTEGER) AS mes FROM range(5, 75) t(i))
    SELECT w.ano, w.mes, CASE WHEN months.ano IS NULL THEN 'missing' WHEN w.ano = {LACKING_YEAR} THEN 'error'
        WHEN w.ano = 1997 THEN 'skipped' ELSE 'warning' END AS situacao,
      coalesce(c.n, 0) AS limpas, coalesce(q.n, 0) AS rejeitadas
    FROM w LEFT JOIN months USING (ano, mes) LEFT JOIN q USING (ano, mes) LEFT JOIN c USING (ano, mes)""",
)
def backfill_run(spark: SparkSession, sf: str) -> DataFrame:
    """Years with some months done before: what ran, and what each month then holds."""
    job = monthly_job(spark, sf)
    stages = ("landing", "clean")
    jobs.run(spark, job, stages, jobs.months_between((1997, 1), (1997, 12)))
    done = jobs.backfill(spark, job, (2003, 3), (1997, 6), stages=stages)

    def rows(layer: str, name: str) -> DataFrame:
        df = spark.read.parquet(job.path(layer))
        return df.groupBy("ano", "mes").agg(F.count(F.lit(1)).alias(name))

    out = done.join(rows("clean", "limpas"), ["ano", "mes"], "left").join(
        rows("quarantine", "rejeitadas"), ["ano", "mes"], "left"
    )
    return out.select(
        "ano", "mes", "situacao", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("limpas", "rejeitadas")]
    )


@query(
    "publish_set",
    f"""WITH {MOV}, t AS (
      SELECT ano, mes, 'tabela_uf' AS tabela, CAST(count(DISTINCT uf) AS BIGINT) AS linhas, {SUMS} FROM mov GROUP BY ano, mes
      UNION ALL SELECT ano, mes, 'tabela_resumo', 1, {SUMS} FROM mov GROUP BY ano, mes)
    SELECT 'em_vigor' AS conjunto, tabela, ano, mes, linhas,
      admissoes + CASE WHEN tabela = 'tabela_uf' THEN linhas ELSE 0 END AS admissoes, desligamentos, saldo FROM t
    UNION ALL SELECT 'anterior', tabela, ano, mes, linhas, admissoes, desligamentos, saldo FROM t""",
)
def publish_set(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables published together, one failed set, one corrected table, one roll-back."""
    root = scratch_path(spark, "published-set")
    flags = ["ano", "mes", "uf", "admissao", "desligamento", "saldomovimentacao"]
    df = movements(spark, sf, flags)
    by_state = stage(mv.movement_aggregate(df, ["ano", "mes", "uf"]), "by-state")
    total = by_state.groupBy("ano", "mes").agg(*[F.sum(m).alias(m) for m in mv.METRICS])
    tables = {"tabela_resumo": total, "tabela_uf": by_state}

    def sound(_name: str, written: DataFrame) -> list[str]:
        row = written.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("saldo") != F.col("admissoes") - F.col("desligamentos")).alias("net"),
        ).first()
        return [c for c, bad in (("empty", row["n"] == 0), ("net", row["net"] > 0)) if bad]

    manifest.publish_set(tables, root, lambda name, written: [])
    spoilt = by_state.withColumn("admissoes", F.col("admissoes") + 1)
    name, refused = manifest.publish_set({"tabela_resumo": total.limit(1), "tabela_uf": spoilt}, root, sound)
    if name is not None or refused != {"tabela_uf": ["net"]}:
        raise AssertionError(f"a bad set was published: {refused}")
    manifest.publish_set({"tabela_uf": spoilt}, root, lambda name, written: [])

    def summary(which: str) -> DataFrame:
        out = None
        for table, written in manifest.read_set(spark, root).items():
            one = written.groupBy("ano", "mes").agg(
                F.count(F.lit(1)).alias("linhas"), *[F.sum(m).alias(m) for m in mv.METRICS]
            ).select(F.lit(which).alias("conjunto"), F.lit(table).alias("tabela"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    now = summary("em_vigor")
    manifest.roll_back(spark, root)
    return now.unionByName(summary("anterior"))


FACT_KEY = (["ano", "mes"], "cod_municipio", ["uf", "municipio"])


@query(
    "load_summary",
    f"""WITH {MOV}, f AS (SELECT ano, mes, cod_municipio, uf FROM mov GROUP BY ALL),
    c AS (SELECT ano, mes, count(*) AS n, count(CASE WHEN uf = 'NATION_3' THEN 1 END) AS s FROM f GROUP BY ano, mes)
    SELECT 1 AS carga, ano, mes, n AS inserted, 0::BIGINT AS updated, 0::BIGINT AS unchanged, 0::BIGINT AS repeated, 0::BIGINT AS skipped FROM c WHERE ano <= 1999
    UNION ALL SELECT k, ano, mes, CASE WHEN ano >= 2000 THEN n - s ELSE 0 END, CASE WHEN ano = 1999 AND mes <= 6 THEN n - s ELSE 0 END,
      CASE WHEN ano = 1999 AND mes > 6 THEN n - s ELSE 0 END, 0, s FROM c, (VALUES (2), (3)) t(k) WHERE ano >= 1999
    UNION ALL SELECT 4, ano, mes, 0, 0, n - s, n - s, s FROM c WHERE ano >= 1999""",
)
def load_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Loads of facts with their accounts: new, corrected (first dry, then real), and repeated.

    Rows of one state lack their code from the second load on and are skipped.
    """
    path = scratch_path(spark, "loaded")
    columns = ["ano", "mes", "uf", "municipio", "cod_municipio"]
    flags = ["admissao", "desligamento", "saldomovimentacao"]
    facts = stage(mv.movement_aggregate(movements(spark, sf, [*columns, *flags]), columns), "facts")
    later = facts.filter("ano >= 1999").withColumns(
        {
            "admissoes": F.col("admissoes") + F.when((F.col("ano") == 1999) & (F.col("mes") <= 6), 1).otherwise(0),
            "cod_municipio": F.when(F.col("uf") != "NATION_3", F.col("cod_municipio")),
        }
    )

    def load(number: int, rows: DataFrame, dry_run: bool = False) -> DataFrame:
        told = lake.load(spark, path, rows, *FACT_KEY, required=["cod_municipio"], dry_run=dry_run)
        return told.withColumn("carga", F.lit(number))

    accounts = [
        load(1, facts.filter("ano <= 1999")),
        load(2, later, dry_run=True),
        load(3, later),
        load(4, later.unionByName(later).filter("cod_municipio IS NOT NULL").unionByName(
            later.filter("cod_municipio IS NULL")
        )),
    ]
    out = accounts[0]
    for more in accounts[1:]:
        out = out.unionByName(more)
    return out.filter("carga <> 1 OR ano <= 1999")
