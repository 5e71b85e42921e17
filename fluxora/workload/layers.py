"""Sources, sinks, upserts, catalogue, features and streams over the given tables.

Each query first writes a layer derived from whole tables to the shared folder and then
runs the operator on what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxora.functions.text import header_key
from fluxora.operators import clean
from fluxora.operators import movement as mv
from fluxora.operators import quality
from fluxora.plans import monthly
from fluxora.plans.binding import movements, scopes, suppliers, table
from fluxora.session import scratch_path, stage
from fluxora.sources import catalog as cat
from fluxora.sources import files, geo, lake
from fluxora.sources.delimited import parsed_headers
from fluxora.streaming import landing
from fluxora.workload.base import IN_PR, IN_RMC, MOV, PLACES, SUMS, query, r, rounded

FLAGS = ["admissao", "desligamento", "saldomovimentacao"]


@query(
    "scan_delimited",
    f"""SELECT c_custkey AS codigo, c_name AS nome_do_cliente, {r('c_acctbal', 'saldo')},
      'Região ' || c_nationkey::VARCHAR AS regiao FROM customer""",
)
def scan_delimited(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "delimited")
    source = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Código "),
        F.col("c_name").alias("Nome do Cliente"),
        F.col("c_acctbal").alias("SALDO"),
        F.concat(F.lit("Região "), F.col("c_nationkey").cast("string")).alias("região"),
    )
    lake.write_delimited(source, path)
    rows = lake.read_delimited(spark, path)
    return rounded(
        rows.select(
            F.col("codigo").cast("long").alias("codigo"),
            "nome_do_cliente",
            F.col("saldo").cast("double").alias("saldo"),
            "regiao",
        )
    )


LANDING_RENAMES = {
    "competenciamov": "competênciamov", "saldomovimentacao": "saldomovimentação",
    "salario": "salário", "valorsalariofixo": "valorsaláriofixo",
    "cbo2002ocupacao": "cbo2002ocupação", "secao": "seção",
}


def landing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole movement table as raw text columns with accented headers."""
    df = movements(
        spark, sf,
        ["ano", "mes", "data", "saldomovimentacao", "horascontratuais", "salario",
         "valorsalariofixo", "uf", "regiao", "secao", "sexo"],
    )

    def br(c: str):
        return F.translate(F.format_number(c, 2), ",.", ".,").alias(c)

    return df.select(
        "ano",
        lake.month_text(F.col("mes")).alias("mes"),
        F.date_format("data", "yyyyMM").alias("competenciamov"),
        F.col("saldomovimentacao").cast("string").alias("saldomovimentacao"),
        br("horascontratuais"),
        br("salario"),
        br("valorsalariofixo"),
        "uf", "regiao", "secao", "sexo",
    ).withColumnsRenamed(LANDING_RENAMES)


def write_landing(spark: SparkSession, sf: str, root: str) -> None:
    """Three landing zones: a good one, a Latin-1 one and one with a wrong separator."""
    rows = stage(landing_rows(spark, sf), "landing")
    good = rows.where("ano NOT IN (1997, 1998, 1999)")
    lake.write_delimited(good, f"{root}/utf8", ["ano", "mes"])
    latin = rows.where("ano = 1997")
    lake.write_delimited(latin, f"{root}/latin", ["ano", "mes"], encoding="ISO-8859-1")
    lake.write_delimited(rows.where("ano = 1998"), f"{root}/comma", ["ano", "mes"], sep=",")
    short = rows.where("ano = 1999").drop("valorsaláriofixo")
    lake.write_delimited(short, f"{root}/short", ["ano", "mes"])


def landing_probe(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "landing")
    write_landing(spark, sf, root)
    return files.probe(files.listing(spark, root, "*.csv"))


_HEADER = "competenciamov,saldomovimentacao,horascontratuais,salario,{}uf,regiao,secao,sexo"
_BY_MONTH = """SELECT CAST(year(l_shipdate) AS INTEGER) AS ano, CAST(month(l_shipdate) AS INTEGER) AS mes FROM lineitem GROUP BY ALL"""


@query(
    "landing_headers",
    f"""SELECT ano, mes, CASE WHEN ano = 1997 THEN 'latin-1' ELSE 'utf-8' END AS codificacao, ano <> 1998 AS separador_ok,
      CASE WHEN ano = 1998 THEN '' WHEN ano = 1999 THEN '{_HEADER.format("")}' ELSE '{_HEADER.format("valorsalariofixo,")}' END AS colunas
    FROM ({_BY_MONTH})""",
)
def landing_headers(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parsed_headers(landing_probe(spark, sf))
    year = files.path_value("ano").cast("int").alias("ano")
    month = files.path_value("mes").cast("int").alias("mes")
    # A month may lie in several files; they share one header.
    return parsed.select(
        year, month, "codificacao", "separador_ok",
        F.array_join("colunas", ",").alias("colunas"),
    ).distinct()


_RAW_HEADERS = (
    "competênciamov", "saldomovimentação", "horascontratuais", "salário", "valorsaláriofixo",
    "uf", "regiao", "seção", "sexo",
)


@query(
    "normalize_header",
    f"""SELECT bruto, strip_accents(bruto) AS normalizado, count(*) AS meses
    FROM ({_BY_MONTH}), (SELECT unnest({list(_RAW_HEADERS)}) AS bruto)
    WHERE ano <> 1998 AND (ano <> 1999 OR bruto <> 'valorsaláriofixo') GROUP BY bruto""",
)
def normalize_header(spark: SparkSession, sf: str) -> DataFrame:
    """Raw header texts of the landing files, their normalised names and their months."""
    probed = landing_probe(spark, sf).where(F.col("cabecalho").contains(";"))
    raw = probed.select(
        F.explode(F.split("cabecalho", ";")).alias("bruto"),
        F.concat(files.path_value("ano"), files.path_value("mes")).alias("periodo"),
    )
    counted = raw.groupBy("bruto").agg(F.count_distinct("periodo").alias("meses"))
    return counted.withColumn("normalizado", header_key(F.col("bruto")))


@query(
    "validate_landing",
    f"""SELECT ano, mes, CASE WHEN ano = 1998 THEN 'missing_required,separator' WHEN ano = 1999 THEN 'missing_required'
      WHEN ano = 1997 THEN 'encoding' ELSE '' END AS codigos,
      CASE WHEN ano IN (1998, 1999) THEN 'error' WHEN ano = 1997 THEN 'warning' ELSE 'ok' END AS status FROM ({_BY_MONTH})""",
)
def validate_landing(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.validate_landing(parsed_headers(landing_probe(spark, sf)), min_bytes=1)
    return found.select("ano", "mes", "codigos", "status")


@query("file_digests", "SELECT DISTINCT o_orderstatus, TRUE AS iguais FROM orders")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of every written file, by the chunked reader and by Spark's own hash."""
    path = scratch_path(spark, "digests")
    lake.write_table(table(spark, sf, "orders"), path, ["o_orderstatus"])
    chunked = files.digests(files.listing(spark, path, "*.parquet"))
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet"
    ).load(path).select("path", F.sha2("content", 256).alias("outra"))
    both = chunked.join(whole, "path", "full_outer")
    return both.groupBy(files.path_value("o_orderstatus").alias("o_orderstatus")).agg(
        F.min(F.col("sha256").eqNullSafe(F.col("outra"))).alias("iguais")
    )


@query("table_fingerprint")
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("lineitem", "orders", "customer", "supplier", "part"):
        one = files.table_fingerprint(table(spark, sf, name)).select(
            F.lit(name).alias("tabela"), "linhas", "impressao"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "scan_partition",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem
    WHERE year(l_shipdate) = 1998 AND month(l_shipdate) = 4""",
)
def scan_partition(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "partitioned")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        F.year("l_shipdate").alias("ano"),
        lake.month_text(F.month("l_shipdate")).alias("mes"),
    )
    lake.write_table(lines, path, ["ano", "mes"])
    return lake.read_partition(spark, path, 1998, 4).drop("ano", "mes")


def _orders_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("maior")
    )


@query(
    "sink_roundtrip",
    f"""SELECT f AS formato, o_orderpriority, o_orderstatus, count(*) AS n, {r('max(o_totalprice)', 'maior')}
    FROM orders, (VALUES ('csv'), ('parquet')) t(f) GROUP BY ALL""",
)
def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "sink")
    df = _orders_by_status(spark, sf)
    lake.write_both(df, root, "pedidos", ["o_orderstatus"])
    # Writing again replaces the same partitions.
    lake.write_both(df, root, "pedidos", ["o_orderstatus"])
    columns = ["o_orderpriority", "o_orderstatus", "n", "maior"]
    parquet = spark.read.parquet(f"{root}/parquet/pedidos").select(*columns)
    csv = spark.read.schema(
        "o_orderpriority string, n long, maior double, o_orderstatus string"
    ).option("header", True).csv(f"{root}/csv/pedidos")
    both = parquet.withColumn("formato", F.lit("parquet")).unionByName(
        csv.select(*columns).withColumn("formato", F.lit("csv"))
    )
    return rounded(both)


@query(
    "read_with_fallback",
    f"""SELECT 'completa' AS tabela, 'parquet' AS _source, o_orderpriority, n, maior FROM t
    UNION ALL SELECT 'so_csv', 'csv', o_orderpriority, n, maior FROM t
    UNION ALL SELECT 'corrompida', 'csv', o_orderpriority, n, maior FROM t""".replace(
        "FROM t", "FROM (SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS maior FROM orders GROUP BY 1)"
    ),
)
def read_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "fallback")
    df = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("maior")
    )
    df = stage(df, "fallback")
    lake.write_both(df, root, "completa")
    lake.write_delimited(df, f"{root}/csv/so_csv", sep=",")
    lake.write_both(df, root, "corrompida")
    # Text under a Parquet name: the footer cannot be read.
    bad = f"{root}/parquet/corrompida"
    df.limit(0).select(F.lit("x").alias("v")).write.mode("overwrite").text(bad)
    fs, target = files._fs(spark, f"{bad}/part-0.snappy.parquet")
    stream = fs.create(target, True)
    stream.write(bytearray(b"not a parquet file"))
    stream.close()
    out = None
    for name in ("completa", "so_csv", "corrompida"):
        one = lake.read_with_fallback(spark, root, name, df.schema).withColumn(
            "tabela", F.lit(name)
        )
        out = one if out is None else out.unionByName(one)
    return out.select("tabela", "_source", "o_orderpriority", "n", "maior")


@query(
    "staged_publish",
    """SELECT o_orderpriority, count(*) AS n, CAST('1 problem' AS VARCHAR) AS recusada FROM orders GROUP BY 1""",
)
def staged_publish(spark: SparkSession, sf: str) -> DataFrame:
    """A good version is published, a bad one refused: readers keep the good one."""
    root = scratch_path(spark, "published")
    good = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))

    def problems(written: DataFrame) -> list[str]:
        row = written.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("o_orderpriority").isNull()).alias("null_keys"),
        ).first()
        found = ["empty"] if row["rows"] == 0 else []
        return found + (["null keys"] if row["null_keys"] else [])

    files.publish(good, root, problems)
    spoiled = good.withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    )
    _, refused = files.publish(spoiled, root, problems)
    note = f"{len(refused)} problem"
    return files.read_current(spark, root).withColumn("recusada", F.lit(note))


FACT_COLUMNS = ["ano", "mes", "uf", "municipio", "cod_municipio", *mv.METRICS]


def facts(spark: SparkSession, sf: str) -> DataFrame:
    dims = FACT_COLUMNS[:5]
    df = mv.movement_aggregate(movements(spark, sf, [*dims, *FLAGS]), dims)
    return df.withColumn("mes", lake.month_text(F.col("mes"))).select(*FACT_COLUMNS)


@query(
    "upsert_facts",
    f"""WITH {MOV} SELECT ano, mes, uf, CASE WHEN ano >= 2000 AND uf = 'NATION_3' THEN upper(municipio) ELSE municipio END AS municipio,
      cod_municipio, CAST(sum(admissao) + CASE WHEN ano >= 2000 THEN 1 ELSE 0 END AS BIGINT) AS admissoes,
      CAST(sum(desligamento) AS BIGINT) AS desligamentos, CAST(sum(saldomovimentacao) AS BIGINT) AS saldo
    FROM mov GROUP BY ano, mes, uf, municipio, cod_municipio""",
)
def upsert_facts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "facts")
    base = stage(facts(spark, sf), "facts")
    key = ["ano", "mes"], "cod_municipio", ["uf", "municipio"]
    lake.upsert(spark, path, base.where("ano <= 2000"), *key)
    # Later deliveries correct 2000 (one state renamed, found by code) and add 2001.
    changed = base.where("ano >= 2000").withColumns(
        {
            "admissoes": F.col("admissoes") + 1,
            "municipio": F.when(F.col("uf") == "NATION_3", F.upper("municipio")).otherwise(
                F.col("municipio")
            ),
        }
    )
    lake.upsert(spark, path, changed, *key)
    lake.upsert(spark, path, changed, *key)
    return spark.read.parquet(path).select(*FACT_COLUMNS)


@query(
    "prepare_month",
    f"""WITH {MOV} SELECT '199703' AS competenciamov, saldomovimentacao::VARCHAR AS saldomovimentacao, graudeinstrucao,
      horascontratuais, CASE WHEN idade <= 17 THEN 17 WHEN idade <= 24 THEN 21 WHEN idade <= 29 THEN 29 WHEN idade <= 39 THEN 39
        WHEN idade <= 49 THEN 49 WHEN idade <= 64 THEN 59 ELSE 65 END::DOUBLE AS idade, {r('salario', 'salario')}
    FROM mov WHERE ano = 1997 AND mes = 3""",
)
def prepare_month(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prepared")
    month = migrant_rows(spark, sf)
    month = month.where(clean.period_equals(F.col("competenciamov"), 1997, 3))
    prepared = as_landing(month).withColumn("competenciamov", F.lit("199703"))
    lake.write_delimited(prepared, path)
    rows = lake.read_delimited(spark, path)
    numbers = {c: F.col(c).cast("double") for c in ("horascontratuais", "idade", "salario")}
    return rounded(rows.withColumns(numbers))


def migrant_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All movements under the names and with the bands of the other source."""
    age = F.col("idade")
    band = F.when(age <= 17, "1").when(age <= 24, "02").when(age <= 29, "3.0")
    band = band.when(age <= 39, "4").when(age <= 49, "05").when(age <= 64, "6").otherwise("07")
    return movements(
        spark, sf,
        ["data", "saldomovimentacao", "graudeinstrucao", "horascontratuais", "idade", "salario"],
    ).select(
        F.concat(F.date_format("data", "yyyyMM"), F.lit(".0")).alias("competenciamov"),
        "saldomovimentacao",
        F.col("graudeinstrucao").alias("nivel_instrucao"),
        F.col("horascontratuais").alias("faixa_horas_contrat"),
        band.alias("faixa_etaria"),
        "salario",
    )


def as_landing(rows: DataFrame) -> DataFrame:
    """Columns as the landing files name them, the age from its band."""
    return clean.age_from_band(clean.rename_source(rows), "faixa_etaria").drop("faixa_etaria")


_PREPARED = "competenciamov,saldomovimentacao,graudeinstrucao,horascontratuais,salario,idade"


@query(
    "prepare_all_months",
    f"""WITH {MOV} SELECT ano, mes, count(*) AS filtradas, CASE WHEN simulado THEN 0 ELSE count(*) END AS gravadas,
      '{_PREPARED}' AS colunas, simulado, FALSE AS ja_gravado FROM mov, (VALUES (TRUE), (FALSE)) t(simulado) GROUP BY ano, mes, simulado""",
)
def prepare_all_months(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of a dry run, which writes nothing, and of the real writing of every month."""
    path = scratch_path(spark, "prepared-months")
    rows = migrant_rows(spark, sf)
    dry = lake.prepare_months(rows, path, "competenciamov", as_landing, dry_run=True)
    there = files.exists(spark, path)
    real = lake.prepare_months(rows, path, "competenciamov", as_landing)
    return dry.unionByName(real).withColumn("ja_gravado", F.lit(there))


@query(
    "prepare_month_dry_run",
    f"WITH {MOV} SELECT ano, mes, count(*) AS linhas, count(salario) AS com_salario FROM mov GROUP BY ano, mes",
)
def prepare_month_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What every month would hold, without writing anything."""
    df = movements(spark, sf, ["ano", "mes", "salario"])
    return df.groupBy("ano", "mes").agg(
        F.count(F.lit(1)).alias("linhas"), F.count("salario").alias("com_salario")
    )


@query(
    "backfill_plan",
    """WITH src AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(month(o_orderdate) AS INTEGER) AS mes FROM orders),
    done AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS ano, CAST(month(l_shipdate) AS INTEGER) AS mes FROM lineitem
      WHERE month(l_shipdate) <= 6),
    w AS (SELECT CAST(1995 + i // 12 AS INTEGER) AS ano, CAST(i % 12 + 1 AS INTEGER) AS mes FROM range(6, 96) t(i))
    SELECT w.ano, w.mes, CASE WHEN src.ano IS NULL THEN 'missing' WHEN done.ano IS NOT NULL THEN 'skipped' ELSE 'run' END AS acao
    FROM w LEFT JOIN src USING (ano, mes) LEFT JOIN done USING (ano, mes)""",
)
def backfill_plan(spark: SparkSession, sf: str) -> DataFrame:
    def months(name: str, column: str) -> DataFrame:
        return table(spark, sf, name).select(
            F.year(column).alias("ano"), F.month(column).alias("mes")
        ).distinct()

    done = months("lineitem", "l_shipdate").where("mes <= 6")
    return lake.backfill_plan(months("orders", "o_orderdate"), done, (2002, 12), (1995, 7))


CATALOG_SPECS = [
    s for s in mv.TABLES
    if s.name in ("tabela_resumo", "tabela_uf", "tabela_setor", "tabela_perfil_sexo")
] + [mv.TableSpec("tabela_perfil", ("sexo", "graudeinstrucao"), scopes=("br",))]
CURRENT = [s.full_name(x) for s in mv.TABLES for x in s.scopes]


def small_lake(spark: SparkSession, sf: str) -> str:
    """A published lake by year: one legacy table, one year without delimited copies."""
    root = scratch_path(spark, "lake")
    dims = mv.matrix_dims(CATALOG_SPECS)
    df = movements(spark, sf, list(dict.fromkeys([*dims, "ano", "uf", "regiao", *FLAGS])))
    matrix = mv.table_matrix(df, scopes(), CATALOG_SPECS, ["ano"])
    matrix = stage(matrix.select("tabela", "ano", *dims, *mv.METRICS), "matrix")
    lake.write_table(matrix, f"{root}/parquet", ["tabela", "ano"])
    lake.write_delimited(matrix.where("ano <> 1999"), f"{root}/csv", ["tabela", "ano"], sep=",")
    return root


_SMALL = f"""WITH {MOV}, t AS (
    SELECT 'tabela_resumo' AS tabela, ano, 1 AS k FROM mov GROUP BY ano
    UNION ALL SELECT 'tabela_uf', ano, 1 FROM mov GROUP BY ano, uf
    UNION ALL SELECT 'tabela_perfil', ano, 1 FROM mov GROUP BY ano, sexo, graudeinstrucao
    {" ".join(f"UNION ALL SELECT 'tabela_{n}{suffix}', ano, 1 FROM mov WHERE {w} GROUP BY ano, {c}"
              for n, c in (("setor", "secao"), ("perfil_sexo", "sexo"))
              for suffix, w in (("", "TRUE"), ("_pr", IN_PR), ("_rmc", IN_RMC)))}),
  c AS (SELECT tabela, ano, count(*) AS row_count, ano <> 1999 AS has_csv, tabela = 'tabela_perfil' AS is_legacy,
      CASE WHEN tabela LIKE '%_rmc' THEN 'rmc' WHEN tabela LIKE '%_pr' THEN 'parana' ELSE 'brasil' END AS scope
    FROM t GROUP BY tabela, ano)"""


@query(
    "catalog",
    f"""{_SMALL} SELECT tabela, ano, scope, CASE WHEN tabela LIKE '%setor%' THEN 'setor' WHEN tabela LIKE '%sexo%' THEN 'perfil_sexo'
      ELSE replace(tabela, 'tabela_', '') END AS granularity, has_csv, TRUE AS has_parquet, row_count, NOT is_legacy AS is_current, is_legacy,
      concat_ws(';', CASE WHEN is_legacy THEN 'not_current;legacy' END, CASE WHEN NOT has_csv THEN 'parquet_only' END) AS notes,
      'admissoes,desligamentos,' || CASE WHEN tabela = 'tabela_perfil' THEN 'graudeinstrucao,saldo,sexo' WHEN tabela LIKE '%setor%' THEN 'saldo,secao'
        WHEN tabela LIKE '%sexo%' THEN 'saldo,sexo' WHEN tabela = 'tabela_uf' THEN 'saldo,uf' ELSE 'saldo' END AS columns,
      CAST(CASE WHEN tabela = 'tabela_perfil' THEN 5 WHEN tabela = 'tabela_resumo' THEN 3 ELSE 4 END AS INTEGER) AS column_count,
      TRUE AS tem_bytes, TRUE AS tem_hora FROM c""",
)
def catalog(spark: SparkSession, sf: str) -> DataFrame:
    found = cat.catalog(spark, small_lake(spark, sf), CURRENT, ["ano"])
    told = found.withColumns(
        {
            "columns": F.array_join("columns", ","),
            "tem_bytes": F.col("bytes") > 100,
            # Written just now, by this query.
            "tem_hora": F.col("modificado") > F.current_timestamp() - F.expr("INTERVAL 1 DAY"),
        }
    )
    return told.drop("bytes", "modificado")


@query(
    "catalog_filter",
    f"{_SMALL} SELECT tabela, ano, row_count FROM c WHERE scope = 'parana' AND tabela LIKE '%setor%' AND ano = 1998",
)
def catalog_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = cat.catalog(spark, small_lake(spark, sf), CURRENT, ["ano"])
    kept = cat.filter_catalog(found, year=1998, scope="pr", granularity="setor", legacy=False)
    return kept.select("tabela", "ano", "row_count")


@query(
    "catalog_partitions",
    f"""{_SMALL}, n AS (SELECT string_agg(DISTINCT tabela, ',' ORDER BY tabela) AS todas FROM c)
    SELECT ano, count(*) AS tabelas, CAST(sum(row_count) AS BIGINT) AS linhas, '' AS csv_sem_parquet,
      CASE WHEN ano = 1999 THEN (SELECT todas FROM n) ELSE '' END AS parquet_sem_csv, 'tabela_perfil' AS suspeitas, '' AS faltando
    FROM c GROUP BY ano""",
)
def catalog_partitions(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(cat.catalog(spark, small_lake(spark, sf), CURRENT, ["ano"]), "catalog")
    return cat.partition_summary(found, ["ano"])


@query(
    "catalog_rollup",
    f"""{_SMALL} SELECT tabela, string_agg(ano::VARCHAR, ',' ORDER BY ano) AS periodos, CAST(sum(row_count) AS BIGINT) AS linhas,
      bool_or(is_legacy) AS is_legacy FROM c GROUP BY tabela""",
)
def catalog_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return cat.rollup(cat.catalog(spark, small_lake(spark, sf), CURRENT, ["ano"]), ["ano"])


@query(
    "available_tables",
    f"{_SMALL} SELECT DISTINCT regexp_replace(tabela, '_(pr|rmc)$', '') AS tabela FROM c",
)
def available_tables(spark: SparkSession, sf: str) -> DataFrame:
    return cat.available_tables(cat.catalog(spark, small_lake(spark, sf), CURRENT, ["ano"]))


REQUIRED_TABLES = ["tabela_resumo", "tabela_uf", "tabela_municipio"]


@query(
    "catalog_issues",
    f"""{_SMALL} SELECT ano, tabela, CASE WHEN NOT has_csv THEN 'format_mismatch' ELSE 'legacy' END AS problema,
      CASE WHEN tabela IN ('tabela_resumo', 'tabela_uf') THEN 'critical' ELSE 'warning' END AS nivel
    FROM c WHERE NOT has_csv OR is_legacy
    UNION ALL SELECT DISTINCT ano, 'tabela_municipio', 'missing', 'critical' FROM c""",
)
def catalog_issues(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(cat.catalog(spark, small_lake(spark, sf), CURRENT, ["ano"]), "catalog")
    return cat.catalog_issues(found, REQUIRED_TABLES, ["ano"])


@query(
    "readiness",
    f"""{_SMALL} SELECT count(DISTINCT ano) AS n_competencias, TRUE AS competencias_available, TRUE AS default_available,
      FALSE AS no_critical_issue, TRUE AS gold_status_ok, 'not_ready' AS status, 'no_critical_issue' AS problemas FROM c""",
)
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    root = small_lake(spark, sf)
    found = stage(cat.catalog(spark, root, CURRENT, ["ano"]), "catalog")
    issues = stage(cat.catalog_issues(found, REQUIRED_TABLES, ["ano"]), "issues")
    matrix = spark.read.parquet(f"{root}/parquet").where("ano = 1998")
    totals = quality.table_totals(matrix)
    clean_sums = mv.movement_total(movements(spark, sf, ["ano", *FLAGS]).where("ano = 1998"))
    gold = quality.validate_gold(totals, clean_sums, ["tabela_resumo", "tabela_uf"])
    return cat.readiness(found, issues, {"ano": 1998}, gold)


PROPERTIES = {"municipio": "string", "cod_municipio": "string", "uf": "string"}


def write_features(spark: SparkSession, sf: str) -> str:
    """Supplier squares and pairs of squares as one GeoJSON feature per line."""
    path = scratch_path(spark, "features")
    lon, lat = F.col("saldo_conta") / 100.0, F.col("cod_municipio").cast("int") % 90

    def square(dx: float):
        corners = ((0, 0), (1, 0), (1, 2), (0, 2), (0, 0))
        return F.array(F.array(*[F.array(lon + dx + x, (lat + y).cast("double")) for x, y in corners]))

    def feature(kind: str, coordinates):
        return F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct("municipio", "cod_municipio", "uf").alias("properties"),
                F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            )
        )

    double = F.col("regiao") == "ASIA"
    line = F.when(double, feature("MultiPolygon", F.array(square(0), square(5)))).otherwise(
        feature("Polygon", square(0))
    )
    suppliers(spark, sf).select(line.alias("value")).write.text(path)
    return path


def supplier_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return geo.bounds(geo.read_lines(spark, write_features(spark, sf), PROPERTIES))


@query("geojson_features", f"WITH {PLACES} SELECT municipio, cod_municipio, uf FROM places")
def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    return geo.read_lines(spark, write_features(spark, sf), PROPERTIES).drop("geometry")


_BOXES = f"""WITH {PLACES}, b AS (SELECT cod_municipio, regiao, saldo_conta / 100.0 AS min_lon,
      CAST(cod_municipio::INTEGER % 90 AS DOUBLE) AS min_lat, saldo_conta / 100.0 + CASE WHEN regiao = 'ASIA' THEN 6 ELSE 1 END AS max_lon,
      CAST(cod_municipio::INTEGER % 90 + 2 AS DOUBLE) AS max_lat FROM places)"""


@query(
    "feature_bounds",
    f"""{_BOXES} SELECT cod_municipio, {", ".join(r(c, c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))} FROM b""",
)
def feature_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(supplier_boxes(spark, sf).drop("municipio", "uf"))


@query(
    "bbox_filter",
    f"{_BOXES} SELECT cod_municipio FROM b WHERE regiao = 'EUROPE' AND min_lon <= 60 AND max_lon >= 20 AND min_lat <= 70 AND max_lat >= 5",
)
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    members = suppliers(spark, sf).where("regiao = 'EUROPE'")
    found = geo.layer(supplier_boxes(spark, sf), members, "cod_municipio", (20, 5, 60, 70))
    return found.select("cod_municipio")


@query(
    "feature_extent",
    f"""{_BOXES} SELECT {r('min(min_lon)', 'min_lon')}, {r('min(min_lat)', 'min_lat')}, {r('max(max_lon)', 'max_lon')},
      {r('max(max_lat)', 'max_lat')} FROM b""",
)
def feature_extent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geo.extent(supplier_boxes(spark, sf)))


@query(
    "feature_properties",
    f"""WITH {PLACES} SELECT cod_municipio, municipio, upper(municipio) AS municipio_norm, uf, upper(uf) AS uf_norm,
      regiao = 'EUROPE' AS na_lista FROM places""",
)
def feature_properties(spark: SparkSession, sf: str) -> DataFrame:
    features = geo.read_lines(spark, write_features(spark, sf), PROPERTIES)
    allowed = suppliers(spark, sf).where("regiao = 'EUROPE'").select(
        F.upper("municipio").alias("municipio_norm")
    )
    return geo.standard_properties(features, "municipio", "cod_municipio", "uf", allowed)


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    return landing.landing_files(spark, sf, EVENT_SCHEMA, "events.parquet")


@query(
    "landing_stream",
    f"SELECT strftime(ts, '%Y-%m-%d') AS dia, event_type, count(*) AS n, {r('max(value)', 'maior')} FROM events GROUP BY ALL",
)
def landing_stream(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "landed")
    # The same file is delivered twice, as after a lost checkpoint.
    for _ in range(2):
        stream = _events_stream(spark, sf).withColumn("dia", F.date_format("ts", "yyyy-MM-dd"))
        landing.land(
            stream, target, scratch_path(spark, "stream-state"), ["dia"], "event_id",
            lambda: [F.col("ts")],
        )
    rows = spark.read.parquet(target)
    return rounded(
        rows.groupBy(F.col("dia").cast("string").alias("dia"), "event_type").agg(
            F.count(F.lit(1)).alias("n"), F.max("value").alias("maior")
        )
    )


@query("stream_event_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "stream-counts")
    landing.count_available(
        _events_stream(spark, sf), ["event_type", "user_id"], F.count(F.lit(1)),
        target, scratch_path(spark, "stream-state"),
    )
    return landing.read_counts(spark, target, ["event_type", "user_id"])


RUN_SPECS = [s for s in mv.TABLES if s.name in ("tabela_resumo", "tabela_uf", "tabela_perfil_sexo")]


@query(
    "monthly_run",
    f"""WITH {MOV} SELECT 'tabela_uf' AS tabela, ano, mes, CAST(count(DISTINCT uf) AS BIGINT) AS linhas, {SUMS} FROM mov GROUP BY ano, mes
    UNION ALL SELECT 'tabela_resumo', ano, mes, 1, {SUMS} FROM mov GROUP BY ano, mes
    {" ".join(f"UNION ALL SELECT 'tabela_perfil_sexo{s}', ano, mes, CAST(count(DISTINCT sexo) AS BIGINT), {SUMS} FROM mov WHERE {w} GROUP BY ano, mes"
              for s, w in (("", "TRUE"), ("_pr", IN_PR), ("_rmc", IN_RMC)))}""",
)
def monthly_run(spark: SparkSession, sf: str) -> DataFrame:
    """Landing files to the table matrix for every month of the whole table."""
    root = scratch_path(spark, "run")
    rows = landing_rows(spark, sf).withColumn("idade", F.lit("30"))
    lake.write_delimited(rows, f"{root}/landing", ["ano", "mes"])
    dictionary = spark.createDataFrame(
        [("sexo", "F", "Fechado"), ("sexo", "O", "Aberto")],
        "domain string, code string, label string",
    )
    checked = monthly.clean_stage(
        spark, f"{root}/landing", f"{root}/clean", dictionary, {"sexo": "sexo"},
        sidecar=f"{root}/validation",
    )
    matrix = monthly.aggregate_stage(
        spark, f"{root}/clean", f"{root}/gold", checked, scopes(), RUN_SPECS
    )
    return matrix.groupBy("tabela", "ano", "mes").agg(
        F.count(F.lit(1)).alias("linhas"), *[F.sum(m).alias(m) for m in mv.METRICS]
    )
