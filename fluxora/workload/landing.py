"""Landing files of differing headers, and what is set aside of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.functions.text import header_name
from fluxora.plans.binding import movements
from fluxora.session import scratch_path, stage
from fluxora.sources import delimited, files, lake
from fluxora.workload.base import MOV, query

# Header of the files of a year by year modulo 4: in another order, with one more, with one less.
HEADERS = (
    ("competênciamov", "saldomovimentação", "horascontratuais", "Salário", "uf"),
    ("UF", "salário", "CompetênciaMov", "Horas Contratuais", "saldomovimentação"),
    ("competênciamov", "saldomovimentação", "observação", "horascontratuais", "salário", "uf"),
    ("salário", "horascontratuais", "saldomovimentação", "competênciamov"),
)
REFUSED_YEAR = 1995  # its files lack the wage
REQUIRED = ["competenciamov", "saldomovimentacao", "salario"]


def write_lines(df: DataFrame, header: str, path: str) -> None:
    """Each ``line`` as it is, below a header line, in monthly folders."""
    lines = df.select("ano", "mes", F.col("line").alias(header))
    lake.balanced(lines, ["ano", "mes"]).write.mode("append").options(
        header=True, sep="\x01", quote="", escape="\x02"
    ).partitionBy("ano", "mes").csv(path)


def uneven_landing(spark: SparkSession, sf: str) -> str:
    """All movements as landing files of four headers, with short and long lines among them."""
    root = scratch_path(spark, "uneven")
    rows = movements(
        spark, sf, ["ano", "mes", "data", "linha", "saldomovimentacao", "horascontratuais", "valorsalariofixo", "uf"]
    )
    value = {
        "competenciamov": F.date_format("data", "yyyyMM"),
        "saldomovimentacao": F.col("saldomovimentacao").cast("string"),
        "horascontratuais": F.col("horascontratuais").cast("long").cast("string"),
        "salario": F.round(F.col("valorsalariofixo") * 100).cast("long").cast("string"),
        "uf": F.col("uf"),
        # A quoted field with a separator and quotes of its own.
        "observacao": F.when(F.col("linha") == 1, F.lit('"nova; \\"2\\""')),
    }
    for rest, header in enumerate(HEADERS):
        own = rows.where((F.col("ano") % 4 == rest) & (F.col("ano") != REFUSED_YEAR))
        put_lines(own, header, value, root)
    put_lines(rows.where(F.col("ano") == REFUSED_YEAR), HEADERS[0][:3], value, root)
    return root


def put_lines(rows: DataFrame, header: tuple[str, ...], value: dict, root: str) -> None:
    """Lines of the header's columns; every seventh is short, every odd sixth long."""
    cells = [F.coalesce(value[header_name(c).replace("_", "")], F.lit("")) for c in header]
    whole = F.concat_ws(";", *cells)
    line = (
        F.when(F.col("linha") == 7, F.concat_ws(";", *cells[:-1]))
        .when((F.col("linha") == 6) & (F.col("horascontratuais") % 2 == 1), F.concat(whole, F.lit(";x")))
        .otherwise(whole)
    )
    months = rows.select("ano", lake.month_text(F.col("mes")).alias("mes"), line.alias("line"))
    write_lines(months, ";".join(header), root)


_BAD = "linha = 7 OR linha = 6 AND horascontratuais % 2 = 1"


@query(
    "scan_header_groups",
    f"""WITH {MOV} SELECT ano, mes, competencia[1:4] || competencia[6:7] AS competenciamov,
      CASE WHEN ano % 4 <> 3 THEN uf END AS uf, count(*) AS linhas,
      CAST(sum(saldomovimentacao) AS BIGINT) AS saldo, CAST(sum(horascontratuais) AS BIGINT) AS horas,
      CAST(sum(round(valorsalariofixo * 100)) AS BIGINT) AS centavos,
      count(CASE WHEN ano % 4 = 2 AND linha = 1 THEN 1 END) AS observadas
    FROM mov WHERE ano <> {REFUSED_YEAR} AND NOT ({_BAD}) GROUP BY ALL""",
)
def scan_header_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the clean rows, each value taken from the column of its name."""
    found = delimited.scan(spark, uneven_landing(spark, sf), REQUIRED)
    hours = F.coalesce("horascontratuais", "horas_contratuais").cast("long")
    return found.rows.groupBy("ano", "mes", "competenciamov", "uf").agg(
        F.count(F.lit(1)).alias("linhas"),
        F.sum(F.col("saldomovimentacao").cast("long")).alias("saldo"),
        F.sum(hours).alias("horas"),
        F.sum(F.col("salario").cast("long")).alias("centavos"),
        F.count_if(F.col("observacao") == 'nova; "2"').alias("observadas"),
    )


@query(
    "landing_quarantine",
    f"""WITH {MOV} SELECT ano, CASE WHEN linha = 7 THEN 'short' ELSE 'long' END AS motivo, count(*) AS n
    FROM mov WHERE ano <> {REFUSED_YEAR} AND ({_BAD}) GROUP BY ALL
    UNION ALL SELECT ano, 'missing:salario', count(DISTINCT mes) FROM mov WHERE ano = {REFUSED_YEAR} GROUP BY ano""",
)
def landing_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected lines by year and reason; of refused files the months."""
    found = delimited.scan(spark, uneven_landing(spark, sf), REQUIRED)
    year = files.path_value("ano", "arquivo").cast("int").alias("ano")
    lines = found.rejected.groupBy(year, "motivo").agg(F.count(F.lit(1)).alias("n"))
    refused = found.files.filter("recusa IS NOT NULL").groupBy(
        files.path_value("ano").cast("int").alias("ano"), F.col("recusa").alias("motivo")
    ).agg(F.count_distinct(files.path_value("mes")).alias("n"))
    return stage(lines, "rejected").unionByName(refused)
