"""The monthly run loses no row and reports periods that do not match their folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fluxora.functions.numbers import finite, parse_number_br, parse_number_plain
from fluxora.operators import index_frozen as fi
from fluxora.operators import quality
from fluxora.plans import binding, monthly
from fluxora.sources import lake

COLUMNS = [
    "ano", "mes", "competênciamov", "saldomovimentação", "horascontratuais", "salário",
    "valorsaláriofixo", "uf", "regiao", "seção", "sexo", "idade",
]


def landing(rows, spark):
    fixed = ("1", "44,00", "2000,00", "2000,00", "PR", "SUL", "M", "F", "30")
    return spark.createDataFrame(
        [(year, month, period, *fixed) for year, month, period in rows],
        ", ".join(f"`{c}` string" for c in COLUMNS),
    )


def test_folder_period_wins(spark, tmp_path):
    rows = [("2026", "04", p) for p in ("202603", "2026-04", "202604")] + [("2026", "03", "202603")]
    lake.write_delimited(landing(rows, spark), f"{tmp_path}/landing", ["ano", "mes"])
    dictionary = spark.createDataFrame([("sexo", "F", "x")], "domain string, code string, label string")
    checked = monthly.clean_stage(
        spark, f"{tmp_path}/landing", f"{tmp_path}/clean", dictionary, {"sexo": "sexo"}
    )
    clean = spark.read.parquet(f"{tmp_path}/clean")
    assert {(r.ano, r.mes, r["count"]) for r in clean.groupBy("ano", "mes").count().collect()} == {
        (2026, 4, 3), (2026, 3, 1),
    }
    assert {r.competencia_str for r in clean.filter("mes = 4").collect()} == {"2026-04"}
    wrong = {(r.ano, r.mes): r.periodo_divergente for r in checked.collect()}
    assert wrong == {(2026, 4): 2, (2026, 3): 0}


def test_missing_columns_are_reported_not_thrown(spark):
    df = spark.createDataFrame([(2026, 4, 1)], "ano int, mes int, saldomovimentacao int")
    row = quality.validate_clean(df, ("ano", "mes"), F.lit("202604")).first()
    assert row["linhas"] == 1


def test_blanks_and_type_letters(values):
    assert values(parse_number_br, ["R$ 1.234,56", " 44,00 "]) == [1234.56, 44.0]
    assert values(finite, ["12d", "3f", " 1e3 ", "NaN"]) == [None, None, 1000.0, None]
    assert values(parse_number_plain, [" 2.5"]) == [2.5]


def test_year_without_floor_fails(spark):
    df = spark.createDataFrame(
        [(2099, 1, 2000.0, "Não")], "ano int, admissao int, salario double, indtrabintermitente string"
    )
    with pytest.raises(Exception, match="no wage floor for year 2099"):
        fi.eligible_wages(df, binding.star_spec()).collect()


def test_fallback_only_for_unreadable_files(spark, tmp_path, monkeypatch):
    def broken(*_args, **_kwargs):
        raise RuntimeError(f"connection reset while reading {tmp_path}/parquet/t")

    monkeypatch.setattr(type(spark.read), "parquet", broken)
    from pyspark.sql.types import StructType

    with pytest.raises(RuntimeError, match="connection reset"):
        lake.read_with_fallback(spark, str(tmp_path), "t", StructType())


def test_number_format_is_decided_per_month(spark, tmp_path):
    base = landing([("2026", "01", "202601"), ("2026", "02", "202602")], spark)
    wage = F.when(F.col("mes") == "01", "2530.98").otherwise("2.530,98")
    lake.write_delimited(
        base.withColumn("salário", wage), f"{tmp_path}/landing", ["ano", "mes"]
    )
    dictionary = spark.createDataFrame([("sexo", "F", "x")], "domain string, code string, label string")
    monthly.clean_stage(
        spark, f"{tmp_path}/landing", f"{tmp_path}/clean", dictionary, {"sexo": "sexo"}
    )
    clean = spark.read.parquet(f"{tmp_path}/clean")
    assert {(r.mes, r.salario, r.horascontratuais) for r in clean.collect()} == {
        (1, 2530.98, 44.0), (2, 2530.98, 44.0),
    }
