from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluxora.functions import labels, numbers, scoring, text


def test_strip_accents_and_keys(values):
    raw = ["São José dos Pinhais", "  Maringá ", "coração", "1ª e 2º", "é", None, ""]
    assert values(text.strip_accents, raw) == [
        "Sao Jose dos Pinhais", "  Maringa ", "coracao", "1a e 2o", "e", None, "",
    ]
    assert values(text.strip_accents_any_script, raw) == values(text.strip_accents, raw)
    assert values(text.upper_key, raw[:2]) == ["SAO JOSE DOS PINHAIS", "MARINGA"]


def test_join_key_punctuation_and_missing(values):
    raw = ["D'Oeste-Sul / Norte", " nan ", "", "...", None, "A_B|C;D"]
    assert values(text.join_key, raw) == ["D'OESTE SUL NORTE", None, None, None, None, "A B C D"]


def test_clean_text_keeps_null(values):
    assert values(text.clean_text, ["  a \t b\n", None, "x  y"]) == ["a b", None, "x y"]


def test_format_code(values):
    raw = ["410690", "4106902", "41.0", "12345678", " nan ", "<NA>", "", None, "AB"]
    assert values(text.format_code, raw) == [
        "0410690", "4106902", "0000041", "12345678", None, None, None, None, "AB",
    ]


def test_header_names(values):
    raw = ["CompetênciaMov", "  Salário  ", "Grau de Instrução"]
    expected = ["competenciamov", "salario", "grau_de_instrucao"]
    assert [text.header_name(h) for h in raw] == expected
    assert values(text.header_key, raw) == expected


def test_parse_number_br(values):
    raw = ["1.234,56", "44,00", "R$ 100,50", "", "-", "NA", None, "abc", "-3,5", "2530.98"]
    assert values(numbers.parse_number_br, raw) == [
        1234.56, 44.0, 100.5, None, None, None, None, None, -3.5, 253098.0,
    ]


def test_number_rule_is_chosen_per_column(spark):
    rows = [("2530.98", "2530.98"), ("10", "1,5"), ("-", None)]
    df = spark.createDataFrame(rows, "plain string, mixed string")
    out = numbers.to_numbers(df, ["plain", "mixed", "absent"]).collect()
    assert [r["plain"] for r in out] == [2530.98, 10.0, None]
    assert [r["mixed"] for r in out] == [253098.0, 1.5, None]
    forced = numbers.to_numbers(df, ["mixed"], "plain").collect()
    assert [r["mixed"] for r in forced] == [2530.98, None, None]
    with pytest.raises(ValueError):
        numbers.to_numbers(df, ["mixed"], "other")


def test_finite(values):
    assert values(numbers.finite, [None, "", "18.7", "NaN", "Infinity", "x"]) == [
        None, None, 18.7, None, None, None,
    ]


def test_br_formats(values):
    raw = [1234567.891, -12.3, None, float("nan"), 0.0]
    assert values(lambda c: numbers.format_br(c, 1), raw, "double") == [
        "1.234.567,9", "-12,3", "--", "--", "0,0",
    ]
    assert values(numbers.format_currency_br, raw[:3], "double") == [
        "R$ 1.234.567,89", "R$ -12,30", "--",
    ]
    assert values(numbers.format_ordinal, [3.0, None], "double") == ["3º", "--"]


def test_age_band_edges(values):
    ages = [17.0, 18.0, 24.0, 25.0, 39.0, 49.0, 64.0, 65.0, None, float("nan")]
    assert values(labels.age_band, ages, "double") == [
        "Até 17 anos", "18 a 24 anos", "18 a 24 anos", "25 a 29 anos", "30 a 39 anos",
        "40 a 49 anos", "50 a 64 anos", "65 anos ou mais", "Ignorado", "Ignorado",
    ]


def test_band_codes(values):
    raw = ["03", "3", "3.0", '"03"', "0NA", None, "09", "nan"]
    assert values(labels.band_to_age, raw) == [29.0, 29.0, 29.0, 29.0, None, None, None, None]
    assert values(labels.band_is_unknown, raw)[:5] == [False] * 5
    assert values(labels.band_is_unknown, raw)[6] is True


def test_periods(values):
    raw = ["202602", "202602.0", "20269", "2026", None, "202613"]
    got = values(labels.parse_period, raw)
    assert got == [dt.datetime(2026, 2, 1)] * 2 + [None] * 4
    assert values(lambda c: labels.period_label(F.lit(2026), c), [4], "int") == ["Abril de 2026"]


def test_resolve_two_letter(values):
    table = {"PARANA": "PR"}
    got = values(lambda c: labels.resolve_two_letter(c, table, text.join_key), ["pr", "Paraná", "X", None])
    assert got == ["PR", "PR", None, None]


def test_score_frozen(values):
    got = values(lambda c: scoring.score_frozen(c, 2.0, 4.0), [1.0, 2.0, 3.0, 4.0, 9.0, None], "double")
    assert got == [0.0, 0.0, 50.0, 100.0, 100.0, None]
    with pytest.raises(ValueError):
        scoring.score_frozen(F.lit(1.0), 2.0, 2.0)


def test_balance_quality_and_reliability(values):
    assert values(lambda c: scoring.absorption_balance(c, c, 5, 10), [0.0, 7.0], "double") == [50.0, 50.0]
    assert values(lambda c: scoring.quality_component(c, 10), [0.0, 4.0, 10.0, 25.0, None], "double") == [
        100.0, 60.0, 0.0, 0.0, None,
    ]
    got = values(lambda c: scoring.reliability_class(c, 10, 20), [9, 10, 19, 20, None], "int")
    assert got == [None, "reduced", "reduced", "higher", None]
    assert values(lambda c: scoring.calculable(c, 10), [9, 10, None], "int") == [False, True, False]


@pytest.mark.parametrize(
    ("wage", "flag", "expected"),
    [
        (300.0, "Não", True), (150000.0, "Não", True), (299.99, "Não", False),
        (150000.01, "Não", False), (1000.0, "Sim", False), (1000.0, None, False),
        (None, "Não", False),
    ],
)
def test_wage_eligibility_edges(spark, wage, flag, expected):
    df = spark.createDataFrame([(wage, flag, 1000.0)], "w double, f string, floor double")
    ok = scoring.wage_eligible(F.col("w"), text.is_yes(F.col("f")), F.col("floor"), 0.3, 150)
    assert df.select(ok.alias("ok")).first()["ok"] is expected


def test_components_are_monotone(spark):
    df = spark.range(0, 200).withColumn("x", F.col("id") / 10.0)
    row = df.select(
        "x",
        scoring.score_frozen(F.col("x"), 3.0, 12.0).alias("up"),
        scoring.quality_component(F.col("x"), 10).alias("down"),
        scoring.absorption_balance(F.col("x"), F.lit(5.0), 5, 10).alias("balance"),
    ).orderBy("x").collect()
    for a, b in zip(row, row[1:]):
        assert a["up"] <= b["up"] and a["down"] >= b["down"] and a["balance"] < b["balance"]


def test_a_number_costs_one_pass_of_its_pattern(spark):
    df = spark.createDataFrame([("1,5", 2026)], "v string, ano int")

    def passes(number):
        plan = df.select(number.alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
        return sum(plan.count(word) for word in ("regexp_replace", "regexp_extract", "rlike"))

    assert passes(numbers.finite(F.col("v"))) == 1
    assert passes(numbers.parse_number_plain(F.col("v"))) == 1
    assert passes(numbers.parse_number_br(F.col("v"))) == 2
    assert passes(labels.parse_period(F.col("v"))) == 1


def test_numbers_at_the_edges(values):
    raw = ["1e999", "-1e999", " 5. ", ".5", " 1e3\n", "1\n2", "--", "9" * 400, "+", "١"]
    assert values(numbers.finite, raw) == [None, None, 5.0, 0.5, 1000.0, None, None, None, None, None]
    texts = [" 199904.0 ", "199904\n", "199904.0.0", "199913", "19990", None]
    found = values(labels.parse_period, texts)
    assert [d and (d.year, d.month) for d in found] == [(1999, 4), None, None, None, None, None]
