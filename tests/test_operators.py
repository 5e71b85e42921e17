from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxora.operators import clean, index_frozen as fi, index_pca as pca
from fluxora.operators import movement as mv
from fluxora.operators import quality, rank, territory
from fluxora.plans.binding import STAR_SPEC
from fluxora.session import stage

MOVES = "uf string, sexo string, admissao int, desligamento int, saldomovimentacao int, salario double"


@pytest.fixture(scope="module")
def moves(spark):
    rows = [
        ("PR", "F", 1, 0, 1, 1000.0),
        ("PR", "F", 0, 1, -1, 2000.0),
        ("PR", None, 1, 0, 1, None),
        ("SC", "M", 1, 0, 1, 1500.0),
        (None, "M", 0, 0, 0, 4000.0),
    ]
    return spark.createDataFrame(rows, MOVES)


def test_null_dimension_is_a_group(moves):
    rows = {r["uf"]: tuple(r)[1:] for r in mv.movement_aggregate(moves, ["uf"]).collect()}
    assert rows == {"PR": (2, 1, 1), "SC": (1, 0, 1), None: (0, 0, 0)}


def test_empty_input_has_schema(moves):
    empty = moves.limit(0)
    assert mv.movement_aggregate(empty, ["uf"]).columns == ["uf", *mv.METRICS]
    assert mv.movement_aggregate(empty, ["uf"]).count() == 0
    assert mv.wage_aggregate(empty, ["uf"]).count() == 0
    assert tuple(mv.movement_total(empty).first()) == (0, 0, 0)


def test_wage_statistics(moves):
    rows = {r["sexo"]: r for r in mv.wage_aggregate(moves, ["sexo"]).collect()}
    assert rows["F"]["salario_mediano"] == 1500.0 and rows["F"]["salario_p25"] == 1250.0
    assert rows[None]["n_salarios_validos"] == 0 and rows[None]["salario_medio"] is None
    assert rows["M"]["salario_max"] == 4000.0


def test_order_puts_separations_ascending(spark):
    rows = [("a", 3, 2, 1), ("b", 3, 1, 1), ("c", 9, 1, 8), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "k string, admissoes long, desligamentos long, saldo long")
    assert [r["k"] for r in mv.ordered(df, ["k"]).collect()] == ["c", "b", "a", "d"]


def test_matrix_has_56_tables():
    assert sum(len(s.scopes) for s in mv.TABLES) == 56


def test_matrix_equals_single_tables(moves):
    specs = [mv.TableSpec("t_uf", ("uf",), scopes=("br",)), mv.TableSpec("t_sexo", ("sexo",)),
             mv.TableSpec("t_sexo_salario", ("sexo",), wages=True)]
    scopes = territory.scope_array(F.coalesce(F.col("uf") == "PR", F.lit(False)), F.lit(False))
    matrix = mv.table_matrix(moves, scopes, specs).cache()
    assert {r["tabela"] for r in matrix.collect()} == {
        "t_uf", "t_sexo", "t_sexo_pr", "t_sexo_salario", "t_sexo_salario_pr",
    }
    one = mv.split_table(matrix, specs[1]).collect()
    assert sorted(map(str, one)) == sorted(map(str, mv.movement_aggregate(moves, ["sexo"]).collect()))
    pr = mv.split_table(matrix, specs[2], "pr").collect()
    expected = mv.wage_aggregate(moves.where("uf = 'PR'"), ["sexo"]).collect()
    assert sorted(map(str, pr)) == sorted(map(str, expected))


def test_entropy_cases(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "nan"), ("c", None), (None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "k string, v string")
    out = {r["k"]: (r["n_v"], r["shannon_v"]) for r in territory.diversity(df, ["k"], {"v": "v"}).collect()}
    assert out["a"][0] == 2 and math.isclose(out["a"][1], math.log(2))
    assert out["b"] == (1, 0.0) and math.copysign(1, out["b"][1]) == 1
    assert out["c"] == (0, None)
    assert out[None] == (2, None)


def test_universe_expansion_and_count(spark):
    places = spark.createDataFrame([(1, "São X"), (2, "sao x"), (3, "B")], "id int, municipio string")
    universe = territory.load_universe(places, "municipio", [F.col("id")], expected=2)
    assert sorted(r["id"] for r in universe.collect()) == [1, 3]
    with pytest.raises(ValueError):
        territory.load_universe(places, "municipio", [F.col("id")], expected=3)
    agg = spark.createDataFrame([("B", 1, 5, 2.5)], "municipio_norm string, mes int, admissoes long, gap double")
    periods = spark.createDataFrame([(1,), (2,)], "mes int")
    spine = territory.periods_spine(universe, periods, "p")
    out = territory.expand_to_universe(agg, spine, ["municipio_norm", "mes"], ["admissoes"])
    rows = {(r["municipio_norm"], r["mes"]): (r["admissoes"], r["gap"]) for r in out.collect()}
    assert rows == {("B", 1): (5, 2.5), ("B", 2): (0, None), ("SAO X", 1): (0, None), ("SAO X", 2): (0, None)}


def test_enrichment(spark):
    lookup = spark.createDataFrame([("SAO X", "0000001"), ("B", "0000002")], "chave string, codigo string")
    rows = [("São X", None), ("b", "9.0"), ("Ignorado", None), ("Z", "nan"), ("B", "<NA>")]
    df = spark.createDataFrame(rows, "m string, c string")
    out = {r["m"]: (r["c"], r["situacao"]) for r in territory.enrich_codes(df, lookup, "m", "c").collect()}
    assert out == {
        "São X": ("0000001", "filled"), "b": ("0000009", "existing"), "Ignorado": (None, "ignored"),
        "Z": (None, "unmatched"), "B": ("0000002", "filled"),
    }


def test_enrichment_strict_names_and_absent_code(spark):
    lookup = spark.createDataFrame([("B", "0000002")], "chave string, codigo string")
    df = spark.createDataFrame([("b",), ("Z",), ("Z",)], "m string")
    out = territory.enrich_codes(df, lookup, "m", "c")
    assert sorted((r["m"], r["c"]) for r in out.collect()) == [("Z", None), ("Z", None), ("b", "0000002")]
    assert [tuple(r) for r in territory.unmatched_names(out, "m").collect()] == [("Z", 2)]
    with pytest.raises(Exception, match="no code for the name Z"):
        territory.enrich_codes(df, lookup, "m", "c", strict=True).collect()


def test_collisions_fail_unless_dropped(spark):
    places = spark.createDataFrame([("A", 1), ("Á", 2), ("B", 3)], "n string, c int")
    with pytest.raises(Exception, match="several codes for the key A"):
        territory.code_lookup(places, "n", "c").collect()
    df = spark.createDataFrame([("a", None)], "m string, c string")
    with pytest.raises(Exception, match="several codes for the key A"):
        territory.enrich_codes(df, territory.code_lookup(places, "n", "c"), "m", "c").collect()


def test_collisions_are_reported_and_dropped(spark):
    places = spark.createDataFrame([("A", 1), ("Á", 2), ("B", 3)], "n string, c int")
    assert [r["chave"] for r in territory.lookup_collisions(places, "n", "c").collect()] == ["A"]
    assert [r["chave"] for r in territory.code_lookup(places, "n", "c", "drop").collect()] == ["B"]


def test_decode_keeps_unmapped(spark):
    dictionary = spark.createDataFrame([("uf", "41", " Paraná ")], "domain string, code string, label string")
    df = spark.createDataFrame([(41.0, 1), (99.0, 2), (None, 3)], "uf double, id int")
    out = {r["id"]: r["uf"] for r in territory.decode(df, dictionary, {"uf": "uf"}).collect()}
    assert out == {1: "Paraná", 2: "99", 3: None}


def test_last_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(map(tuple, territory.last_per_key(df, ["k"], [F.col("o")]).collect())) == [("a", 2, "y"), ("b", 1, None)]
    assert sorted(map(tuple, territory.first_per_key(df, ["k"], [F.col("o")]).collect()))[0] == ("a", 1, "x")


def test_flags_drop_null_sign(spark):
    df = spark.createDataFrame([(1,), (-1,), (0,), (None,)], "s int")
    out = clean.movement_flags(df, "s").orderBy("s").collect()
    assert [(r["admissao"], r["desligamento"]) for r in out] == [(0, 1), (0, 0), (1, 0)]


def test_unknown_band_fails(spark):
    df = spark.createDataFrame([("01",), ("77",)], "b string")
    assert clean.unknown_bands(df, "b").first()["codigo"] == "77"
    with pytest.raises(Exception, match="unmapped age band: 77"):
        clean.age_from_band(df, "b").collect()


def test_column_contracts(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = clean.with_columns_of(df, ["a"], {"b": "double", "a": "int"})
    assert out.dtypes == [("a", "int"), ("b", "double")]
    with pytest.raises(ValueError):
        clean.with_columns_of(df, ["z"], {})
    with pytest.raises(ValueError):
        clean.rename_source(df)
    with pytest.raises(ValueError):
        fi.require_columns(df)


# ---------------------------------------------------------------- frozen index


def small_spec(**changes):
    return fi.replace(fi.load_spec(STAR_SPEC), **changes)


def test_published_spec_loads():
    spec = fi.load_spec(STAR_SPEC.parent / "published.json")
    assert spec.floor_of(2026) == 1621.0
    with pytest.raises(fi.UnknownYearError):
        spec.floor_of(1990)


def test_weights_must_sum_to_one():
    with pytest.raises(fi.SpecError):
        small_spec(weights={"absorcao": 0.5, "remuneracao": 0.6})


def index_rows(spark, hires):
    rows = []
    for place, n in hires.items():
        for i in range(n):
            rows.append((place, "S", 1, 1, 0, 1000.0 + 10 * (i % 7), "Não", "Não", f"c{i % 4}", f"b{i % 3}", f"a{i % 2}", 1998, 1))
    schema = (
        "municipio string, uf string, saldomovimentacao int, admissao int, desligamento int, salario double, "
        "indtrabintermitente string, indtrabparcial string, cbo2002ocupacao string, subclasse string, secao string, "
        "ano int, mes int"
    )
    return spark.createDataFrame(rows, schema)


def test_frozen_index_eligibility(spark):
    spec = small_spec()
    df = index_rows(spark, {"a": 9, "b": 10, "c": 19, "d": 20})
    inputs = stage(fi.index_inputs(df, ["ano", "mes"], ["municipio"], spec), "t")
    spine = spark.createDataFrame([(p, 1998, 1) for p in "abcde"], "municipio string, ano int, mes int")
    scored = fi.score_index(fi.expand_index(inputs, spine, ["ano", "mes"]), ["ano", "mes"], spec)
    out = {r["municipio"]: r for r in fi.rank_index(stage(scored, "t"), ["ano", "mes"], spec).collect()}
    assert [out[p]["reliability_class"] for p in "abcde"] == [None, "reduced", "reduced", "higher", None]
    assert out["a"]["indice"] is None and out["a"]["absorcao"] is not None
    assert out["b"]["indice"] is not None and out["b"]["rank_n20"] is None
    assert out["d"]["rank_n20"] == 1
    # No hires: volume score 0 and a neutral balance.
    assert out["e"]["absorcao"] == 25.0 and out["e"]["remuneracao"] is None
    assert {r["salario_mediano_r4_escopo"] for r in out.values()} == {out["b"]["salario_mediano_r4_escopo"]}


def test_refit_equals_frozen(spark):
    spec = small_spec()
    df = index_rows(spark, {f"m{i}": 10 + 3 * i for i in range(12)})
    inputs = stage(fi.index_inputs(df, ["ano", "mes"], ["municipio"], spec), "t")
    bounds = fi.bounds_from(fi.fit_bounds(inputs, spec))
    raw = np.log1p([10 + 3 * i for i in range(12)])
    np.testing.assert_allclose(bounds["a_volume_raw"], np.quantile(raw, [0.05, 0.95]), atol=1e-12)
    again = spec.with_bounds(bounds, "refit")
    scored = fi.score_index(inputs, ["ano", "mes"], again).select(F.min("a_volume_score"), F.max("a_volume_score")).first()
    assert tuple(scored) == (0.0, 100.0)


def test_version_check(spark):
    spec = small_spec()
    rows = [(1, "2.0", spec.normalization_version), (2, "2.0", "other"), (3, "2.0", spec.normalization_version), (3, "1.0", spec.normalization_version)]
    df = spark.createDataFrame(rows, "mes int, methodology_version string, normalization_version string")
    out = {r["mes"]: r["compativel"] for r in fi.version_check(df, ["mes"], spec).collect()}
    assert out == {1: True, 2: False, 3: False}


# ---------------------------------------------------------------- component index


def reference_component(matrix, signs):
    """Brute-force first component of standardised columns."""
    x = matrix * np.array(signs)
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    scores = z @ vt[0]
    ref = next(i for i, s in enumerate(signs) if s > 0)
    return -scores if np.corrcoef(scores, z[:, ref])[0, 1] < 0 else scores


def test_components_match_svd(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 1))
    x = np.hstack([base + 0.3 * rng.normal(size=(60, 1)) for _ in range(3)])
    x[:, 2] *= -1
    rows = [("p", i, *map(float, r), 4.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "p string, i int, a double, b double, c double, flat double")
    dims = [pca.Dimension("d", ("a", "b", "c", "flat"), ("c",)), pca.Dimension("one", ("b", "flat")), pca.Dimension("none", ("flat",))]
    out = pca.component_scores(df, ["p"], dims).orderBy("i").collect()
    np.testing.assert_allclose([r["d"] for r in out], reference_component(x, [1, 1, -1]), atol=1e-9)
    z = (x[:, 1] - x[:, 1].mean()) / x[:, 1].std(ddof=1)
    np.testing.assert_allclose([r["one"] for r in out], z, atol=1e-9)
    assert {r["none"] for r in out} == {None}


# ---------------------------------------------------------------- quality


def test_validate_clean_statuses(spark):
    schema = (
        "ano int, mes int, competenciamov string, saldomovimentacao int, admissao int, desligamento int, "
        "horascontratuais double, salario double, valorsalariofixo double, idade double, faixa_etaria string, "
        "competencia_date date"
    )
    rows = [
        (2026, 1, "202601", 1, 1, 0, 44.0, 10.0, 10.0, 20.0, "18 a 24 anos", None),
        (2026, 2, "202602.0", 0, 0, 0, 44.0, 10.0, 10.0, 20.0, "Ignorado", None),
        (2026, 3, "202601", 1, 0, 0, 44.0, None, 10.0, 20.0, "18 a 24 anos", None),
    ]
    df = spark.createDataFrame(rows, schema)
    expected = F.format_string("%04d%02d", F.col("ano"), F.col("mes"))
    out = {r["mes"]: r for r in quality.validate_clean(df, ["ano", "mes"], expected).collect()}
    assert out[1]["status"] == "warning"  # recommended columns are absent
    assert "sign_outside" in out[2]["codigos"] and "bands_unknown" in out[2]["codigos"]
    assert out[3]["status"] == "error"
    for code in ("period_mismatch", "flag_mismatch", "all_null:salario"):
        assert code in out[3]["codigos"]
    validation = quality.validate_clean(df, ["ano", "mes"], expected)
    with pytest.raises(ValueError):
        quality.fail_on_error(validation)
    passed = quality.gate_periods(df, validation.where("mes <> 2"), ["ano", "mes"]).collect()
    assert {(r["mes"], r["nota"]) for r in passed} == {(1, "warning"), (2, "not validated")}


def test_invariants_count_every_fault(spark):
    rows = [("a", 1, 0, 1), ("a", 2, 1, 5), (None, -1, 0, -1), ("c", None, 0, 0)]
    df = spark.createDataFrame(rows, "k string, admissoes long, desligamentos long, saldo long")
    row = quality.table_invariants(df, ["k"]).first()
    assert (row["linhas"], row["metricas_nulas"], row["saldo_incoerente"]) == (4, 1, 1)
    assert (row["negativos"], row["chaves_nulas"], row["chaves_duplicadas"]) == (1, 1, 1)


def test_positive_share_and_heatmap(spark):
    df = spark.createDataFrame([("a", 30), ("b", 10), ("c", -5)], "k string, v long")
    out = {r["k"]: r["participacao"] for r in rank.positive_share(df, "v").collect()}
    assert out == {"a": 75.0, "b": 25.0, "c": None}
    flat = spark.createDataFrame([("x", "y", 2.0), ("z", "y", 2.0)], "r string, c string, v double")
    cells = rank.heatmap(flat, "v", "r", "c", ["z"], ["y"]).collect()
    assert {(r["r"], r["linha"], r["intensidade"]) for r in cells} == {("x", 1, 0.65), ("z", 0, 0.65)}
