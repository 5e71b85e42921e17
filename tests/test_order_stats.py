from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxora import session
from fluxora.operators import order_stats as os_
from fluxora.operators import rank

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def skewed_rows():
    """One key holds a third of the rows, one value a third of that key; NULL is a key."""
    rng = random.Random(7)
    rows = []
    for i in range(9000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])
        value = 5.0 if key == "hot" and i % 9 == 0 else round(rng.gauss(0, 50), 1)
        rows.append((key, None if rng.random() < 0.05 else value))
    rows += [("single", 3.5), ("empty", None)]
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(skewed_rows(), "k string, v double").cache()


@pytest.mark.parametrize("small_rows", [0, None])
def test_quantiles_match_numpy(skewed, small_rows):
    got = {
        r["k"]: [r[p] for p in PROBS]
        for r in os_.exact_quantiles(skewed, ["k"], "v", PROBS, small_rows=small_rows).collect()
    }
    groups: dict = {}
    for key, value in skewed_rows():
        if value is not None:
            groups.setdefault(key, []).append(value)
    assert set(got) == set(groups)
    for key, items in groups.items():
        np.testing.assert_allclose(got[key], np.quantile(items, list(PROBS.values())), atol=1e-9)


@pytest.mark.parametrize("small_rows", [0, None])
def test_quantiles_without_keys_and_with_weights(skewed, small_rows):
    counts = skewed.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = os_.exact_quantiles(counts, [], "v", PROBS, weight="n", small_rows=small_rows).first()
    items = [v for _, v in skewed_rows() if v is not None]
    np.testing.assert_allclose(list(got), np.quantile(items, list(PROBS.values())), atol=1e-9)


@pytest.mark.parametrize("small_rows", [0, None])
def test_dense_rank_both_ways(skewed, small_rows):
    out = os_.dense_rank_desc(skewed, ["k"], "v", "r", small_rows=small_rows).collect()
    assert len(out) == len(skewed_rows())
    distinct: dict = {}
    for key, value in skewed_rows():
        if value is not None:
            distinct.setdefault(key, set()).add(value)
    place = {k: {v: i + 1 for i, v in enumerate(sorted(vs, reverse=True))} for k, vs in distinct.items()}
    for row in out:
        expected = None if row["v"] is None else place[row["k"]][row["v"]]
        assert row["r"] == expected


def test_ranges_without_broadcast(skewed, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    got = os_.exact_quantiles(skewed, ["k"], "v", {"m": 0.5}, small_rows=0)
    plain = os_.exact_quantiles(skewed, ["k"], "v", {"m": 0.5})
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_expanded_groups(spark, skewed):
    """Quantiles of coarse groups from fine counts, both ways."""

    def expand(df, kept):
        both = F.array(F.lit("all"), F.coalesce("k", F.lit("none")))
        return df.select(F.explode(both).alias("g"), *kept)

    counts, rows = os_.value_counts(skewed, ["k"], "v")
    ways = [
        os_.quantiles_of_counts(counts, rows, ["g"], PROBS, small, expand, copies=2).collect()
        for small in (0, None)
    ]
    for a, b in zip(*(sorted(w, key=lambda r: r["g"]) for w in ways)):
        assert a["g"] == b["g"]
        np.testing.assert_allclose(a[1:], b[1:], atol=1e-9)


def test_ranges_bound_the_largest_cell(skewed):
    """No range of a key holds more than a few percent of the distinct pairs."""
    counts, rows = os_.value_counts(skewed, ["k"], "v")
    ranged = os_._with_range(counts, "__v")
    largest = ranged.groupBy("k", "__range").count().agg(F.max("count")).first()[0]
    assert largest <= rows * 4 / os_.N_RANGES


def test_rank_universes(spark):
    rows = [("a", 90.0, 50), ("b", 80.0, 15), ("c", 70.0, 25), ("d", 60.0, 9)]
    df = spark.createDataFrame(rows, "m string, s double, n int")
    out = os_.rank_where(df, [], "s", F.col("n") >= 10, "r10")
    out = os_.rank_where(out, [], "s", F.col("n") >= 20, "r20").orderBy("m").collect()
    assert [r["r10"] for r in out] == [1, 2, 3, None]
    assert [r["r20"] for r in out] == [1, None, 2, None]


@pytest.mark.parametrize(
    "scores",
    [
        [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0],
        [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 3.0],
        [5.0, 5.0, 5.0],
        [1.0, 2.0],
        [3.0, 1.0, 2.0],
        [4.0, 1.0, 2.0, 2.0],
        [7.0],
        [0.0] * 20 + [1.0, 2.0, 3.0],
    ],
)
def test_quantile_classes_match_qcut(spark, scores):
    import pandas as pd

    df = spark.createDataFrame(
        [(i, s) for i, s in enumerate(scores)] + [(99, None)], "i int, s double"
    )
    got = [r["c"] for r in rank.quantile_classes(df, [], "s", "c").orderBy("i").collect()]
    series = pd.Series(scores)
    if series.nunique() == 1:
        expected = ["Médio"] * len(scores)
    else:
        q = min(5, len(scores))
        _, edges = pd.qcut(series, q, retbins=True, duplicates="drop")
        names = list(rank.CLASS_LABELS[: len(edges) - 1])
        expected = pd.qcut(series, q, labels=names, duplicates="drop").astype(str).tolist()
    assert got == [*expected, rank.CLASS_MISSING]


def test_minmax_and_zscore_flat(spark):
    df = spark.createDataFrame([("x", 2.0), ("x", 2.0), ("y", 1.0), ("y", 3.0), ("y", None)], "p string, s double")
    out = rank.zscore(rank.minmax_score(df, ["p"], "s", "m"), ["p"], "s", "z")
    rows = {(r["p"], r["s"]): (r["m"], r["z"]) for r in out.collect()}
    assert rows[("x", 2.0)] == (50.0, 0.0)
    assert rows[("y", 3.0)][0] == 100.0
    assert rows[("y", None)] == (None, None)


def test_impute_median(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", 3.0, None), ("a", None, None)], "p string, x double, y double"
    )
    out = rank.impute_median(df, ["p"], ["x", "y"]).collect()
    assert sorted(r["x"] for r in out) == [1.0, 2.0, 3.0]
    assert {r["y"] for r in out} == {0.0}


def test_page_checks(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    rows = rank.page(df, 2, 1, "v", True, ["k"]).collect()
    assert [(r["k"], r["total"]) for r in rows] == [("a", 3), ("b", 3)]
    for bad in ({"limit": 0}, {"limit": 2001}, {"limit": 1, "offset": -1}, {"limit": 1, "sort_by": "zz"}):
        with pytest.raises(ValueError):
            rank.page(df, **bad)


@pytest.mark.parametrize("down", [True, False])
def test_deep_pages_match_the_whole_order(spark, down):
    rng = np.random.default_rng(6)
    values = [int(x) for x in rng.integers(0, 300, 900)] + [7] * 1500 + [None] * 200  # one hot value, NULLs
    rows = [(i, v, i % 3) for i, v in enumerate(values)]
    hot = [(i, 5 if i else 1, 0) for i in range(700)] + [(701, 9, 0)]  # no splitter but the hot value
    for data, offsets in ((rows, (0, 3, 450, 1200, 2350, 2400, 2595, 2600, 9000)), (hot, (0, 1, 350, 690, 700))):
        df = spark.createDataFrame(data, "k int, v int, z int")
        keyed = sorted(data, key=lambda r: (r[1] is None, (-1 if down else 1) * (r[1] or 0), r[0]))
        for offset in offsets:
            found = rank.deep_page(df, 20, offset, "v", down, ["k"], leaf=50).collect()
            assert [r["k"] for r in found] == [r[0] for r in keyed[offset : offset + 20]], offset
            assert all(r["total"] == len(data) for r in found)
    for bad in ({"limit": 0, "offset": 0}, {"limit": 1, "offset": -1}):
        with pytest.raises(ValueError):
            rank.deep_page(df, sort_by="v", **bad)
    with pytest.raises(ValueError, match="zz"):
        rank.deep_page(df, 1, 0, "v", True, ["zz"])


def test_period_delta_lists(spark):
    rows = [("a", "1", 5), ("a", "2", 9), ("b", "1", 0), ("b", "2", -2), ("c", "2", 4), ("", "1", 1), ("", "2", 2)]
    df = spark.createDataFrame(rows, "m string, p string, v long")
    delta = rank.period_delta(df, rank.period_pairs(df, "p"), "m", "p", "v")
    got = {r["m"]: (r["delta"], r["delta_pct"]) for r in rank.largest_changes(delta, "m", "p").collect()}
    assert got == {"a": (4.0, 80.0), "b": (-2.0, None)}


def test_both_quantile_paths_give_the_same_bits(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([2601.17, 2601.18, 0.1, rng.uniform(1, 9999)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {f"q{i}": i / 40 for i in range(41)}
    small, ranged = (
        {r["k"]: tuple(r) for r in os_.exact_quantiles(df, ["k"], "v", probs, small_rows=n).collect()}
        for n in (None, 0)
    )
    assert small == ranged
