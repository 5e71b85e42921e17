"""Keyed merges read what they touch only; running counts are published by changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fluxora.sources import lake
from fluxora.streaming import landing

SCHEMA = "id int, v int, mes string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def add(spark, path, *rows, buckets=8):
    source = spark.createDataFrame(list(rows), SCHEMA)
    lake.append_once(spark, path, source, ["mes"], "id", [F.col("v")], buckets)
    return rows_of(spark.read.schema(SCHEMA).parquet(path).select("id", "v", "mes"))


def index_of(spark, path):
    return rows_of(spark.read.schema("id int, mes string").parquet(f"{path}__index").select("id", "mes"))


def test_index_follows_every_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(i, 1, f"m{i % 3}") for i in range(12)]
    assert add(spark, path, *first) == sorted(first, key=str)
    assert index_of(spark, path) == sorted([(i, f"m{i % 3}") for i in range(12)], key=str)
    moved = [(0, 2, "m9"), (1, 0, "m8"), (20, 1, None)]  # newer, older than stored, without a month
    expected = sorted([(0, 2, "m9"), *first[1:], (20, 1, None)], key=str)
    for _ in range(2):  # delivered again: nothing changes
        assert add(spark, path, *moved) == expected
        assert sorted(index_of(spark, path), key=str) == sorted([(i, m) for i, _, m in expected], key=str)


def test_only_touched_partitions_and_buckets_are_written(spark, tmp_path):
    path = tmp_path / "t"
    add(spark, str(path), *[(i, 1, f"m{i % 6}") for i in range(60)], buckets=32)

    def files(root):
        return {p for p in root.rglob("part-*.parquet")}

    before, index_before = files(path), files(tmp_path / "t__index")
    add(spark, str(path), (6, 2, "m1"), buckets=32)  # from m0 to m1
    changed = {p.parent.name for p in before ^ files(path)}
    assert changed == {"mes=m0", "mes=m1"}
    assert len({p.parent.name for p in index_before ^ files(tmp_path / "t__index")}) == 1


def test_target_without_an_index_and_lost_index_update(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], SCHEMA).write.partitionBy("mes").parquet(path)
    assert add(spark, path, (1, 2, "b")) == [(1, 2, "b"), (2, 1, "b")]
    real = lake.write_table

    def fails_after(df, where, partition):
        real(df, where, partition)
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(lake, "write_table", fails_after)
        with pytest.raises(OSError):
            add(spark, path, (1, 3, "c"))
    # The next batch comes first: the row that the lost one left behind is found.
    assert add(spark, path, (1, 4, "d")) == [(1, 4, "d"), (2, 1, "b")]
    assert add(spark, path, (1, 3, "c")) == [(1, 4, "d"), (2, 1, "b")]


def test_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    add(spark, path, *[(i, 1, f"m{i % 6}") for i in range(30)])
    touched = spark.createDataFrame([("m2",), ("m4",)], "mes string")
    found = lake.touched_only(spark.read.parquet(path), touched, ["mes"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [mes" in plan.replace("\n", " ") and "m2" in plan
    assert {r.mes for r in found.collect()} == {"m2", "m4"}


def test_counts_are_published_by_changes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "counts")
    schema = "k string, j int"

    def deliver(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = landing.landing_files(spark, source, spark.read.parquet(source).schema, "*.parquet")
        landing.count_available(
            stream, ["k"], F.count(F.lit(1)), target, str(tmp_path / "state"), compact_after=2
        )
        return {r["k"]: r["n"] for r in landing.read_counts(spark, target, ["k"]).collect()}

    with pytest.raises(FileNotFoundError):
        landing.read_counts(spark, target, ["k"])
    assert deliver(("a", 1), ("b", 1), ("a", 2)) == {"a": 2, "b": 1}
    assert deliver(("b", 3)) == {"a": 2, "b": 2}
    state = landing.counts_state(spark, target)
    assert len(state["folders"]) == 2
    # The second trigger wrote the changed key only.
    assert rows_of(spark.read.parquet(f"{target}/{state['folders'][1]}")) == [("b", 2)]
    assert deliver(("c", 1), (None, 1)) == {"a": 2, "b": 2, "c": 1, None: 1}
    assert landing.counts_state(spark, target)["folders"][0].startswith("counts-")
    assert deliver(("a", 1)) == {"a": 3, "b": 2, "c": 1, None: 1}
