from __future__ import annotations

from fluxora.plans import binding

DATA = "/root/testdata/sf0.001"


def test_parts_grow_with_the_table(spark, monkeypatch):
    rows = binding.table(spark, DATA, "lineitem")
    assert binding.spread(rows, "l_orderkey").rdd.getNumPartitions() == 4
    monkeypatch.setattr(binding, "PART_BYTES", 5000)
    parts = binding.spread(rows, "l_orderkey").rdd.getNumPartitions()
    assert parts > 10
    monkeypatch.setattr(binding, "PART_BYTES", 2500)
    assert binding.spread(rows, "l_orderkey").rdd.getNumPartitions() >= 2 * parts


def test_large_tables_are_dealt_out_where_orders_are_joined(spark, monkeypatch):
    monkeypatch.setattr(binding, "SMALL_INPUT", 0)
    monkeypatch.setattr(binding, "PART_BYTES", 5000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = binding.movements(spark, DATA, ["graudeinstrucao", "faixa_etaria"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        alone = binding.movements(spark, DATA, ["ano"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_NUM" in plan
    # The rows go to the orders as they were dealt out: one exchange of them by the order.
    assert plan.count("hashpartitioning(l_orderkey") == 1
    assert "REPARTITION" not in alone._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == binding.table(spark, DATA, "lineitem").count()
