"""Registered queries beside their SQL twins on the smallest tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from scripts.check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
# The whole list takes minutes: FLUXORA_ALL=1 runs it, scripts/check.py as well.
SHORT = """
movement_by_uf movement_by_parcial wage_by_sexo movement_total norm_key parse_number_br
decode_dimensions stamp_period movement_flags scope_filter dense_rank_desc quantile_classes
page top_bottom period_delta event_counters dedup_keep_last territory_indicators
expand_universe enrich_codes key_coverage join_residue feature_join frozen_index fit_bounds
index_summary diagnostic_flags validate_clean gate_periods reconcile_totals compare_copies
landing_headers upsert_facts staged_publish catalog feature_bounds landing_stream
""".split()
KEYS = sorted(contract.queries()) if os.environ.get("FLUXORA_ALL") else SHORT


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    df = contract.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = contract.oracle_sql().get(key)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = [str(d[1]) for d in cur.description]
    verdict = compare(rows, df.columns, [t for _, t in df.dtypes], cur.fetchall(), cols, kinds)
    assert verdict == "ok", verdict
