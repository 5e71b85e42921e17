from __future__ import annotations

import pytest

import __spark_entry__ as contract
from fluxora.plans import binding

DATA = "/root/testdata/sf0.001"

# Queries whose tasks were projected to outgrow their memory (findings F11 to F16).
KEYS = (
    "gate_periods",
    "reconcile_totals",
    "validate_gold",
    "pca_dimensions",
    "territory_indicators",
    "wage_by_faixa_etaria_instrucao",
)


@pytest.mark.parametrize("key", KEYS)
def test_parts_of_the_query_grow_with_the_facts(spark, monkeypatch, key):
    dealt = []
    spread = binding.spread

    def counting(*args, **kwargs):
        out = spread(*args, **kwargs)
        dealt.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(binding, "spread", counting)
    most = []
    for part_bytes in (5000, 2500):
        monkeypatch.setattr(binding, "PART_BYTES", part_bytes, raising=False)
        dealt.clear()
        contract.queries()[key](spark, DATA)
        most.append(max(dealt))
    assert most[0] > 10
    assert most[1] >= 2 * most[0]
