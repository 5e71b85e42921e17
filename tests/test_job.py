"""The monthly job: gates, the ledger, single stages, bad months and the backfill."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fluxora.operators import movement as mv
from fluxora.operators.territory import decode
from fluxora.plans import job as jobs
from fluxora.plans import ledger
from fluxora.plans.ledger import isolated, read_ledger
from fluxora.sources.files import digests, listing

COLUMNS = (
    "competênciamov;saldomovimentação;horascontratuais;salário;valorsaláriofixo;uf;município;regiao;seção;sexo;idade"
)


def put(root, year, month, rows, header=COLUMNS):
    folder = root / "landing" / f"ano={year}" / f"mes={month:02d}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "a.csv").write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")


def row(period, sign="1", place="A"):
    return f"{period};{sign};44,00;2000,00;2000,00;PR;{place};SUL;M;F;30"


@pytest.fixture()
def job(spark, tmp_path):
    put(tmp_path, 2026, 1, [row("202601"), row("202601", "-1", "B"), "202601;1"])
    put(tmp_path, 2026, 2, [row("202602", place="Nowhere")])
    put(tmp_path, 2026, 3, [row("202604")])  # of another month
    put(tmp_path, 2026, 4, [row("202604"), row("202604")])
    dictionary = spark.createDataFrame([("sexo", "F", "x")], "domain string, code string, label string")
    places = spark.createDataFrame([("A", "1"), ("B", "2")], "municipio string, cod_municipio string")
    specs = [s for s in mv.TABLES if s.name in ("tabela_resumo", "tabela_municipio")]
    return jobs.MonthlyJob(
        str(tmp_path), dictionary, {"sexo": "sexo"}, F.array(F.lit("br")), places, specs, min_bytes=1
    )


def states(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["mes"], {})[r["etapa"]] = r["situacao"]
    return out


def test_stages_gates_and_resume(spark, job, tmp_path):
    checked = states(jobs.run(spark, job, ["landing"]))
    assert checked == {m: {"landing": "error" if m == 3 else "ok"} for m in (1, 2, 3, 4)}
    found = states(jobs.run(spark, job))
    assert found[3] == {"landing": "error", **{s: "blocked" for s in jobs.STAGES[1:]}}
    assert found[1] == {"landing": "skipped", "clean": "warning", "gold": "ok", "enrich": "ok", "catalog": "ok"}
    assert found[2]["enrich"] == "error" and found[2]["catalog"] == "blocked"
    gold = spark.read.parquet(job.path("gold/parquet"))
    assert {(r.mes, r.admissoes, r.desligamentos) for r in gold.filter("tabela = 'tabela_resumo'").collect()} == {
        (1, 1, 1), (2, 1, 0), (4, 2, 0),
    }
    bad = spark.read.parquet(job.path("quarantine")).collect()
    assert [(r["linha"], r["motivo"], r["mes"]) for r in bad] == [("202601;1", "short", 1)]
    enriched = spark.read.parquet(job.path("enriched")).filter("mes = 1 AND tabela = 'tabela_municipio'")
    assert {(r.municipio, r.cod_municipio) for r in enriched.collect()} == {("A", "0000001"), ("B", "0000002")}
    sidecars = list((tmp_path / "validation" / "landing").rglob("*.json"))
    assert {json.loads(p.read_text())["status"] for p in sidecars} == {"ok", "error"}
    # Only what changed runs again; the others keep their entries.
    put(tmp_path, 2026, 2, [row("202602")] * 3)
    plan = states(jobs.run(spark, job, dry_run=True))
    assert plan[2] == dict.fromkeys(jobs.STAGES, "run") and set(plan[1].values()) == {"skipped"}
    entries = read_ledger(spark, job.path("ledger")).count()
    again = states(jobs.run(spark, job))
    assert again[2] == {"landing": "ok", "clean": "warning", "gold": "ok", "enrich": "ok", "catalog": "ok"}
    assert set(again[1].values()) == {"skipped"} and again[3]["landing"] == "error"
    ledger = read_ledger(spark, job.path("ledger"))
    assert ledger.count() == entries + 5 + 1  # month 2 at all stages, month 3 at the first
    assert {r.tentativa for r in ledger.filter("mes = 4").collect()} == {1}


def test_backfill(spark, job):
    stages = ("landing", "clean")
    with pytest.raises(ValueError, match="no landing files"):
        jobs.backfill(spark, job, (2025, 1), (2025, 12), stages=stages)
    planned = jobs.backfill(spark, job, (2026, 5), (2025, 12), dry_run=True, stages=stages)
    kinds = {(r.ano, r.mes): r.situacao for r in planned.collect()}
    assert kinds == {(2025, 12): "missing", **{(2026, m): "run" for m in (1, 2, 3, 4)}, (2026, 5): "missing"}
    assert read_ledger(spark, job.path("ledger")).count() == 0
    done = jobs.backfill(spark, job, (2026, 2), (2026, 4), stages=stages).collect()
    assert {r.mes: r.situacao for r in done} == {2: "warning", 3: "error", 4: "warning"}
    assert "period_mismatch" in {r.mes: r.codigos for r in done}[3]
    rest = jobs.backfill(spark, job, (2026, 1), (2026, 4), stages=stages)
    assert {r.mes: r.situacao for r in rest.collect()} == {1: "warning", 2: "skipped", 3: "error", 4: "skipped"}
    forced = jobs.backfill(spark, job, (2026, 4), (2026, 4), overwrite=True, stages=stages)
    assert forced.first()["situacao"] == "warning"
    with pytest.raises(ValueError, match="unknown stages"):
        jobs.run(spark, job, ["silver"])


def test_a_month_that_throws_stands_alone(spark, job, monkeypatch):

    def throwing(spark_, job_, periods):
        if (2026, 4) in periods:
            raise ValueError("disk on fire")
        return {p: ("ok", "") for p in periods}

    monkeypatch.setitem(jobs.WORK, "landing", throwing)
    found = jobs.run(spark, job, ["landing"]).collect()
    assert {r.mes: (r.situacao, r.codigos) for r in found} == {
        1: ("ok", ""), 2: ("ok", ""), 3: ("ok", ""), 4: ("error", "disk on fire"),
    }


def test_isolation_counts_its_jobs():
    calls = []

    def work(periods):
        calls.append(len(periods))
        if (2000, 7) in periods:
            raise ValueError("bad")
        return {p: ("ok", "") for p in periods}

    months = [(2000, m) for m in range(1, 13)]
    found = isolated(work, months)
    assert [p for p, o in found.items() if o[0] == "error"] == [(2000, 7)] and len(found) == 12
    assert len(calls) <= 9

    def broken(periods):
        calls.append(0)
        raise ValueError("no network")

    calls.clear()
    with pytest.raises(ValueError, match="no network"):
        isolated(broken, [(2000 + i, 1) for i in range(500)])
    assert len(calls) <= 14
    assert isolated(broken, []) == {}


def test_new_files_are_dealt_out_for_their_digests(spark, tmp_path, monkeypatch):
    listed = spark.createDataFrame(
        [(f"file:/x/{i}.csv", 40 << 20) for i in range(30)], "path string, length long"
    ).coalesce(1)
    dealt = ledger.dealt(listed)
    assert dealt.rdd.getNumPartitions() == 19  # 1200 MB in parts of 64 MB
    assert max(dealt.rdd.glom().map(len).collect()) == 2
    assert ledger.dealt(listed.limit(2)).rdd.getNumPartitions() == 2
    assert ledger.dealt(listed.limit(0)).collect() == []
    seen = []
    monkeypatch.setattr(ledger, "digests", lambda files: seen.append(files.rdd.getNumPartitions()) or digests(files))
    for i in range(6):
        (tmp_path / f"{i}.csv").write_text("a;b\n" * i)
    found = ledger.file_digests(spark, listing(spark, str(tmp_path), "*.csv"), str(tmp_path / "digests"))
    assert found.count() == 6 and seen == [4]


def test_rows_of_one_code_are_not_gathered(spark):
    df = spark.createDataFrame([("F", 1), ("F", 2), ("X", 3), (None, 4)], "sexo string, i int")
    names = spark.createDataFrame([("sexo", "F", "Fechado")], "domain string, code string, label string")
    out = decode(df, names, {"sexo": "sexo"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.sexo, r.i) for r in out.collect()} == {("Fechado", 1), ("Fechado", 2), ("X", 3), (None, 4)}
