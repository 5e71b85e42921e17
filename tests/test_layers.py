from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fluxora import session
from fluxora.sources import catalog as cat
from fluxora.sources import files, geo, lake
from fluxora.streaming import landing


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stage_and_counts(spark):
    df, n = session.stage_counted(spark.range(7), "t")
    assert n == 7 and df.count() == 7
    assert session.shared_dir(spark) in session.scratch_path(spark, "x")


def test_empty_stage_counts_zero(spark):
    df, n = session.stage_counted(spark.range(0), "t")
    assert n == 0 and df.count() == 0


FACTS = "ano int, mes string, uf string, municipio string, cod string, admissoes long"
KEY = (["ano", "mes"], "cod", ["uf", "municipio"])


def test_upsert_is_idempotent_and_matches_code_first(spark, tmp_path):
    path = str(tmp_path / "facts")
    columns = ["ano", "mes", "uf", "municipio", "cod", "admissoes"]

    def read(where):
        return spark.read.schema(FACTS).parquet(where).select(*columns)

    base = spark.createDataFrame([(2026, "01", "PR", "A", "1", 5), (2026, "01", "PR", "B", None, 6), (2026, "02", "PR", "A", "1", 7)], FACTS)
    lake.upsert(spark, path, base, *KEY)
    change = spark.createDataFrame([(2026, "01", "PR", "A novo", "1", 50), (2026, "01", "PR", "B", "2", 60), (2026, "03", "PR", "C", "3", 1)], FACTS)
    lake.upsert(spark, path, change, *KEY)
    once = rows_of(read(path))
    print_before = files.table_fingerprint(read(path)).first()
    lake.upsert(spark, path, change, *KEY)
    assert rows_of(read(path)) == once
    assert files.table_fingerprint(read(path)).first() == print_before
    assert [(r[1], r[3], r[4], r[5]) for r in once] == [
        ("01", "A novo", "1", 50), ("01", "B", "2", 60), ("02", "A", "1", 7), ("03", "C", "3", 1),
    ]
    assert (tmp_path / "facts" / "ano=2026" / "mes=01").is_dir()


def test_publish_keeps_old_version_on_failure(spark, tmp_path):
    root = str(tmp_path)
    check = lambda df: ["empty"] if df.isEmpty() else []
    with pytest.raises(FileNotFoundError):
        files.read_current(spark, root)
    version, problems = files.publish(spark.range(3), root, check)
    assert version and not problems
    assert files.publish(spark.range(0), root, check) == (None, ["empty"])
    assert files.read_current(spark, root).count() == 3
    files.publish(spark.range(5), root, check)
    assert files.read_current(spark, root).count() == 5


def test_fallback_order(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    assert lake.write_both(df, root, "t")
    assert not lake.write_both(df.limit(0), root, "nothing")
    assert lake.read_with_fallback(spark, root, "t", df.schema).first()["_source"] == "parquet"
    for f in (tmp_path / "parquet" / "t").glob("part-*"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "parquet" / "t").glob(".*.crc"):
        f.unlink()
    got = lake.read_with_fallback(spark, root, "t", df.schema).first()
    assert tuple(got) == ("a", 1, "csv")
    with pytest.raises(FileNotFoundError):
        lake.read_with_fallback(spark, root, "none", df.schema)


def test_probe_encodings_and_digest(spark, tmp_path):
    (tmp_path / "utf.csv").write_bytes("região;salário\n1;2\n".encode())
    (tmp_path / "latin.csv").write_bytes("região;salário\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_bytes(b"")
    listed = files.listing(spark, str(tmp_path), "*.csv")
    out = {r["path"].rsplit("/", 1)[1]: r for r in files.probe(listed).collect()}
    assert out["utf.csv"]["codificacao"] == "utf-8" and out["utf.csv"]["linhas"] == ["1;2"]
    assert out["latin.csv"]["codificacao"] == "latin-1" and out["latin.csv"]["cabecalho"] == "região;salário"
    assert out["empty.csv"]["cabecalho"] == "" and out["empty.csv"]["length"] == 0
    import hashlib

    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.digests(listed).collect()}
    assert got["utf.csv"] == hashlib.sha256((tmp_path / "utf.csv").read_bytes()).hexdigest()


def test_delimited_headers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Competência Mov;Salário\n202601;1,5\n", encoding="utf-8")
    df = lake.read_delimited(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["competencia_mov", "salario"] and df.first()["salario"] == "1,5"


def test_json_sidecar(spark, tmp_path):
    path = str(tmp_path / "meta")
    files.write_json(spark.createDataFrame([("ok", 3)], "status string, n int"), path)
    assert json.loads(spark.read.text(path).first()["value"]) == {"status": "ok", "n": 3}


def test_backfill_plan(spark):
    src = spark.createDataFrame([(2026, 1), (2026, 2)], "ano int, mes int")
    done = spark.createDataFrame([(2026, 1)], "ano int, mes int")
    plan = lake.backfill_plan(src, done, (2026, 3), (2025, 12)).orderBy("ano", "mes").collect()
    assert [r["acao"] for r in plan] == ["missing", "skipped", "run", "missing"]
    again = lake.backfill_plan(src, done, (2026, 1), (2026, 1), overwrite=True).first()
    assert again["acao"] == "run"


def test_names_in_catalogue(values):
    names = ["tabela_perfil_sexo_salario_pr", "tabela_setor_rmc", "tabela_perfil", "x"]
    assert values(cat.scope_of, names) == ["parana", "rmc", "brasil", "brasil"]
    assert values(cat.granularity_of, names) == ["salario", "setor", "perfil", "desconhecida"]
    assert values(cat.is_legacy, names) == [False, False, True, False]


def test_feature_collection(spark, tmp_path):
    ring = [[[0, 0], [2, 0], [2, 3], [0, 0]]]
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": ring}},
            {"type": "Feature", "properties": {"n": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [ring, [[[9, 9], [-1, 4], [9, 9]]]]}},
            {"type": "Feature", "properties": {"n": "c"}, "geometry": None},
        ],
    }
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    boxes = geo.bounds(geo.read_collections(spark, str(tmp_path / "f.json"), {"n": "string"}))
    assert rows_of(boxes) == [("a", 0.0, 0.0, 2.0, 3.0), ("b", -1.0, 0.0, 9.0, 9.0), ("c", None, None, None, None)]
    assert [r["n"] for r in boxes.where(geo.overlaps(5, 5, 6, 6)).collect()] == ["b"]


def test_stream_delivers_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "d1", 5), (2, "d2", 6)], "id int, d string, v int").write.parquet(source)
    schema = spark.read.parquet(source).schema
    target = str(tmp_path / "out")
    for state in ("s1", "s2"):
        stream = landing.landing_files(spark, source, schema, "*.parquet")
        landing.land(stream, target, str(tmp_path / state), ["d"], "id", lambda: [F.col("v")])
    spark.createDataFrame([(2, "d2", 7), (3, "d1", 1)], "id int, d string, v int").write.mode("append").parquet(source)
    stream = landing.landing_files(spark, source, schema, "*.parquet")
    landing.land(stream, target, str(tmp_path / "s2"), ["d"], "id", lambda: [F.col("v")])
    assert rows_of(spark.read.parquet(target).select("id", "v")) == [(1, 5), (2, 7), (3, 1)]

def test_append_moves_a_key_between_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id int, v int, mes int"

    def add(*rows):
        source = spark.createDataFrame(list(rows), schema)
        lake.append_once(spark, path, source, ["mes"], "id", [F.col("v")])
        return rows_of(spark.read.parquet(path).select("id", "v", "mes"))

    assert add((1, 1, 1), (2, 1, 2), (3, 1, 2)) == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]
    moved = [(1, 2, 3), (2, 1, 2), (3, 2, 3)]
    assert add((1, 2, 3), (3, 2, 3)) == moved
    assert not (tmp_path / "t" / "mes=1").exists()
    assert add((1, 2, 3), (3, 2, 3)) == moved


def test_probe_reads_whole_lines(spark, tmp_path):
    header = ";".join(["coluna_é"] * 20_000)
    (tmp_path / "long.csv").write_bytes((header + "\n" + "1;2\n" * 5).encode())
    found = files.probe(files.listing(spark, str(tmp_path), "*.csv"), 3).first()
    assert found["codificacao"] == "utf-8" and found["cabecalho"] == header
    assert found["linhas"] == ["1;2"] * 3


def test_pointer_is_replaced_not_truncated(spark, tmp_path):
    for n in (1, 2):
        version, _ = files.publish(spark.range(n), str(tmp_path), lambda df: [])
        assert files.current_version(spark, str(tmp_path)) == version
    assert [p.name for p in tmp_path.glob("CURRENT*")] == ["CURRENT"]


def test_footers_tell_rows_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1], "x"), (2, None, None, None)], "a int, b string, c array<int>, d string")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    found = files.footers(files.listing(spark, str(tmp_path), "*.parquet")).first()
    assert (found["row_count"], found["columns"], found["present"]) == (2, ["a", "b", "c", "d"], ["a", "c", "d"])


def test_catalogue_reads_no_data_page(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2026, "x", None), (2, 2026, "y", None)], "n int, ano int, k string, z string")
    lake.write_table(rows.withColumn("tabela", F.lit("tabela_uf")), str(tmp_path / "parquet"), ["tabela", "ano"])
    lake.write_delimited(rows.withColumn("tabela", F.lit("tabela_uf")), str(tmp_path / "csv"), ["tabela", "ano"], sep=",")
    for part in (tmp_path / "parquet").rglob("*.parquet"):
        raw = bytearray(part.read_bytes())
        raw[4:20] = b"\xff" * 16  # the first data page
        part.write_bytes(bytes(raw))
    for crc in (tmp_path / "parquet").rglob(".*.crc"):
        crc.unlink()
    row = cat.catalog(spark, str(tmp_path), ["tabela_uf"], ["ano"]).first()
    assert (row["row_count"], row["columns"], row["column_count"]) == (2, ["k", "n"], 2)
    assert row["bytes"] > 0 and row["modificado"] is not None


def test_load_accounts_for_every_row(spark, tmp_path):
    path = str(tmp_path / "facts")
    columns = ["ano", "mes", "uf", "municipio", "cod", "admissoes"]

    def load(*rows, **options):
        df = spark.createDataFrame(list(rows), FACTS)
        told = lake.load(spark, path, df, *KEY, required=["cod", "municipio"], **options)
        return rows_of(told.select("mes", *lake.ACTIONS, "repeated", "skipped"))

    def stored():
        return rows_of(spark.read.schema(FACTS).parquet(path).select(*columns))

    first = [(2026, "01", "PR", "A", "1", 5), (2026, "01", "PR", "B", "2", 6), (2026, "02", "PR", "A", "1", 7)]
    bad = [(2026, "02", "PR", "C", None, 1), (2026, "03", "PR", " ", "9", 1)]
    account = [("01", 2, 0, 0, 0, 0), ("02", 1, 0, 0, 0, 1), ("03", 0, 0, 0, 0, 1)]
    assert load(*first, *bad, dry_run=True) == account and not (tmp_path / "facts").exists()
    assert load(*first, *bad) == account
    before = stored()
    again = [("01", 0, 0, 2, 0, 0), ("02", 0, 0, 1, 0, 1), ("03", 0, 0, 0, 0, 1)]
    assert load(*first, *bad) == again and stored() == before
    change = [(2026, "01", "PR", "A novo", "1", 50), (2026, "01", "PR", "A novo", "1", 49), (2026, "01", "PR", "D", "4", 1)]
    assert load(*change, dry_run=True) == [("01", 1, 1, 0, 1, 0)] and stored() == before
    assert load(*change) == [("01", 1, 1, 0, 1, 0)]
    assert [r[3:] for r in stored() if r[1] == "01"] == [("A novo", "1", 50), ("B", "2", 6), ("D", "4", 1)]


def test_copies_start_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("é", 1, "x"), ("b", 2, "y")], "nome string, n int, p string")
    lake.write_both(df, str(tmp_path), "t", ["p"])
    written = list((tmp_path / "csv" / "t").rglob("part-*.csv"))
    assert len(written) == 2
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfnome,n") for f in written)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv" / "t"))
    assert back.columns == ["nome", "n", "p"]
    assert rows_of(lake.read_delimited(spark, str(tmp_path / "csv" / "t"), sep=",").select("nome", "n")) == [("b", "2"), ("é", "1")]


def test_months_are_prepared_as_a_dry_run_or_written(spark, tmp_path):
    rows = spark.createDataFrame(
        [("202401.0", "a"), ("202401", None), ("202402", "c"), ("x", "d"), (None, "e")], "quando string, v string"
    )
    path = str(tmp_path / "out")

    def account(**more):
        told = lake.prepare_months(rows, path, "quando", lambda df: df.withColumnRenamed("v", "valor"), **more)
        return sorted((tuple(r) for r in told.select("ano", "mes", "filtradas", "gravadas").collect()), key=str)

    assert account(dry_run=True) == [(2024, 1, 2, 0), (2024, 2, 1, 0), (None, None, 2, 0)]
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="2024-03"):
        account(months=[(2024, 1), (2024, 3)])
    assert not (tmp_path / "out").exists()
    assert account(months=[(2024, 2)]) == [(2024, 2, 1, 1)]
    assert account() == [(2024, 1, 2, 2), (2024, 2, 1, 1), (None, None, 2, 0)]
    assert sorted(p.name for p in (tmp_path / "out" / "ano=2024").iterdir() if p.is_dir()) == ["mes=01", "mes=02"]
    with pytest.raises(Exception, match="no such"):
        lake.prepare_months(rows, path, "quando", lambda df: df.select(F.raise_error(F.lit("no such")).alias("a"), "ano", "mes"), dry_run=True)
