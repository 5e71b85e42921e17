"""Split scan of feature collections against the reader of whole documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fluxora.sources import features, geo

KINDS = {"n": "string", "v": "double"}
NASTY = ['a"b', "{", "}", "]}", '"features": [', "\\", '\\"', "é€", "x}{y", '{"type": "Feature"}', ""]


def document(n, **more):
    def feature(i):
        ring = [[[i, 0], [i + 1, 0], [i + 1, 2.5], [i, 0]]]
        shape = {"type": "Polygon", "coordinates": ring * (1 + i % 3)} if i % 5 else None
        props = {"n": NASTY[i % len(NASTY)] + str(i), "v": i / 2, "features": [{"deep": [i]}]}
        return {"type": "Feature", "properties": props, "geometry": shape}

    return {
        "type": "FeatureCollection",
        "crs": {"type": "name", "properties": {"name": "x"}},
        "links": [{"features": [{"properties": {"n": "no"}}]}],
        **more,
        "features": [feature(i) for i in range(n)],
        "tail": [{"type": "Feature", "properties": {"n": "no"}}],
    }


@pytest.fixture()
def small_blocks(spark):
    def choose(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield choose
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows_of(df):
    shape = F.concat_ws(" ", "geometry.type", F.regexp_replace("geometry.coordinates", r"\s", "")).alias("geometry")
    shown = df.select(*[shape if c == "geometry" else F.col(c).cast("string") for c in df.columns])
    return sorted(map(tuple, shown.collect()), key=str)


def cut_by_blocks(spark, texts, sizes):
    """Features and open pieces of every text for every block size, without reading files."""
    told, blocks = [], {}
    for t, text in enumerate(texts):
        for size in sizes:
            name, at, summaries = f"{t}:{size}", 0, {}
            for fragment in text.removesuffix(b"}").split(b"}"):
                block = at // size * size
                summaries.setdefault(block, features.Summary()).add(fragment + b"}")
                blocks.setdefault((name, block), []).append(fragment + b"}")
                at += len(fragment) + 1
            told += [s.row(name, b, len(text)) for b, s in summaries.items()]
    starts = features.starts(spark.createDataFrame(told, features.SUMMARY_DDL)).collect()
    found = {}
    for r in sorted(starts, key=lambda r: (r[features.FILE], r[features.BLOCK])):
        cutter = features.Cutter(r[features.FILE], r[features.BLOCK], r.asDict())
        for fragment in blocks[r[features.FILE], r[features.BLOCK]]:
            found.setdefault(r[features.FILE], []).extend(cutter.add(fragment))
        found[r[features.FILE]].extend(cutter.finish())
    return found


def put_together(pieces):
    """Texts by position of closed features, and of what stays open."""
    closed, still = {}, b""
    groups = {}
    for p in pieces:
        if p["whole"]:
            closed[p["posicao"]] = p[features.DATA]
        elif p["open"]:
            still += p[features.DATA]
        else:
            groups.setdefault(p["owner"], []).append(p)
    for parts in groups.values():
        closed[parts[0]["posicao"]] = b"".join(p[features.DATA] for p in parts)
    return closed, still


def test_any_block_size_gives_the_same_features(spark):
    docs = [document(7), document(5), document(0), {"features": document(3)["features"]}]
    texts = [
        json.dumps(docs[0], ensure_ascii=False).encode(), json.dumps(docs[1], indent=1).encode() + b"\n",
        json.dumps(docs[2]).encode(), json.dumps(docs[3]).encode(),
    ]
    cut_at = texts[0].rindex(b'"geometry"') + 30
    texts.append(texts[0][:cut_at])
    for name, pieces in cut_by_blocks(spark, texts, [1, 7, 23, 64, 150, 301, 1000, 1 << 20]).items():
        t = int(name.split(":")[0])
        closed, still = put_together(pieces)
        assert all(texts[t][at : at + len(d)] == d for at, d in closed.items()), name
        got = [json.loads(closed[at]) for at in sorted(closed)]
        if t < 4:
            assert got == docs[t]["features"] and not still, name
        else:
            assert got == docs[0]["features"][: len(got)] and len(got) >= 6, name
            assert not still or texts[4].endswith(still), name


def test_split_scan_equals_whole_documents(spark, tmp_path, small_blocks):
    (tmp_path / "a.json").write_text(json.dumps(document(23), ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(document(9), indent=1) + "\n")
    (tmp_path / "c.json").write_text(json.dumps(document(0)))
    (tmp_path / "d.json").write_text("\ufeff" + json.dumps({"features": document(3)["features"]}))
    (tmp_path / "e.json").write_text("")
    (tmp_path / "f.json").write_text("[]")
    want = rows_of(geo.read_collections(spark, str(tmp_path), KINDS))
    small_blocks(1500)
    found = features.scan_collections(spark, str(tmp_path), KINDS)
    assert rows_of(found.rows) == want and len(want) == 35
    assert found.rejected.count() == 0
    files = {r["arquivo"][-6]: r for r in found.files.collect()}
    assert sorted(files) == list("abcdf") and all(r["fechada"] for r in files.values())
    assert files["a"]["blocos"] > 2


def test_damaged_features_are_set_aside(spark, tmp_path):
    sound = json.dumps(document(4), ensure_ascii=False).encode()
    spoiled = sound.replace(b'"v": 0.5', b'"v": 0,5x').replace(b'"n": "}2"', b'"n": "\xff2"')
    (tmp_path / "a.json").write_bytes(spoiled)
    whole = json.dumps({"features": document(3)["features"]}).encode()
    cut_at = whole.rindex(b'"geometry"') + 30
    (tmp_path / "b.json").write_bytes(whole[:cut_at])
    found = features.scan_collections(spark, str(tmp_path), KINDS)
    assert sorted(r["n"] for r in found.rows.collect()) == ["]}3", 'a"b0', 'a"b0', "{1"]
    bad = found.rejected.orderBy("arquivo", "posicao").collect()
    assert [r["motivo"] for r in bad] == ["malformed", "undecodable", "open"]
    for r in bad:
        text = spoiled if r["arquivo"].endswith("a.json") else whole[:cut_at]
        assert text[r["posicao"] : r["posicao"] + len(r["dados"])] == bytes(r["dados"])
    closed = {r["arquivo"][-6]: r["fechada"] for r in found.files.collect()}
    assert closed == {"a": True, "b": False}


def test_a_document_without_its_last_brace_is_not_closed(spark, tmp_path):
    text = json.dumps({"features": document(3)["features"]})
    (tmp_path / "a.json").write_text(text[:-3])  # without the brace of the last feature
    found = features.scan_collections(spark, str(tmp_path), KINDS)
    assert found.rows.count() == 2 and not found.files.first()["fechada"]
    assert {r["motivo"] for r in found.rejected.collect()} == {"open"}


def test_documents_are_written_by_task(spark, tmp_path):
    lines = spark.range(0, 40, 1, 3).select(
        F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id").cast("string").alias("n")).alias("properties"))).alias("value")
    )
    features.write_collections(lines, str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        assert json.loads(part.read_text())["type"] == "FeatureCollection"
    found = features.scan_collections(spark, str(tmp_path / "out"), KINDS)
    assert sorted(int(r["n"]) for r in found.rows.collect()) == list(range(40))


def test_payload_skips_what_cannot_be_stored(spark, tmp_path):
    def line(code, shape):
        return json.dumps({"type": "Feature", "properties": {"c": code}, "geometry": shape})

    ring = [[[0, 0], [2, 0], [2, 3], [0, 0]]]
    lines = [
        line("12.0", {"type": "Polygon", "coordinates": ring}),
        line(" ", {"type": "Polygon", "coordinates": ring}),
        line("14", None),
        line("15", {"type": "Polygon", "coordinates": []}),
        line("16", {"type": "Point", "coordinates": [1, 2]}),
        line("17", {"type": "MultiPolygon", "coordinates": [ring]}),
    ]
    (tmp_path / "l.json").write_text("\n".join(lines))
    shapes = geo.payload(geo.read_lines(spark, str(tmp_path), {"c": "string"}), "c")
    got = {r["c"]: r["geometria"] for r in shapes.collect() if r["c"] is not None}
    assert json.loads(got["0000012"]) == {"type": "Polygon", "coordinates": ring}
    assert got["0000014"] is got["0000015"] is got["0000016"] is None
    assert json.loads(got["0000017"])["coordinates"] == [ring]
    facts = spark.createDataFrame([("0000012",), ("0000014",), ("9999999",)], "c string")
    told = geo.geometry_coverage(shapes, facts, "c").first()
    assert (told["features"], told["without_code"], told["without_geometry"]) == (6, 1, 3)
    assert (told["matched"], told["unmatched_fact"], told["ok"]) == (1, 2, False)
