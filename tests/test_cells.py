"""Stored boxes by cell against the plain overlap filter."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fluxora.sources import cells, geo

SCHEMA = "id int, min_lon double, min_lat double, max_lon double, max_lat double"


def made_boxes():
    draw = random.Random(5)
    rows = []
    for i in range(1500):
        # A third of all boxes in one town; sizes from points to half the world.
        x, y = (draw.gauss(-49, 0.2), draw.gauss(-25, 0.2)) if i % 3 == 0 else (draw.uniform(-190, 190), draw.uniform(-95, 95))
        w, h = (2.0 ** draw.uniform(-12, 8), 2.0 ** draw.uniform(-12, 7)) if i % 7 else (0.0, 0.0)
        rows.append((i, x, y, x + w, y + h))
    rows += [(2000, None, 1.0, 2.0, 2.0), (2001, 1.0, float("nan"), 2.0, 2.0), (2002, -400.0, -100.0, 400.0, 100.0)]
    # On the very borders of cells.
    rows += [(3000 + i, -180 + 11.25 * i, -90 + 5.625 * i, -180 + 11.25 * (i + 1), -90 + 5.625 * (i + 1)) for i in range(32)]
    return rows


def test_box_queries_read_near_folders_only(spark, tmp_path):
    boxes = spark.createDataFrame(made_boxes(), SCHEMA).repartition(3)
    path = str(tmp_path / "layer")
    cells.write_boxes(boxes, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 1500 + 3 + 32

    def files(df):
        return df.select("_metadata.file_path").distinct().count()

    draw = random.Random(6)
    queries = [(-49.1, -25.1, -48.9, -24.9), (-180, -90, 180, 90), (11.25, 5.625, 11.25, 5.625), (181, 91, 200, 99), (-300, -95, -185, 0)]
    for _ in range(4):
        x, y = draw.uniform(-185, 185), draw.uniform(-92, 92)
        queries.append((x, y, x + 2.0 ** draw.uniform(-6, 6), y + 2.0 ** draw.uniform(-6, 6)))
    rows = boxes.collect()
    for q in queries:
        want = sorted(
            r["id"] for r in rows
            if None not in tuple(r) and r["min_lon"] <= q[2] and r["max_lon"] >= q[0] and r["min_lat"] <= q[3] and r["max_lat"] >= q[1]
        )
        got = cells.in_box(spark, path, boxes.schema, q)
        assert sorted(r["id"] for r in got.collect()) == want, q
        assert got.columns == boxes.columns
    opened = [files(cells.near(spark, path, boxes.schema, q)) for q in ((-180, -90, 180, 90), (-60, -40, -30, 0), (-49.1, -25.1, -48.9, -24.9))]
    assert opened[0] > 4 * opened[1] > 4 * opened[2], opened
    assert files(stored) > opened[0]  # the folder without a cell


def test_a_crowded_cell_is_many_files(spark, tmp_path):
    rows = spark.range(4000).select(
        F.col("id").cast("int"), *[((F.rand(3 + i % 2) / 3) + s).alias(c) for i, (c, s) in enumerate(zip(cells.SIDES, (1, 1, 1.0, 1.0)))]
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells.write_boxes(rows, str(tmp_path / "layer"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(str(tmp_path / "layer")).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"))
    assert stored.count() >= 4 and stored.agg(F.max("n")).first()[0] < 2500


def test_empty_layer(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    cells.write_boxes(empty, str(tmp_path / "layer"))
    assert cells.in_box(spark, str(tmp_path / "layer"), empty.schema, (0, 0, 1, 1)).count() == 0
    assert geo.extent(empty).first()[0] is None
