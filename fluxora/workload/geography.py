"""Whole feature collections, layers by cell and loads of shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.plans.binding import movements
from fluxora.session import scratch_path, stage
from fluxora.sources import cells, features, geo, lake
from fluxora.workload.base import MOV, PLACES, query, r, rounded
from fluxora.workload.layers import PROPERTIES, write_features

_BOXES = f"""{PLACES}, b AS (SELECT cod_municipio, municipio, uf, saldo_conta / 100.0 AS min_lon,
      CAST(cod_municipio::INTEGER % 90 AS DOUBLE) AS min_lat, saldo_conta / 100.0 + CASE WHEN regiao = 'ASIA' THEN 6 ELSE 1 END AS max_lon,
      CAST(cod_municipio::INTEGER % 90 + 2 AS DOUBLE) AS max_lat FROM places)"""


def whole_documents(spark: SparkSession, sf: str) -> str:
    """All supplier shapes as FeatureCollection documents; those with a code ending in 9 lack a colon."""
    path = scratch_path(spark, "collections")
    lines = spark.read.text(write_features(spark, sf))
    damaged = F.regexp_replace("value", '"coordinates":', '"coordinates"')
    hurt = F.regexp_like("value", F.lit('"cod_municipio":"[0-9]*9"'))
    features.write_collections(lines.select(F.when(hurt, damaged).otherwise(F.col("value")).alias("value")), path)
    return path


@query(
    "feature_scan",
    f"""WITH {_BOXES} SELECT cod_municipio, municipio, uf, NULL::VARCHAR AS motivo, {r('min_lon', 'min_lon')}, {r('max_lat', 'max_lat')} FROM b WHERE cod_municipio NOT LIKE '%9'
    UNION ALL SELECT cod_municipio, NULL, NULL, 'malformed', NULL, NULL FROM b WHERE cod_municipio LIKE '%9'""",
)
def feature_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the features that can be read, and the codes of those set aside."""
    found = features.scan_collections(spark, whole_documents(spark, sf), PROPERTIES)
    boxes = geo.bounds(found.rows).withColumn("motivo", F.lit(None).cast("string"))
    columns = ["cod_municipio", "municipio", "uf", "motivo", "min_lon", "max_lat"]
    code = F.regexp_extract(F.col("dados").cast("string"), '"cod_municipio":"([0-9]+)"', 1)
    bad = found.rejected.select(code.alias("cod_municipio"), "motivo")
    return rounded(boxes.select(*columns).unionByName(bad, allowMissingColumns=True))


QUERY_BOXES = {"perto": (20.0, 5.0, 24.0, 12.0), "longe": (-200.0, -90.0, 0.0, 40.0), "tudo": (-180.0, -90.0, 180.0, 90.0), "ponto": (60.0, 30.0, 60.0, 30.0)}


@query(
    "spatial_layer",
    f"WITH {_BOXES} " + " UNION ALL ".join(
        f"SELECT '{n}' AS caixa, cod_municipio FROM b WHERE min_lon <= {e} AND max_lon >= {w} AND min_lat <= {t} AND max_lat >= {s}"
        for n, (w, s, e, t) in QUERY_BOXES.items()
    ),
)
def spatial_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Box queries of several sizes over one layer stored by cell."""
    path = scratch_path(spark, "cells")
    boxes = geo.bounds(geo.read_lines(spark, write_features(spark, sf), PROPERTIES))
    cells.write_boxes(boxes, path)
    out = None
    for name, box in QUERY_BOXES.items():
        found = cells.in_box(spark, path, boxes.schema, box).select(F.lit(name).alias("caixa"), "cod_municipio")
        out = found if out is None else out.unionByName(found)
    return out


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Payload of all suppliers; states 1 and 3 lack a code, states 2 and 4 a geometry."""
    rows = geo.read_lines(spark, write_features(spark, sf), PROPERTIES)
    no_code, no_shape = F.col("uf").isin("NATION_1", "NATION_3"), F.col("uf").isin("NATION_2", "NATION_4")
    rows = rows.withColumn("cod_municipio", F.when(~no_code, F.col("cod_municipio")))
    return geo.payload(rows.withColumn("geometry", F.when(~no_shape, F.col("geometry"))), "cod_municipio")


@query(
    "geometry_load",
    f"""WITH {PLACES}, c AS (SELECT uf, count(*) AS n, uf IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') AS skip,
      count(*) FILTER (saldo_conta > 0) AS moved FROM places GROUP BY uf)
    SELECT 1 AS carga, uf, CASE WHEN skip THEN 0 ELSE n END AS inserted, 0::BIGINT AS updated, 0::BIGINT AS unchanged,
      0::BIGINT AS repeated, CASE WHEN skip THEN n ELSE 0 END AS skipped FROM c
    UNION ALL SELECT 2, uf, 0, 0, CASE WHEN skip THEN 0 ELSE n END, 0, CASE WHEN skip THEN n ELSE 0 END FROM c
    UNION ALL SELECT 3, uf, 0, CASE WHEN skip THEN 0 ELSE moved END, CASE WHEN skip THEN 0 ELSE n - moved END, 0,
      CASE WHEN skip THEN n ELSE 0 END FROM c""",
)
def geometry_load(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes loaded, loaded again, and loaded with those of positive balance moved."""
    path = scratch_path(spark, "shapes")
    first = stage(shapes(spark, sf), "shapes")
    moved = first.withColumn(
        "geometria",
        F.when(F.col("min_lon") > 0, F.replace("geometria", F.lit("[["), F.lit("[[[0.0,0.0],["))).otherwise(F.col("geometria")),
    )
    out = None
    for number, rows in ((1, first), (2, first), (3, moved)):
        told = lake.load(
            spark, path, rows, ["uf"], "cod_municipio", ["municipio"], required=["cod_municipio", "geometria"]
        ).withColumn("carga", F.lit(number))
        out = told if out is None else out.unionByName(told)
    return out


@query(
    "geometry_coverage",
    f"""WITH {MOV}, {PLACES}, f AS (SELECT DISTINCT cod_municipio FROM mov WHERE admissao = 1),
    p AS (SELECT *, CASE WHEN uf NOT IN ('NATION_1', 'NATION_3') THEN cod_municipio END AS cod,
      uf NOT IN ('NATION_2', 'NATION_4') AS shape FROM places),
    j AS (SELECT f.cod_municipio IS NOT NULL AS inf, g.cod IS NOT NULL AS inp
      FROM f FULL JOIN (SELECT cod FROM p WHERE shape AND cod IS NOT NULL) g ON f.cod_municipio = g.cod),
    t AS (SELECT count(*) FILTER (inf) AS fact_total, count(*) FILTER (inf) AS fact_territorial, 0::BIGINT AS non_territorial,
      count(*) FILTER (inp) AS place_total, count(*) FILTER (inf AND inp) AS matched,
      count(*) FILTER (inf AND NOT inp) AS unmatched_fact, count(*) FILTER (inp AND NOT inf) AS unmatched_place FROM j)
    SELECT (SELECT count(*) FROM p) AS features, (SELECT count(*) FROM p WHERE cod IS NULL) AS without_code,
      (SELECT count(*) FROM p WHERE NOT shape) AS without_geometry, t.*,
      {r('100.0 * matched / fact_territorial', 'coverage_pct', 2)}, unmatched_fact = 0 AND fact_territorial > 0 AS ok FROM t""",
)
def geometry_coverage(spark: SparkSession, sf: str) -> DataFrame:
    facts = movements(spark, sf, ["cod_municipio", "admissao"]).where("admissao = 1")
    return geo.geometry_coverage(shapes(spark, sf), facts, "cod_municipio")
