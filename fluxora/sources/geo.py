"""Feature collections: properties, bounds and bounding-box filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.functions.text import format_code, upper_key
from fluxora.operators.territory import key_coverage

POLYGON = "array<array<array<double>>>"
MULTIPOLYGON = "array<array<array<array<double>>>>"


def feature_schema(properties: dict[str, str]) -> str:
    props = ", ".join(f"{n}: {t}" for n, t in properties.items())
    # Coordinates stay JSON text here because their depth depends on the type.
    return f"struct<properties: struct<{props}>, geometry: struct<type: string, coordinates: string>>"


def read_collections(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Features of FeatureCollection documents, one document per file."""
    schema = f"features array<{feature_schema(properties)}>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")


def read_lines(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Features written one per line, the layout that splits over tasks."""
    schema = f"f {feature_schema(properties)}"
    rows = spark.read.text(path).select(F.from_json("value", schema.split(" ", 1)[1]).alias("f"))
    return rows.select("f.properties.*", "f.geometry")


def points() -> Column:
    """All positions of a polygon or multipolygon as one flat array."""
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(text, POLYGON)).when(
        kind == "MultiPolygon", F.flatten(F.from_json(text, MULTIPOLYGON))
    )
    return F.flatten(rings)


def bounds(features: DataFrame) -> DataFrame:
    """Smallest box of each feature; NULL without a geometry."""
    with_points = features.withColumn("__p", points())

    def axis(i: int) -> Column:
        return F.transform("__p", lambda p: p[i])

    return with_points.select(
        *[c for c in features.columns if c != "geometry"],
        F.array_min(axis(0)).alias("min_lon"),
        F.array_min(axis(1)).alias("min_lat"),
        F.array_max(axis(0)).alias("max_lon"),
        F.array_max(axis(1)).alias("max_lat"),
    )


def extent(boxes: DataFrame) -> DataFrame:
    """One box around all features."""
    return boxes.agg(
        F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"),
        F.max("max_lat").alias("max_lat"),
    )


def overlaps(west: float, south: float, east: float, north: float) -> Column:
    """Box overlap, borders included."""
    return (
        (F.col("min_lon") <= east)
        & (F.col("max_lon") >= west)
        & (F.col("min_lat") <= north)
        & (F.col("max_lat") >= south)
    )


def layer(boxes: DataFrame, members: DataFrame, key: str, box: Sequence[float]) -> DataFrame:
    """Features of a subset inside a box."""
    return boxes.where(overlaps(*box)).join(members.select(key).distinct(), key, "left_semi")


def standard_properties(
    features: DataFrame, name: str, code: str, state: str, allowed: DataFrame | None = None
) -> DataFrame:
    """Names, keys and codes in one form; ``allowed`` marks an allow-list of keys."""
    out = features.select(
        format_code(F.col(code)).alias("cod_municipio"),
        F.trim(name).alias("municipio"),
        upper_key(F.col(name)).alias("municipio_norm"),
        F.col(state).alias("uf"),
        upper_key(F.col(state)).alias("uf_norm"),
    )
    if allowed is None:
        return out
    marks = allowed.select("municipio_norm").distinct().withColumn("na_lista", F.lit(True))
    return out.join(marks, "municipio_norm", "left").fillna(False, subset=["na_lista"])


def payload(features: DataFrame, code: str) -> DataFrame:
    """Rows to load into a geometry table: the code in one form, the shape as GeoJSON text, its box.

    ``geometria`` is NULL where a feature has no polygon with at least one position, so that a
    load with ``required`` code and shape skips and counts it.  White space in the coordinates
    does not count as a change.
    """
    numbers = F.regexp_replace("geometry.coordinates", r"\s", "")
    text = F.concat(F.lit('{"type":"'), F.col("geometry.type"), F.lit('","coordinates":'), numbers, F.lit("}"))
    boxes = bounds(features.withColumn("__text", text))
    return boxes.withColumn(
        "geometria", F.when(F.col("min_lon").isNotNull() & F.col("min_lat").isNotNull(), F.col("__text"))
    ).withColumn(code, F.when(F.trim(code) != "", format_code(F.col(code)))).drop("__text")


def geometry_coverage(shapes: DataFrame, facts: DataFrame, code: str) -> DataFrame:
    """Rows of :func:`payload` without a code or a shape, and how facts and usable shapes match."""
    told = shapes.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(F.col(code).isNull()).alias("without_code"),
        F.count_if(F.col("geometria").isNull()).alias("without_geometry"),
    )
    usable = shapes.where(F.col("geometria").isNotNull())
    # Both sides are one row.
    return told.join(F.broadcast(key_coverage(facts, usable, code)))
