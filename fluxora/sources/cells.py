"""Layers of boxes stored by cell, so that a box query opens only the folders near it.

The world is halved in both axes ``level`` times.  A box belongs to the cell that holds its lower
left corner, on the finest level whose cells are at least as wide and as high as the box; so it
lies within that cell and its neighbours above and to the right, and a small box never moves up
only because it stands across a border.  Cells of a level are numbered along the Z-order.

The folder of a row is its cell, rows are sorted by range of (cell, fine Z-order of the corner):
a crowded cell becomes many files, each with narrow column statistics, and near cells share a task.
A query names the cells its box can touch, at most ``(4^(levels+1) - 1) / 3`` numbers.

Boxes with a NULL or NaN side have no cell (-1) and no box query reads them.  Boxes and queries
beyond the world's borders count to the cells along the border.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxora.sources.geo import overlaps

CELL = "celula"
WORLD = (-180.0, -90.0, 360.0, 180.0)  # west, south, width, height
LEVELS = 5
FINE = 24  # bits an axis of the order within a cell
SIDES = ("min_lon", "min_lat", "max_lon", "max_lat")


def first_of(level: int) -> int:
    """Number of the first cell of a level: those of all coarser levels come before."""
    return (4**level - 1) // 3


def z_order(x: Column, y: Column, bits: int) -> Column:
    """The bits of two numbers in turn."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for at, axis in enumerate((x, y)):
            bit = F.shiftright(axis, b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, 2 * b + at))
    return out


def _z_number(x: int, y: int, bits: int) -> int:
    return sum(((x >> b & 1) << 2 * b) + ((y >> b & 1) << 2 * b + 1) for b in range(bits))


def steps(value: Column, low: float, width: float, level: int) -> Column:
    """Index of the cell along one axis, kept within the world."""
    at = F.floor((value - F.lit(low)) * F.lit(2**level / width))
    return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(2**level - 1).cast("long"))


def cell_of(levels: int = LEVELS) -> Column:
    """Cell of the box in the four side columns."""
    west, south, wide, high = WORLD
    sides = [F.col(c) for c in SIDES]
    missing = F.lit(False)
    for side in sides:
        missing = missing | side.isNull() | F.isnan(side)
    cell = F.lit(0)
    for level in range(1, levels + 1):
        part = 2**level
        fits = (sides[2] - sides[0] <= wide / part) & (sides[3] - sides[1] <= high / part)
        z = z_order(steps(sides[0], west, wide, level), steps(sides[1], south, high, level), level)
        cell = F.when(fits, (z + first_of(level)).cast("int")).otherwise(cell)
    return F.when(missing, -1).otherwise(cell)


def cells_near(box: Sequence[float], levels: int = LEVELS) -> list[int]:
    """Cells that may hold a box overlapping ``box`` (west, south, east, north)."""
    west, south, wide, high = WORLD
    found = [0]

    def reach(low: float, upper: float, start: float, width: float, level: int) -> range:
        size = width / 2**level
        # A box reaches at most one cell's size up; the margin covers rounding.
        ends = (low - size * (1 + 1e-9), upper)
        last = 2**level - 1
        a, b = (min(max(math.floor(min(max((e - start) / size, -1), last + 1)), 0), last) for e in ends)
        return range(a, b + 1)

    for level in range(1, levels + 1):
        for x in reach(box[0], box[2], west, wide, level):
            for y in reach(box[1], box[3], south, high, level):
                found.append(first_of(level) + _z_number(x, y, level))
    return found


def write_boxes(boxes: DataFrame, path: str, levels: int = LEVELS) -> None:
    """Replace the layer at ``path``."""
    west, south, wide, high = WORLD
    fine = z_order(steps(F.col("min_lon"), west, wide, FINE), steps(F.col("min_lat"), south, high, FINE), FINE)
    placed = boxes.withColumn(CELL, cell_of(levels)).withColumn("__z", fine)
    # Ranges, not hashes: a cell with many rows is split into neighbouring pieces.
    placed = placed.repartitionByRange(CELL, "__z").sortWithinPartitions(CELL, "__z").drop("__z")
    placed.write.mode("overwrite").partitionBy(CELL).parquet(path)


def near(
    spark: SparkSession, path: str, schema: T.StructType, box: Sequence[float], levels: int = LEVELS
) -> DataFrame:
    """Rows of the folders that a box query opens; ``levels`` as the layer was written."""
    stored = T.StructType([*schema.fields, T.StructField(CELL, T.IntegerType())])
    return spark.read.schema(stored).parquet(path).where(F.col(CELL).isin(cells_near(box, levels)))


def in_box(
    spark: SparkSession, path: str, schema: T.StructType, box: Sequence[float], levels: int = LEVELS
) -> DataFrame:
    """Rows whose box overlaps ``box``, borders included: as :func:`geo.overlaps` over all rows."""
    return near(spark, path, schema, box, levels).where(overlaps(*box)).drop(CELL)
