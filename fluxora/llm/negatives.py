"""Hard-negative mining with angular triangle filtering (operator 11).

Vectors become integers floor(256 * x) and a score is an integer inner product.  For every
row the angles to a few reference directions are computed once and stored with its norm.  The
angle between an anchor and a row lies between the largest difference and the smallest sum of
their angles to one reference; its cosine times both norms, widened by more than all rounding
errors, bounds the score from both sides.  Only rows whose interval meets what is still wanted
are scored in integers:

* positives: rows of the anchor's label in the order of their upper bounds, until the bound
  falls below the k-th score;
* negatives: rows of other labels whose interval meets the window of some positive, in the
  order of their upper bounds, until every window is full with better scores.

References are the mean directions of the ``references`` labels with most rows (every vector
counts), orthonormal seeded directions where there are fewer; they decide how much is
filtered, never what is found.

Anchors are cut into blocks and rows into shards, both of bounded size; a (block, shard) cell
is one group, so each row is sent once per block of anchors.  Shards go by row, not by id or
label, so a label, an id or a vector that a third of all rows share fills no cell.  A cell
returns at most k rows for each anchor or window, and the best of all cells are ranked.

Rows with a null id, label or vector or with a null or non-finite component take no part.
Vectors of unequal length are compared as if the shorter ended in zeros.  Rows that repeat an
id are candidates each, and never those of an anchor with that id; the anchor of an id is its
largest (vector, label).  Ties go to the smaller ``vec_id``.  A score that 64 bits cannot hold
is an error.  Empty tables give no rows, other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxora.llm.common import map_rows, staged
from fluxora.llm.topk import matrix, spread_over


@dataclass(frozen=True)
class Mining:
    """What is mined (scale, anchors, counts, window in percent) and the sizes of the cells."""

    scale: int = 256
    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    references: int = 12
    shard_rows: int = 8192
    block_rows: int = 4096


def labelled(vectors: DataFrame, config: Mining) -> DataFrame:
    """row, vec_id, label and v (whole numbers) of every row that takes part, staged."""
    x = F.transform(F.col("`embedding`"), lambda c: c.cast("double"))
    sound = F.forall(
        "x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    label = F.col("`label`").cast("long")
    rows = vectors.select(
        F.col("`vec_id`").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(sound)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return staged(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "vec_id", shifted.alias("label"),
            F.transform("x", lambda c: F.floor(c * config.scale)).alias("v"),
        ),
        "vectors",
    )


def directions(rows: DataFrame, width: int, config: Mining) -> np.ndarray:
    """Unit vectors, one a row: mean directions of the largest labels, then seeded ones."""
    largest = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # At most ``references`` labels and one sum a label and task leave the tasks.
    labels = [
        r["label"] for r in largest.orderBy(F.desc("n"), "label").limit(config.references).collect()
    ]

    def make():
        sums = {label: np.zeros(width) for label in labels}

        def work(batch: pa.RecordBatch) -> list[dict]:
            data = matrix(batch.column("v").to_pylist(), width).astype(float)
            own = np.array(batch.column("label").to_pylist())
            for label in sums:
                sums[label] += data[own == label].sum(axis=0)
            return []

        work.rest = lambda: iter([[{"label": k, "v": v.tolist()} for k, v in sums.items()]])
        return work

    found = map_rows(rows.select("label", "v"), make, "label long, v array<double>")
    means = {label: np.zeros(width) for label in labels}
    summed = found.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at")
    for r in summed.agg(F.sum("x").alias("x")).collect():
        means[r["label"]][r["at"]] = r["x"]
    units = [m / np.linalg.norm(m) for m in means.values() if np.linalg.norm(m) > 0]
    seeded = np.linalg.qr(np.random.default_rng(11).normal(size=(width, width)))[0] if width else []
    chosen = [*units, *seeded][: config.references]
    return np.array(chosen, float).reshape(len(chosen), width)


def angles_to(data: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references (one column each; zero vectors: a right angle)."""
    norms = np.sqrt((data * data).sum(axis=1))
    cosines = (data @ references.T) / np.maximum(norms, 1e-300)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1))


def with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Every row with its norm and its angles to the references, staged."""
    width = references.shape[1]

    def make():
        def work(batch: pa.RecordBatch) -> list[dict]:
            data = matrix(batch.column("v").to_pylist(), width).astype(float)
            norms, angles = angles_to(data, references)
            columns = (batch.column(c).to_pylist() for c in ("row", "vec_id", "label", "v"))
            return [
                {"row": r, "vec_id": i, "label": c, "v": v, "norm": n, "angles": a}
                for r, i, c, v, n, a in zip(*columns, norms.tolist(), angles.tolist())
            ]

        return work

    return staged(map_rows(rows, make, f"row long, {POINT}"), "angles")


POINT = "vec_id long, label long, v array<long>, norm double, angles array<double>"
POINT_COLUMNS = ["vec_id", "label", "v", "norm", "angles"]
# Angles near 0 and 180 degrees are off by up to 4e-7 (arc cosine of a cosine off by 1e-13).
ROUNDING = 4e-6


@dataclass
class Points:
    """The rows of one side of a cell as arrays."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, frame: pd.DataFrame, width: int) -> Points:
        return cls(
            frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64),
            matrix(frame["v"].tolist(), width), frame["norm"].to_numpy(float),
            np.array(frame["angles"].tolist(), float).reshape(len(frame), -1),
        )

    def part(self, at: slice) -> Points:
        return Points(self.ids[at], self.labels[at], self.rows[at], self.norms[at], self.angles[at])


def score_bounds(anchors: Points, rows: Points) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the score of every anchor (first axis) with every row."""
    least = np.zeros((len(anchors.ids), len(rows.ids)))
    most = np.full_like(least, np.pi)
    for j in range(anchors.angles.shape[1]):
        a, b = anchors.angles[:, j, None], rows.angles[None, :, j]
        np.maximum(least, np.abs(a - b), out=least)
        both = a + b
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    norms = anchors.norms[:, None] * rows.norms[None, :]
    slack = norms * ROUNDING + 1
    return norms * np.cos(most) - slack, norms * np.cos(least) + slack


def scores_of(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; sums below 2**52 are exact in doubles."""
    if exact:
        return np.rint(rows.astype(float) @ anchor.astype(float)).astype(np.int64)
    return rows.astype(object) @ anchor.astype(object)


def first_rows(
    rows: Points, anchor: np.ndarray, upper: np.ndarray, exact: bool, among: np.ndarray, k: int
) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of the places ``among``, best first."""
    order = among[np.argsort(-upper[among], kind="stable")]
    best: list[tuple[int, int]] = []
    at, size = 0, 64
    while at < len(order) and (len(best) < k or upper[order[at]] >= best[-1][0]):
        take = order[at : at + size]
        found = zip(scores_of(rows.rows[take], anchor, exact).tolist(), rows.ids[take].tolist())
        best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
        at, size = at + size, min(4096, 2 * size)
    return best


def in_windows(
    rows: Points, anchor: np.ndarray, lower: np.ndarray, upper: np.ndarray, exact: bool,
    others: np.ndarray, aims: list[int], config: Mining,
) -> list[list[tuple[int, int]]]:
    """For each positive score the best (score, vec_id) in its window, best first."""
    meets = np.zeros(len(upper), bool)
    for p in aims:
        meets |= (100 * upper >= config.low * p) & (100 * lower <= config.high * p)
    order = np.flatnonzero(meets & others)
    order = order[np.argsort(-upper[order], kind="stable")]
    best: list[list[tuple[int, int]]] = [[] for _ in aims]
    k, at, size = config.negatives, 0, 256
    while at < len(order):
        bound = upper[order[at]]
        if all(len(b) == k and bound < b[-1][0] or 100 * bound < config.low * p for b, p in zip(best, aims)):
            break
        take = order[at : at + size]
        scores, ids = scores_of(rows.rows[take], anchor, exact), rows.ids[take]
        for n, p in enumerate(aims):
            inside = np.flatnonzero(
                ((config.low * p <= 100 * scores) & (100 * scores <= config.high * p)).astype(bool)
            )
            if len(inside):
                found = zip(scores[inside].tolist(), ids[inside].tolist())
                best[n] = sorted([*best[n], *found], key=lambda x: (-x[0], x[1]))[:k]
        at, size = at + size, min(4096, 2 * size)
    return best


def searched(cell: pd.DataFrame, config: Mining) -> Iterator[tuple[int, int, int, int]]:
    """(anchor_id, place, vec_id, score); place 0 is a positive, others a window's number."""
    asks = cell["asks"].to_numpy(bool)
    if asks.all() or not asks.any():
        return
    width = max(len(v) for v in cell["v"])
    anchors, rows = Points.of(cell[asks], width), Points.of(cell[~asks], width)
    aims = cell["aims"][asks].tolist()
    largest = int(np.abs(anchors.rows).max(initial=0)) * int(np.abs(rows.rows).max(initial=0))
    exact = largest * width < 1 << 52
    for at in range(0, len(anchors.ids), 64):
        part = anchors.part(slice(at, at + 64))
        lower, upper = score_bounds(part, rows)
        for i, own in enumerate(part.ids.tolist()):
            other = rows.ids != own
            same = rows.labels == part.labels[i]
            args = rows, part.rows[i]
            wanted = aims[at + i]
            if wanted is None:
                among = np.flatnonzero(same & other)
                for score, vec_id in first_rows(*args, upper[i], exact, among, config.positives):
                    yield own, 0, vec_id, score
                continue
            windows = in_windows(
                *args, lower[i], upper[i], exact, ~same, [int(p) for p in wanted], config
            )
            for n, found in enumerate(windows):
                for score, vec_id in found:
                    yield own, n + 1, vec_id, score


def search(points: DataFrame, anchors: DataFrame, config: Mining, total: int) -> DataFrame:
    """anchor_id, place, vec_id and score of the best rows of every cell.

    ``anchors`` have ``aims``: null where positives are wanted, else the positives' scores.
    """
    shards = max(1, -(-total // config.shard_rows))
    blocks = max(1, -(-total // (config.every * config.block_rows)))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    block = spread_over(F.col("vec_id"), blocks)
    asked = anchors.select(
        *POINT_COLUMNS, "aims", F.lit(True).alias("asks"),
        block.alias("block"), F.explode(numbers(shards)).alias("shard"),
    )
    held = points.select(
        *POINT_COLUMNS, F.lit(None).cast("array<long>").alias("aims"), F.lit(False).alias("asks"),
        F.explode(numbers(blocks)).alias("block"), spread_over(F.col("row"), shards).alias("shard"),
    )

    def work(cell: pd.DataFrame) -> pd.DataFrame:
        found = list(searched(cell, config))
        return pd.DataFrame(found, columns=["anchor_id", "place", "vec_id", "score"]).astype("int64")

    return held.unionByName(asked).groupBy("block", "shard").applyInPandas(
        work, "anchor_id long, place long, vec_id long, score long"
    )


def hard_negatives(vectors: DataFrame, config: Mining | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, as the module describes."""
    config = config or Mining()
    rows = labelled(vectors, config)
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    points = with_angles(rows, directions(rows, width or 0, config))
    names = F.struct("v", "label", "norm", "angles")
    anchors = staged(
        points.filter(F.col("vec_id") % config.every == 0)
        .groupBy("vec_id").agg(F.max(names).alias("own")).select("vec_id", "own.*"),
        "anchors",
    )
    nothing = F.lit(None).cast("array<long>")
    found = search(points, anchors.withColumn("aims", nothing), config, total)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = staged(
        found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= config.positives),
        "positives",
    )
    aims = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda x: x["score"]).alias("aims")
    )
    found = search(points, anchors.join(aims, "vec_id"), config, total)
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    negatives = found.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= config.negatives
    )
    named = positives.select(
        "anchor_id", F.col("nth").cast("long").alias("place"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return negatives.join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score,
    s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
  WHERE nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
