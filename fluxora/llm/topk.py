"""Exact top-k search by the threshold algorithm over sorted per-dimension lists (operator 1).

Vectors become integers floor(64 * x).  Candidates are dealt by their id into shards of
bounded size; queries are cut into blocks of bounded size, and every (block, shard) cell is
one group.  Inside a cell each dimension has a sorted list, read from its high end for a
query's positive components and from its low end for negative ones.  Rows are taken in the
order of the depth at which some list first shows them; after each depth the bound (the sum
of the query's components times the values at that depth) caps what unseen rows can score,
and a query leaves the cell once the bound is below its k-th score.  All sums are exact.

Cells return at most k rows per query; the merge is one grouped top-k.  A cell's size does
not depend on how often a vector repeats.  Ties go to the smaller ``vec_id`` at every step.

Rows with a null id, a null vector or null or non-finite components take no part.  Of
several vectors with one id the largest (as Spark orders arrays) counts.  Vectors of
unequal length are compared as if the shorter ended in zeros.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one integer vector per id that may take part."""
    x = F.transform(F.col("`embedding`"), lambda c: c.cast("double"))
    sound = F.forall(
        "x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return (
        vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
        .groupBy("vec_id")
        .agg(F.max("x").alias("x"))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))
    )


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def search_plainly(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Every score in Python integers: for components too large for exact machine sums."""
    data = rows.astype(object)
    for own, q in zip(query_ids, queries.astype(object)):
        scores = data @ q
        picked = [j for j in range(len(ids)) if ids[j] != own]
        picked = sorted(picked, key=lambda j: (-scores[j], ids[j]))[:k]
        yield int(own), ids[picked], np.array([int(scores[j]) for j in picked], dtype=np.int64)


def threshold_search(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vec_ids, scores) of the k best rows of each query, best first."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    n, dims = rows.shape
    # A score and a row's place in the id order share one integer: larger is better, and
    # among equal scores the smaller id.
    span = 1 << int(n).bit_length()
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * dims
    if largest * span >= 1 << 61 or largest >= 1 << 52:
        yield from search_plainly(query_ids, queries, ids, rows, k)
        return
    lists = np.argsort(rows, axis=0, kind="stable")
    rising = np.take_along_axis(rows, lists, axis=0).astype(float)
    falling = rising[::-1]
    ranks = np.empty_like(lists)
    np.put_along_axis(ranks, lists, np.arange(n)[:, None], axis=0)
    # Depth at which either end of some list first shows a row.
    depth = np.minimum(ranks, n - 1 - ranks).min(axis=1, initial=n - 1)
    by_depth = np.argsort(depth, kind="stable")
    reach = depth[by_depth]
    q, data = queries.astype(float), rows.astype(float)  # sums below 2**52 are exact
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low = np.iinfo(np.int64).min
    best = np.full((len(q), k), low, dtype=np.int64)
    active = np.arange(len(q))
    seen, level = 0, 1
    while seen < n and len(active):
        stop = int(np.searchsorted(reach, level, side="left"))
        while seen < stop:
            take = by_depth[seen : min(stop, seen + 1024)]
            scores = np.rint(q[active] @ data[take].T).astype(np.int64)
            keys = scores * span + (span - 1 - take)
            keys[query_ids[active][:, None] == ids[take][None, :]] = low
            joined = np.concatenate([best[active], keys], axis=1)
            best[active] = np.partition(joined, joined.shape[1] - k, axis=1)[:, -k:]
            seen += len(take)
        if seen < n:
            # Unseen rows lie at depth ``level`` or deeper in every list.
            bound = np.rint(up[active] @ falling[level] + down[active] @ rising[level])
            worst = best[active].min(axis=1)
            active = active[(worst == low) | (bound.astype(np.int64) >= worst // span)]
        level *= 2
    for i in range(len(q)):
        keys = np.sort(best[i][best[i] != low])[::-1]
        yield int(query_ids[i]), ids[span - 1 - keys % span], keys // span


def spread_over(column: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    shard_rows: int = 8192,
    block_rows: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every id divisible by ``every``."""
    data = integers(vectors)
    total = data.count()
    shards = max(1, -(-total // shard_rows))
    blocks = max(1, -(-total // (every * block_rows)))
    is_query = F.col("vec_id") % every == 0
    # One pass: a row goes to its shard's cell of each block, a query to each shard too.
    shard, block = spread_over(F.col("vec_id"), shards), spread_over(F.col("vec_id"), blocks)
    everyone = F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda b: F.struct(b.alias("block"), shard.alias("shard"), F.lit(False).alias("asks")),
    )
    asked = F.when(
        is_query,
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.struct(block.alias("block"), s.alias("shard"), F.lit(True).alias("asks")),
        ),
    ).otherwise(F.slice(everyone, 1, 0))
    cells = data.select("vec_id", "v", F.explode(F.concat(everyone, asked)).alias("cell")).select(
        "vec_id", "v", "cell.*"
    )

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        width = max((len(v) for v in cell["v"]), default=0)
        asks = cell["asks"].to_numpy()
        queries, rows = cell[asks], cell[~asks]
        out = [
            pd.DataFrame({"query_id": q, "vec_id": found, "score": scores})
            for q, found, scores in threshold_search(
                queries["vec_id"].to_numpy(),
                matrix(queries["v"], width),
                rows["vec_id"].to_numpy(),
                matrix(rows["v"], width),
                k,
            )
        ] if len(queries) and len(rows) else []
        return pd.concat(out) if out else pd.DataFrame(
            {c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")}
        )

    found = cells.groupBy("block", "shard").applyInPandas(
        search, "query_id long, vec_id long, score long"
    )
    # Spark cuts the ranks in each task first, so a query never gathers all its shards' rows.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, max([floor(64 * x::DOUBLE) for x in embedding]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
