"""Exact order statistics that never bring one unbounded group to one task.

Quantiles and dense ranks are usually computed by a per-group aggregate buffer or a
per-group sort; both put a hot group on a single task.  Here the rows are first reduced
to one row per (keys, value) and written once.  The number of rows written is an upper
bound for every group.  Below ``SMALL_ROWS`` a plain aggregate or window is safe and
fastest.  Above it the values are cut into ranges by splitters drawn from the data, the
counts per range (at most ``N_RANGES`` rows per group) locate the wanted positions, and
only single ranges are ever sorted.

The splitters come from the rows with the smallest hashes.  That sample has a fixed
size, and it is a function of the data alone, so a recomputed task or a second
evaluation of the subplan sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxora.session import counted_side, stage_counted

SMALL_ROWS = 1_000_000
N_RANGES = 128  # a power of two
SAMPLE_ROWS = 2048
NULL_SALTS = 256


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality on ``keys`` that also matches NULL with NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def _with_range(staged: DataFrame, value: str) -> DataFrame:
    """Add ``__range``: how many splitters lie below the value (monotone in the value)."""
    order = F.xxhash64(*[F.col(c) for c in staged.columns])
    sample = (
        staged.select(F.col(value).alias("v"), order.alias("h"))
        .orderBy("h", "v")
        .limit(SAMPLE_ROWS)
        .agg(F.sort_array(F.collect_list("v")).alias("vs"))
    )
    places = F.sequence(F.lit(1), F.lit(N_RANGES - 1))
    cuts = F.transform(
        places, lambda i: F.get("vs", F.floor(i * F.size("vs") / N_RANGES).cast("int"))
    )
    out = staged.withColumn("__cuts", sample.select(cuts).scalar()).withColumn(
        "__range", F.lit(0)
    )
    # Binary search in generated code, one halving per projection.
    step = N_RANGES // 2
    while step:
        above = F.get("__cuts", F.col("__range") + (step - 1)) < F.col(value)
        out = out.withColumn("__range", F.col("__range") + F.when(above, step).otherwise(0))
        step //= 2
    return out.drop("__cuts")


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> tuple[DataFrame, int]:
    """Staged (keys, __v, __n) of the non-NULL values, and how many rows that are."""
    count = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(count.cast("long").alias("__n"))
    )
    return stage_counted(counts, "value-counts")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
    small_rows: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per ``keys`` (NULL is a key of its own).

    ``probs`` maps output names to probabilities; ``weight`` names a count column when
    ``df`` is already aggregated.  NULL values are ignored.
    """
    counts, rows = value_counts(df, keys, value, weight)
    return quantiles_of_counts(counts, rows, keys, probs, small_rows)


Expand = Callable[[DataFrame, Sequence[str]], DataFrame]


def quantiles_of_counts(
    counts: DataFrame,
    rows: int,
    keys: Sequence[str],
    probs: dict[str, float],
    small_rows: int | None = None,
    expand: Expand | None = None,
    copies: int = 1,
) -> DataFrame:
    """:func:`exact_quantiles` of staged counts with ``rows`` rows.

    ``counts`` has one row per group and value: the group columns, ``__v`` and ``__n``.
    With ``expand`` the groups are finer than ``keys``: it turns a row into at most
    ``copies`` rows with the ``keys`` columns, keeping the named other columns.
    """
    keys = list(keys)
    if rows * copies <= (SMALL_ROWS if small_rows is None else small_rows):
        spread = expand(counts, ["__v", "__n"]) if expand else counts
        points = F.array(*[F.lit(float(p)) for p in probs.values()])
        found = spread.groupBy(*keys).agg(F.percentile("__v", points, F.col("__n")).alias("__q"))
        return found.select(
            *keys, *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(probs)]
        )
    return _quantiles_by_range(counts, keys, probs, expand)


def _quantiles_by_range(
    counts: DataFrame, keys: list[str], probs: dict[str, float], expand: Expand | None
) -> DataFrame:
    ranged = _with_range(counts, "__v")
    fine = [c for c in counts.columns if c not in ("__v", "__n")] if expand else keys
    cells = ranged.groupBy(*fine, "__range").agg(F.sum("__n").alias("__cell"))
    if expand:
        # Ranges depend on the value alone, so the small cells are spread, not the rows.
        cells = expand(cells, ["__range", "__cell"])
        cells = cells.groupBy(*keys, "__range").agg(F.sum("__cell").alias("__cell"))
        ranged = expand(ranged, ["__range", "__v", "__n"])
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *keys,
        "__range",
        "__cell",
        F.coalesce(F.sum("__cell").over(running), F.lit(0)).alias("__base"),
        F.sum("__cell").over(whole).alias("__total"),
    )

    def edge(p: float, up: bool) -> Column:
        place = (F.col("__total") - 1) * F.lit(float(p))
        return (F.ceil(place) if up else F.floor(place)).cast("long")

    wanted = F.array(*[edge(p, up) for p in probs.values() for up in (False, True)])
    targets = cells.where(
        F.exists(
            wanted,
            lambda k: (k >= F.col("__base")) & (k < F.col("__base") + F.col("__cell")),
        )
    ).drop("__cell")

    # Rows outside the wanted ranges are dropped before anything is shuffled again.
    inside = join_null_safe(ranged, counted_side(targets, "ranges"), [*keys, "__range"], "inner")
    before = (
        Window.partitionBy(*keys, "__range")
        .orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = inside.withColumn(
        "__before", F.col("__base") + F.coalesce(F.sum("__n").over(before), F.lit(0))
    )

    def at(p: float, up: bool) -> Column:
        k = edge(p, up)
        here = (k >= F.col("__before")) & (k < F.col("__before") + F.col("__n"))
        return F.max(F.when(here, F.col("__v")))

    found = inside.groupBy(*keys).agg(
        F.max("__total").alias("__total"),
        *[
            at(p, up).alias(f"__{'hi' if up else 'lo'}_{name}")
            for name, p in probs.items()
            for up in (False, True)
        ],
    )

    def between(name: str, p: float) -> Column:
        # The weighted form of the built-in percentile, so both paths give the same bits.
        place = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        mixed = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low == high, low).otherwise(mixed)

    return found.select(*keys, *[between(n, p).alias(n) for n, p in probs.items()])


def dense_rank_desc(
    df: DataFrame, keys: Sequence[str], score: str, name: str, small_rows: int | None = None
) -> DataFrame:
    """Add the dense descending rank of ``score`` within ``keys``; NULL stays NULL.

    Ties share a rank because only distinct scores are ranked and joined back.
    """
    keys = list(keys)
    distinct, rows = stage_counted(
        df.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("__v")).distinct(),
        "distinct-scores",
    )
    if rows <= (SMALL_ROWS if small_rows is None else small_rows):
        order = Window.partitionBy(*keys).orderBy(F.desc("__v"))
        ranked = distinct.withColumn(name, F.row_number().over(order).cast("long"))
    else:
        ranked = _ranks_by_range(distinct, keys, name)
    ranks = ranked.select(
        *keys,
        F.col("__v").alias(score),
        name,
        F.when(F.col("__v").isNull(), 1).otherwise(0).cast("long").alias("__salt"),
    )
    # Rows without a score match nothing; the salt keeps them from meeting in one task.
    hashed = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(NULL_SALTS)) + 1
    salted = df.withColumn("__salt", F.when(F.col(score).isNull(), salt).otherwise(F.lit(0)).cast("long"))
    return join_null_safe(salted, ranks, [*keys, score, "__salt"], "left").drop("__salt")


def _ranks_by_range(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    ranged = _with_range(distinct, "__v")
    cells = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__cell"))
    above = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("__range"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = cells.select(
        *keys, "__range", F.coalesce(F.sum("__cell").over(above), F.lit(0)).alias("__base")
    )
    local = Window.partitionBy(*keys, "__range").orderBy(F.desc("__v"))
    return join_null_safe(ranged, counted_side(cells, "ranges"), [*keys, "__range"], "inner").withColumn(
        name, (F.col("__base") + F.row_number().over(local)).cast("long")
    )


def rank_where(
    df: DataFrame, keys: Sequence[str], score: str, eligible: Column, name: str
) -> DataFrame:
    """Dense descending rank among eligible rows only; other rows get NULL."""
    masked = df.withColumn("__score", F.when(eligible, F.col(score)))
    return dense_rank_desc(masked, keys, "__score", name).drop("__score")
