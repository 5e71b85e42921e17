"""Scores, classes, top lists, pages and period comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxora.functions.numbers import finite, ratio
from fluxora.operators.order_stats import _with_range, exact_quantiles, join_null_safe

# Class labels from lowest to highest (fixed values).
CLASS_LABELS = ("Muito baixo", "Baixo", "Médio", "Alto", "Muito alto")
CLASS_MISSING = "Sem movimentação migratória suficiente"
PAGE_LIMIT = 2000


def with_stats(df: DataFrame, period: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach aggregates of a whole period to each of its rows.

    The aggregates are one row per calendar period (or one row in all), which is what
    makes the broadcast safe; a window over the period would gather it in one task.
    """
    period = list(period)
    named = [c.alias(n) for n, c in aggs.items()]
    if not period:
        packed = df.agg(*named).select(F.struct(*aggs).alias("__r")).scalar()
        return df.withColumn("__r", packed).select(*df.columns, "__r.*")
    stats = df.groupBy(*period).agg(*named)
    return join_null_safe(df, F.broadcast(stats), period, "left")


def _nearly_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.abs(b) * 1e-5 + 1e-8


def minmax_score(df: DataFrame, period: Sequence[str], score: str, name: str) -> DataFrame:
    """0-100 position between minimum and maximum; 50 where they (nearly) coincide."""
    out = with_stats(df, period, __lo=F.min(score), __hi=F.max(score))
    low, high = F.col("__lo"), F.col("__hi")
    value = F.when(_nearly_equal(low, high), F.lit(50.0)).otherwise(
        (F.col(score) - low) / F.nullif(high - low, F.lit(0.0)) * 100.0
    )
    return out.withColumn(name, F.when(F.col(score).isNotNull(), value)).drop("__lo", "__hi")


def zscore(df: DataFrame, period: Sequence[str], value: str, name: str) -> DataFrame:
    """Standard score with the sample deviation; 0 where the deviation is 0 or missing."""
    out = with_stats(df, period, __m=F.avg(value), __sd=F.stddev_samp(value))
    flat = F.col("__sd").isNull() | (F.col("__sd") == 0)
    scaled = (F.col(value) - F.col("__m")) / F.nullif(F.col("__sd"), F.lit(0.0))
    return out.withColumn(name, F.when(flat, 0.0).otherwise(scaled)).drop("__m", "__sd")


def impute_median(df: DataFrame, period: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill missing values with the median of the period; 0 where all are missing."""
    period = list(period)
    tall = df.select(*period, *[F.col(c).cast("double").alias(c) for c in columns])
    tall = tall.unpivot(period, list(columns), "__var", "__val")
    medians = exact_quantiles(tall, [*period, "__var"], "__val", {"__med": 0.5})
    wide = medians.groupBy(*period).agg(
        *[F.max(F.when(F.col("__var") == c, F.col("__med"))).alias(f"__med_{c}") for c in columns]
    )
    # Size bound: one row per calendar period.
    joined = join_null_safe(df, F.broadcast(wide), period, "left")
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.col(f"__med_{c}"), F.lit(0.0)) for c in columns
    }
    return joined.withColumns(filled).drop(*[f"__med_{c}" for c in columns])


def quantile_classes(df: DataFrame, period: Sequence[str], score: str, name: str) -> DataFrame:
    """Five empirical quantile classes, right-closed; fewer valid rows give fewer classes.

    Equal edges collapse and the labels are taken from the low end; one single value
    means the middle label; a missing score gets its own label.
    """
    period = list(period)
    grids = {q: [i / q for i in range(q + 1)] for q in (2, 3, 4, 5)}
    points = sorted({p for grid in grids.values() for p in grid})
    column = {p: f"__q{i}" for i, p in enumerate(points)}
    edges = exact_quantiles(df, period, score, {column[p]: p for p in points})
    counts = df.groupBy(*period).agg(F.count(score).alias("__valid"))
    if period:
        edges = join_null_safe(counts, edges, period, "left")
        # Size bound: one row per calendar period.
        joined = join_null_safe(df, F.broadcast(edges), period, "left")
    else:
        packed = edges.select(F.struct(*column.values()).alias("__e")).scalar()
        valid = counts.scalar()
        joined = df.withColumn("__e", packed).withColumn("__valid", valid)
        joined = joined.select(*df.columns, "__valid", "__e.*")

    def grid(q: int) -> Column:
        return F.array_distinct(F.array(*[F.col(column[p]) for p in grids[q]]))

    chosen = F.when(F.col("__valid") >= 5, grid(5))
    for q in (4, 3):
        chosen = chosen.when(F.col("__valid") == q, grid(q))
    chosen = chosen.otherwise(grid(2))
    below = F.size(F.filter(chosen, lambda e: e < F.col(score)))
    labels = F.array(*[F.lit(x) for x in CLASS_LABELS])
    single = F.col(column[0.0]) == F.col(column[1.0])
    label = F.when(single, CLASS_LABELS[2]).otherwise(
        F.element_at(labels, F.greatest(below, F.lit(1)))
    )
    return joined.select(
        *df.columns, F.when(F.col(score).isNotNull(), label).otherwise(CLASS_MISSING).alias(name)
    )


def page(
    df: DataFrame,
    limit: int,
    offset: int = 0,
    sort_by: str | None = None,
    descending: bool = True,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """One page with the total row count; NULLs last, ties in ``tiebreak`` order."""
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be 1..{PAGE_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    order = [F.asc_nulls_last(c) for c in tiebreak]
    if sort_by is not None:
        if sort_by not in df.columns:
            raise ValueError(f"unknown sort column: {sort_by}")
        first = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
        order = [first, *order]
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def deep_page(
    df: DataFrame,
    limit: int,
    offset: int,
    sort_by: str,
    descending: bool = True,
    tiebreak: Sequence[str] = (),
    leaf: int = 100_000,
) -> DataFrame:
    """:func:`page` at any depth: the rows before the page are counted, not sorted.

    The sort key is cut into ranges by splitters drawn from the data.  Their counts (a row per
    range) tell which ranges hold the page; only their rows are read again, by a filter on the
    key that reaches the scan, and cut further until at most ``leaf`` rows are left to sort.  A
    value with more rows than that is cut by the next column of the order.  Every pass narrows
    the rows some hundredfold, and only the page itself is ever collected into an order.
    """
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be 1..{PAGE_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    unknown = [c for c in (sort_by, *tiebreak) if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown sort column: {unknown[0]}")
    keys = [(sort_by, descending), *[(c, False) for c in tiebreak]]
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]
    total = df.count()

    def parts(rows: DataFrame, n: int, begin: int, end: int, at: int) -> list[DataFrame]:
        """The rows at the places ``begin`` to ``end`` of ``n``, which agree before key ``at``."""
        if begin >= end:
            return []
        if n <= leaf or at == len(keys):
            return [rows.orderBy(*order).offset(begin).limit(end - begin)]
        hit, base = [], 0
        for inside, single, size in _key_ranges(rows, keys[at:], n):
            if base < end and base + size > begin:
                hit.append((inside, single, size, base))
            base += size
        if sum(size for _, _, size, _ in hit) <= leaf:
            first = hit[0][3]
            some = rows.where(reduce(lambda a, b: a | b, [inside for inside, *_ in hit]))
            return [some.orderBy(*order).offset(begin - first).limit(end - begin)]
        out = []
        for inside, single, size, before in hit:
            places = max(begin - before, 0), min(end - before, size)
            out += parts(rows.where(inside), size, *places, at + single)
        return out

    found = parts(df, total, offset, min(offset + limit, total), 0) or [df.limit(0)]
    rows = reduce(lambda a, b: a.unionByName(b), found)
    return rows.orderBy(*order).withColumn("total", F.lit(total).cast("long"))


def _key_ranges(
    rows: DataFrame, keys: Sequence[tuple[str, bool]], n: int
) -> list[tuple[Column, bool, int]]:
    """(condition, whether it is one value, rows) of every range of the first key, in order.

    NULL comes last.  The other keys only mix the sample that the splitters come from.
    """
    column, down = keys[0]
    value = F.col(column)
    key = rows.select(value.alias("__v"), *[F.col(c).alias(f"__{i}") for i, (c, _) in enumerate(keys)])
    told = (F.min("__v").alias("low"), F.max("__v").alias("high"), F.count(F.lit(1)).alias("n"))
    cells = _with_range(key.where(F.col("__v").isNotNull()), "__v").groupBy("__range").agg(*told).collect()
    nulls = n - sum(r["n"] for r in cells)
    out = []
    for r in sorted(cells, key=lambda r: r["__range"]):
        low, high = F.lit(r["low"]), F.lit(r["high"])
        if r["low"] == r["high"]:
            out.append((value == low, True, r["n"]))
        elif r["n"] < n:
            out.append((value.between(low, high), False, r["n"]))
        else:
            # No splitter lies inside: a value with nearly all rows.  Its ends go apart.
            ends = rows.agg(F.count_if(value == low), F.count_if(value == high)).first()
            out.append((value == low, True, ends[0]))
            out.append(((value > low) & (value < high), False, r["n"] - sum(ends)))
            out.append((value == high, True, ends[1]))
    return (out[::-1] if down else out) + ([(value.isNull(), True, nulls)] if nulls else [])


def top_k(
    df: DataFrame,
    k: int,
    metric: str = "saldo",
    fallback: str = "saldo",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The k greatest rows by ``metric``, or by ``fallback`` where it does not exist."""
    chosen = metric if metric in df.columns else fallback
    order = [F.desc_nulls_last(chosen), *[F.asc_nulls_last(c) for c in tiebreak]]
    return df.orderBy(*order).limit(k)


def top_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "pos"
) -> DataFrame:
    """First k rows per key.  Spark limits each task to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def top_bottom(
    df: DataFrame, keys: Sequence[str], rank: str, tiebreak: Sequence[str], k: int = 10
) -> DataFrame:
    """First k and last k rows by rank within each key; the last ones in reverse order."""
    ranked = df.where(F.col(rank).isNotNull())
    low = [F.asc(rank), *[F.asc(c) for c in tiebreak]]
    high = [F.desc(rank), *[F.desc(c) for c in tiebreak]]
    first = top_within(ranked, keys, low, k).withColumn("lista", F.lit("top"))
    last = top_within(ranked, keys, high, k).withColumn("lista", F.lit("bottom"))
    return first.unionByName(last)


def top_abs(df: DataFrame, metric: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """Largest magnitudes with their sign; zero and missing values are left out."""
    sized = df.withColumn("valor", F.abs(finite(F.col(metric)))).where(F.col("valor") > 0)
    return sized.orderBy(F.desc("valor"), *[F.asc(c) for c in tiebreak]).limit(k)


def period_pairs(periods: DataFrame, period: str) -> DataFrame:
    """Each distinct period with the one before it.

    The window sees one row per calendar period, never the facts.
    """
    window = Window.orderBy(period)
    return periods.select(period).distinct().withColumn("anterior", F.lag(period).over(window))


def period_delta(
    values: DataFrame, pairs: DataFrame, label: str, period: str, value: str
) -> DataFrame:
    """Change of ``value`` per label against the previous available period (inner join).

    ``pairs`` has one row per calendar period, so it is broadcast; the self-join runs on
    (label, period), which spreads any single hot period over all labels.
    """
    usable = values.where(F.col(label).isNotNull() & (F.col(label) != "")).select(
        label, period, finite(F.col(value)).alias("atual")
    )
    usable = usable.where(F.col("atual").isNotNull())
    before = usable.select(
        label, F.col(period).alias("anterior"), F.col("atual").alias("previo")
    )
    current = usable.join(F.broadcast(pairs), period)
    joined = current.join(before, [label, "anterior"])
    delta = F.col("atual") - F.col("previo")
    return joined.select(
        label,
        period,
        "anterior",
        "previo",
        "atual",
        delta.alias("delta"),
        (ratio(delta, F.col("previo")) * 100.0).alias("delta_pct"),
    )


def largest_changes(delta: DataFrame, label: str, period: str, k: int = 8) -> DataFrame:
    """The k largest drops and the k largest gains of each period."""
    drops = top_within(
        delta.where(F.col("delta") < 0), [period], [F.asc("delta"), F.asc(label)], k
    )
    gains = top_within(
        delta.where(F.col("delta") > 0), [period], [F.desc("delta"), F.asc(label)], k
    )
    return drops.unionByName(gains).drop("pos")


def positive_share(df: DataFrame, value: str, name: str = "participacao") -> DataFrame:
    """Percent of the sum of positive values; NULL for rows that are not positive."""
    positive = F.when(F.col(value) > 0, F.col(value))
    out = with_stats(df, [], __all=F.sum(positive))
    return out.withColumn(name, ratio(positive, F.col("__all")) * 100.0).drop("__all")


def pivot_pairs(
    df: DataFrame, left: str, top: str, value: str, tops: Sequence[str]
) -> DataFrame:
    """Sum of ``value`` with one column per known top label."""
    cells = [
        F.sum(F.when(F.col(top) == t, F.col(value))).alias(t) for t in tops
    ]
    return df.where(F.col(value).isNotNull()).groupBy(left).agg(*cells)


def heatmap(
    df: DataFrame, value: str, row: str, col: str, row_order: Sequence[str], col_order: Sequence[str]
) -> DataFrame:
    """Cells with their place in fixed label orders and a [0, 1] ratio (0.65 when flat)."""

    def place(name: str, order: Sequence[str]) -> Column:
        at = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(name))
        return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")

    out = with_stats(df, [], __lo=F.min(value), __hi=F.max(value))
    low, high = F.col("__lo"), F.col("__hi")
    shade = F.when(low == high, 0.65).otherwise(ratio(F.col(value) - low, high - low))
    return out.select(
        row,
        col,
        value,
        place(row, row_order).alias("linha"),
        place(col, col_order).alias("coluna"),
        F.when(F.col(value).isNotNull(), shade).alias("intensidade"),
    )
