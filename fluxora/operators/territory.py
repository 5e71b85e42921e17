"""Scopes, territory indicators, universe expansion, code enrichment and key audits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxora.functions.numbers import ratio, valid_positive
from fluxora.functions.text import (
    format_code,
    is_code_missing,
    is_yes,
    join_key,
    upper_key,
    valid_category,
)
from fluxora.operators.movement import movement_sums
from fluxora.operators.order_stats import exact_quantiles, join_null_safe
from fluxora.session import counted_side, passing_stages, stage_in_turns

# Keys that stand for "no territory" (fixed values).
NON_TERRITORIAL = ("IGNORADO",)

# Indicator columns of a territory (fixed values).
CATEGORY_COLUMNS = {
    "cbo": "cbo2002ocupacao",
    "subclasse": "subclasse",
    "secao": "secao",
    "categoria": "categoria",
}
# What the indicators are computed from, beside the keys.
INDICATOR_SOURCES = (
    "saldomovimentacao", "admissao", "desligamento", "salario", "idade", "horascontratuais",
    "indtrabparcial", "indtrabintermitente", *CATEGORY_COLUMNS.values(),
)
COUNT_COLUMNS = ("n_movimentacoes", "admissoes", "desligamentos", "saldo")
INDICATORS = (
    *COUNT_COLUMNS,
    "salario_mediano_admissao", "salario_medio_admissao",
    "salario_mediano_desligamento", "salario_medio_desligamento", "gap_salarial_adm_des",
    "idade_media_admissao", "horas_media_admissao",
    "perc_parcial_admissao", "perc_intermitente_admissao",
    *(f"n_{c}" for c in CATEGORY_COLUMNS),
    *(f"shannon_{c}" for c in CATEGORY_COLUMNS),
)
ZERO_FILLED = (*COUNT_COLUMNS, *(f"n_{c}" for c in CATEGORY_COLUMNS))


def scope_array(state: Column, in_area: Column) -> Column:
    """Names of the scopes a row belongs to: all, the state, the area inside the state."""
    return F.filter(
        F.array(
            F.lit("br"),
            F.when(state, F.lit("pr")),
            F.when(state & in_area, F.lit("rmc")),
        ),
        lambda s: s.isNotNull(),
    )


def filter_scope(df: DataFrame, scope: str, state: Column, in_area: Column) -> DataFrame:
    if scope == "br":
        return df
    if scope == "pr":
        return df.where(state)
    if scope == "rmc":
        return df.where(state & in_area)
    raise ValueError(f"unknown scope: {scope!r}")


def diversity(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Distinct valid categories and Shannon entropy (natural log) for several columns.

    One scan: grouping sets give the counts per (keys, category); the entropy is
    ln N - sum(c ln c) / N, so hot groups are already reduced map-side.
    """
    keys = list(keys)
    names = list(columns)
    prepared = df.select(*keys, *[valid_category(F.col(c)).alias(n) for n, c in columns.items()])
    counts = prepared.groupingSets([[*keys, n] for n in names], *keys, *names).agg(
        F.grouping_id().alias("__gid"), F.count(F.lit(1)).alias("__n")
    )
    # grouping_id has the category bits last: all set but the one that was grouped by.
    everything = (1 << len(names)) - 1
    bit = {n: everything & ~(1 << (len(names) - 1 - i)) for i, n in enumerate(names)}
    n = F.col("__n").cast("double")

    def only(name: str, value: Column) -> Column:
        return F.when((F.col("__gid") == bit[name]) & F.col(name).isNotNull(), value)

    aggs = []
    for name in names:
        aggs += [
            F.count(only(name, F.lit(1))).alias(f"n_{name}"),
            F.sum(only(name, n)).alias(f"__t_{name}"),
            F.sum(only(name, n * F.ln(n))).alias(f"__s_{name}"),
        ]
    grouped = counts.groupBy(*keys).agg(*aggs)
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()

    def entropy(name: str) -> Column:
        t = F.col(f"__t_{name}")
        value = F.ln(t) - F.col(f"__s_{name}") / t
        return (
            F.when(~known | (F.col(f"n_{name}") == 0), None)
            .when(F.col(f"n_{name}") == 1, F.lit(0.0))
            .otherwise(value)
        )

    return grouped.select(
        *keys,
        *[f"n_{name}" for name in names],
        *[entropy(name).alias(f"shannon_{name}") for name in names],
    )


# A turn of :func:`territory_indicators` takes some 256 MB of the tables read; an eighth of
# the rows is little enough on disk at any size.
TURN_BYTES = 256 << 20
MOST_TURNS = 8


def turns_of(df: DataFrame) -> int:
    """Turns for the tables that ``df`` reads; the most for a source of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(1, min(MOST_TURNS, size // TURN_BYTES))


def in_turns(df: DataFrame, keys: Sequence[str], turns: int) -> Iterator[DataFrame]:
    """The rows of ``df`` in ``turns`` frames; rows with equal ``keys`` stand in one."""
    turn = F.pmod(F.xxhash64(*keys), F.lit(turns))
    for t in range(turns):
        yield df.where(turn == t) if turns > 1 else df


def territory_indicators(
    df: DataFrame, keys: Sequence[str], row_key: str | None = None, turns: int | None = None
) -> DataFrame:
    """The indicator columns per territory (and period, if among ``keys``).

    The rows are read and joined once and staged in a narrow form, then the territories are
    computed; both in ``turns`` (given by the size of the input), so that the shuffle files of
    one turn lie on disk at a time.  ``row_key`` names a column of ``df`` that cuts its rows
    into turns below its joins; it should be the key of its largest join.
    """
    keys = list(keys)
    spark = df.sparkSession
    turns = turns or turns_of(df)

    def results() -> Iterator[DataFrame]:
        with passing_stages(spark):
            cut = in_turns(df, [row_key], turns) if row_key else [df]
            narrow = (part.select(*keys, *INDICATOR_SOURCES) for part in cut)
            rows = stage_in_turns(spark, narrow, "territory-rows")
            for part in in_turns(rows, keys, turns):
                with passing_stages(spark):
                    yield indicators_of(part, keys)

    return stage_in_turns(spark, results(), "territory-indicators")


def indicators_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The indicator columns of all rows at once; ``df`` is read several times."""
    keys = list(keys)
    hire = F.col("admissao") == 1
    leave = F.col("desligamento") == 1
    wage = valid_positive(F.col("salario"))

    def share(flag: str) -> Column:
        return F.avg(F.when(hire, is_yes(F.col(flag)).cast("double"))) * 100.0

    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_movimentacoes"),
        *movement_sums(),
        F.avg(F.when(hire, wage)).alias("salario_medio_admissao"),
        F.avg(F.when(leave, wage)).alias("salario_medio_desligamento"),
        F.avg(F.when(hire, F.col("idade").try_cast("double"))).alias("idade_media_admissao"),
        F.avg(F.when(hire, F.col("horascontratuais").try_cast("double"))).alias(
            "horas_media_admissao"
        ),
        share("indtrabparcial").alias("perc_parcial_admissao"),
        share("indtrabintermitente").alias("perc_intermitente_admissao"),
    )
    medians = wage_medians(df, keys)
    categories = diversity(df, keys, CATEGORY_COLUMNS)
    joined = join_null_safe(join_null_safe(base, medians, keys), categories, keys)
    joined = joined.withColumn(
        "gap_salarial_adm_des",
        F.col("salario_mediano_admissao") - F.col("salario_mediano_desligamento"),
    )
    return joined.select(*keys, *INDICATORS)


def wage_medians(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median wage at hire and at separation; the two never share a row."""
    keys = list(keys)
    kind = F.when(F.col("admissao") == 1, "adm").when(F.col("desligamento") == 1, "des")
    rows = df.select(
        *keys, kind.alias("__kind"), valid_positive(F.col("salario")).alias("__wage")
    ).where(F.col("__kind").isNotNull())
    medians = exact_quantiles(rows, [*keys, "__kind"], "__wage", {"__median": 0.5})
    return medians.groupBy(*keys).agg(
        F.max(F.when(F.col("__kind") == "adm", F.col("__median"))).alias(
            "salario_mediano_admissao"
        ),
        F.max(F.when(F.col("__kind") == "des", F.col("__median"))).alias(
            "salario_mediano_desligamento"
        ),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep one row per key, the smallest by ``order``.

    ``min_by`` keeps one candidate per task, so a key with very many copies never has
    its copies gathered.  ``order`` must identify a row within its key.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep one row per key, the greatest by ``order`` (the last one written wins)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def load_universe(
    source: DataFrame, name: str, order: Sequence[Column], expected: int | None = None
) -> DataFrame:
    """Distinct territories by normalised name, first one kept, optional count check."""
    keyed = source.withColumn("municipio_norm", upper_key(F.col(name)))
    keyed = keyed.where(F.col("municipio_norm") != "")
    universe = first_per_key(keyed, ["municipio_norm"], order)
    if expected is not None:
        found = universe.count()
        if found != expected:
            raise ValueError(f"universe has {found} territories, expected {expected}")
    return universe


def periods_spine(universe: DataFrame, periods: DataFrame, name: str) -> DataFrame:
    """Every territory once per period.

    ``periods`` has one calendar period per row; the list reaches each row as an array
    from a scalar subquery, so the universe is neither shuffled nor joined.
    """
    listed = periods.agg(F.sort_array(F.collect_set(F.struct(*periods.columns)))).scalar()
    spine = universe.withColumn("__periods", listed).withColumn(name, F.explode("__periods"))
    return spine.select(*universe.columns, f"{name}.*")


def expand_to_universe(
    aggregated: DataFrame,
    spine: DataFrame,
    keys: Sequence[str],
    zero_filled: Sequence[str] = ZERO_FILLED,
) -> DataFrame:
    """All rows of the spine; missing counts become 0, other indicators stay NULL."""
    keys = list(keys)
    kept = [c for c in aggregated.columns if c not in spine.columns or c in keys]
    joined = spine.join(aggregated.select(*kept), keys, "left")
    return joined.fillna(0, subset=[c for c in zero_filled if c in joined.columns])


def code_lookup(places: DataFrame, name: str, code: str, collisions: str = "raise") -> DataFrame:
    """One row per join key with its formatted code.

    A key that leads to several codes fails the job.  A caller who takes the table of
    :func:`lookup_collisions` may pass ``collisions="drop"`` to leave such keys out.
    """
    if collisions not in ("raise", "drop"):
        raise ValueError(f"unknown handling of collisions: {collisions}")
    keyed = places.select(
        join_key(F.col(name)).alias("chave"), format_code(F.col(code)).alias("codigo")
    ).where(F.col("chave").isNotNull() & F.col("codigo").isNotNull())
    found = keyed.groupBy("chave").agg(
        F.min("codigo").alias("codigo"), F.max("codigo").alias("__max")
    )
    unique = F.col("codigo") == F.col("__max")
    if collisions == "drop":
        return found.where(unique).drop("__max")
    message = F.concat(F.lit("several codes for the key "), F.col("chave"))
    one = F.when(unique, F.col("codigo")).otherwise(F.raise_error(message).cast("string"))
    return found.select("chave", one.alias("codigo"))


def lookup_collisions(places: DataFrame, name: str, code: str) -> DataFrame:
    """Join keys that lead to more than one code."""
    return (
        places.select(join_key(F.col(name)).alias("chave"), format_code(F.col(code)).alias("c"))
        .where(F.col("chave").isNotNull())
        .distinct()
        .groupBy("chave")
        .agg(F.count("c").alias("n_codigos"))
        .where(F.col("n_codigos") > 1)
    )


def enrich_codes(
    df: DataFrame,
    lookup: DataFrame,
    name: str,
    code: str,
    non_territorial: Sequence[str] = NON_TERRITORIAL,
    strict: bool = False,
) -> DataFrame:
    """Fill missing codes by normalised name; existing codes are kept and formatted.

    Adds ``situacao``: existing, filled, ignored or unmatched; a code column that is absent
    is created.  With ``strict`` an unmatched name fails the job.
    """
    if code not in df.columns:
        df = df.withColumn(code, F.lit(None).cast("string"))
    # Text is normalised once per distinct name, not once per row.
    names = df.select(F.col(name).alias("__name")).where(F.col("__name").isNotNull()).distinct()
    resolved = names.withColumn("__key", join_key(F.col("__name"))).join(
        lookup.withColumnsRenamed({"chave": "__key", "codigo": "__found"}), "__key", "left"
    )
    side = counted_side(resolved, "place-names")
    named = df.where(F.col(name).isNotNull()).join(side, F.col(name) == F.col("__name"), "left")
    nothing = F.lit(None).cast("string")
    unnamed = df.where(F.col(name).isNull()).withColumns({"__key": nothing, "__found": nothing})
    joined = named.drop("__name").unionByName(unnamed)
    missing = is_code_missing(F.col(code))
    ignored = F.coalesce(F.col("__key").isin(*non_territorial), F.lit(False))
    filled = F.when(~missing, format_code(F.col(code))).when(~ignored, F.col("__found"))
    status = (
        F.when(ignored, "ignored")
        .when(~missing, "existing")
        .when(F.col("__found").isNotNull(), "filled")
        .otherwise("unmatched")
    )
    if strict:
        message = F.concat(F.lit("no code for the name "), F.coalesce(F.col(name), F.lit("NULL")))
        status = F.when(status == "unmatched", F.raise_error(message).cast("string")).otherwise(status)
    return joined.select(
        *[c for c in df.columns if c != code], filled.alias(code), status.alias("situacao")
    )


def unmatched_names(enriched: DataFrame, name: str) -> DataFrame:
    """Names that :func:`enrich_codes` found no code for, with their rows."""
    return (
        enriched.where(F.col("situacao") == "unmatched")
        .groupBy(F.col(name).alias("nome"))
        .agg(F.count(F.lit(1)).alias("linhas"))
    )


def enrichment_report(before: DataFrame, after: DataFrame, code: str) -> DataFrame:
    """Row counts before and after :func:`enrich_codes` as one row."""
    prior = before.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~is_code_missing(F.col(code))).alias("before_filled"),
    )
    counts = after.agg(
        F.count_if(F.col(code).isNotNull()).alias("after_filled"),
        F.count_if(F.col("situacao") == "filled").alias("filled_this_run"),
        F.count_if(F.col("situacao") == "ignored").alias("ignored_rows"),
        F.count_if(F.col("situacao") == "unmatched").alias("unmatched_rows"),
    )
    # Two one-row results side by side.
    return prior.select("*", *_scalars(counts))


def _scalars(one_row: DataFrame) -> list[Column]:
    """Columns of a one-row frame as scalar subqueries of the caller's plan."""
    packed = one_row.select(F.struct(*one_row.columns).alias("__r")).scalar()
    return [packed.getField(c).alias(c) for c in one_row.columns]


def key_coverage(
    facts: DataFrame,
    places: DataFrame,
    key: str,
    non_territorial: Sequence[str] = NON_TERRITORIAL,
) -> DataFrame:
    """Distinct keys on both sides, in neither and in one only, with coverage in percent."""
    left = facts.select(key).where(F.col(key).isNotNull()).distinct().withColumn("f", F.lit(1))
    right = places.select(key).where(F.col(key).isNotNull()).distinct().withColumn("p", F.lit(1))
    both = left.join(right, key, "full_outer")
    outside = F.col(key).isin(*non_territorial)
    fact, place = F.col("f").isNotNull(), F.col("p").isNotNull()
    counts = both.agg(
        F.count_if(fact).alias("fact_total"),
        F.count_if(fact & ~outside).alias("fact_territorial"),
        F.count_if(fact & outside).alias("non_territorial"),
        F.count_if(place).alias("place_total"),
        F.count_if(fact & ~outside & place).alias("matched"),
        F.count_if(fact & ~outside & ~place).alias("unmatched_fact"),
        F.count_if(place & (~fact | outside)).alias("unmatched_place"),
    )
    covered = F.coalesce(ratio(F.col("matched"), F.col("fact_territorial")), F.lit(0.0))
    return counts.select(
        "*",
        F.round(covered * 100.0, 2).alias("coverage_pct"),
        ((F.col("unmatched_fact") == 0) & (F.col("fact_territorial") > 0)).alias("ok"),
    )


def unmatched_keys(facts: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, tagged with the side (both set differences)."""
    left = facts.select(key).where(F.col(key).isNotNull()).distinct()
    right = places.select(key).where(F.col(key).isNotNull()).distinct()
    only_left = left.join(right, key, "left_anti").withColumn("lado", F.lit("fact"))
    only_right = right.join(left, key, "left_anti").withColumn("lado", F.lit("place"))
    return only_left.unionByName(only_right)


def join_residue(facts: DataFrame, universe: DataFrame, key: str, metric: str) -> DataFrame:
    """Fact total, total kept by the universe join, and what lies outside.

    Facts are summed by key first, so the join carries one row per key.
    """
    by_key = facts.groupBy(key).agg(F.sum(F.col(metric).cast("long")).alias("m"))
    marked = by_key.join(
        universe.select(key).distinct().withColumn("__in", F.lit(True)), key, "left"
    )
    inside = F.coalesce(F.col("__in"), F.lit(False))
    zero = F.lit(0).cast("long")
    sums = marked.agg(
        F.coalesce(F.sum("m"), zero).alias("total_micro"),
        F.coalesce(F.sum(F.when(inside, F.col("m"))), zero).alias("total_na_malha"),
        F.count_if(~inside & F.col(key).isNotNull()).alias("n_fora_da_malha"),
    )
    gap = F.col("total_micro") - F.col("total_na_malha")
    return sums.select(
        "*",
        gap.alias("diferenca"),
        (ratio(gap, F.col("total_micro")) * 100.0).alias("percentual_residuo"),
    )


def feature_join(
    features: DataFrame,
    metrics: DataFrame,
    code: str,
    name_key: str,
    values: Sequence[str],
) -> DataFrame:
    """Attach metrics to features by code, by normalised name where the code misses."""
    by_code = metrics.where(F.col(code).isNotNull()).select(
        code, F.struct(*values).alias("__by_code")
    )
    by_name = metrics.where(F.col(name_key).isNotNull()).select(
        name_key, F.struct(*values).alias("__by_name")
    )
    joined = features.join(by_code, code, "left")
    matched = joined.where(F.col("__by_code").isNotNull()).withColumn(
        "__m", F.col("__by_code")
    )
    # Only the misses go through the second join.
    missed = (
        joined.where(F.col("__by_code").isNull())
        .join(by_name, name_key, "left")
        .withColumn("__m", F.col("__by_name"))
        .drop("__by_name")
    )
    united = matched.unionByName(missed).drop("__by_code")
    return united.select(
        *features.columns,
        *[F.col("__m")[v].alias(v) for v in values],
        F.col("__m").isNotNull().alias("matched"),
    )


def decode(
    df: DataFrame,
    dictionary: DataFrame,
    columns: dict[str, str],
) -> DataFrame:
    """Replace codes by labels: ``columns`` maps a column to its dictionary domain.

    The dictionary has (domain, code, label) with one label per (domain, code).
    Unmapped codes keep their own text (integers without ``.0``); results are trimmed.
    Each domain is one left join.  Codes are few values of many rows, so a domain is counted and
    broadcast: dealt by code, all rows of one code would meet in one task.
    """
    out = df
    for column, domain in columns.items():
        labels = dictionary.where(F.col("domain") == domain).select(
            F.col("code").alias("__code"), F.col("label").alias("__label")
        )
        labels = counted_side(labels, "labels")
        text = F.regexp_replace(F.trim(F.col(column).cast("string")), r"^(-?\d+)\.0$", "$1")
        out = (
            out.withColumn("__code", text)
            .join(labels, "__code", "left")
            .withColumn(column, F.trim(F.coalesce("__label", "__code")))
            .drop("__code", "__label")
        )
    return out.select(*df.columns)
