"""Mixing sources to target weights by hierarchical budgeting (operator 3, SQL functions only).

A token budget is handed down a tree domain > language > source.  At each node the children
share the node's budget by their weights; a child that cannot supply its share gives all it
has, and the shortage goes to its siblings, again by weight.  As a node never gets more than
its leaves can supply, shortages reach an ancestor's other children only after the siblings
are used up.  A leaf can supply its tokens once per epoch.

Each leaf's budget is met by a prefix of its seeded epochs: whole epochs first, then, in the
order of a seeded hash of the epoch and the document id, documents up to the budget; the
document at the cut gives the tokens before it.

Scale: the texts are read once for the token counts, which are staged as a narrow table.
A leaf's cut is found from sums over hash buckets and then inside the one bucket that holds
it, so a leaf with a third of all rows is never sorted as a whole.  Selecting texts needs
only the cut of their leaf, hence no shuffle of texts.  All numbers are integers.

Tokens are the words between ASCII white space.  Null languages and sources count as empty
names; sources without a number belong to the domain "other".  Documents without tokens are
never selected.  Documents that share an id share the tokens left at a cut in equal parts.
Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxora.llm.common import staged
from fluxora.session import counted_side

WORDS = r"[^\x20\x09-\x0D]+"
LEAF = ("domain", "lang", "source")
BUCKET_BITS = 12
DOMAINS = ("web", "books", "code", "forum")


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers above 0), budget, epochs and seed."""

    domains: dict[str, int] = field(
        default_factory=lambda: {"web": 4, "books": 3, "code": 2, "forum": 2}
    )
    langs: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 4})
    default: int = 1
    budget_percent: int = 100
    epochs: int = 2
    seed: int = 11

    def __post_init__(self) -> None:
        weights = [*self.domains.values(), *self.langs.values(), *self.sources.values()]
        if min([self.default, self.epochs, *weights]) < 1 or self.budget_percent < 0:
            raise ValueError("weights and epochs must be 1 or more, the budget 0 or more")


def domain_of(source: Column) -> Column:
    """Domain by the number at the end of a source's name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    at = F.try_to_number(number, F.lit("999999999")).cast("int") % len(DOMAINS)
    return F.when(number == "", "other").otherwise(
        F.element_at(F.array(*map(F.lit, DOMAINS)), at + 1)
    )


def leaf_columns() -> list[Column]:
    return [
        domain_of(F.col("`source`")).alias("domain"),
        F.coalesce(F.col("`lang`"), F.lit("")).alias("lang"),
        F.coalesce(F.col("`source`"), F.lit("")).alias("source"),
    ]


def order_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """60 bits of a hash of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, leaf and number of tokens, staged."""
    tokens = F.regexp_count(F.coalesce(F.col("`text`"), F.lit("")), F.lit(WORDS)).cast("long")
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), *leaf_columns(), tokens.alias("n_tokens"))
    return staged(rows.filter("n_tokens > 0"), "mix")


def weight_of(column: str, weights: dict[str, int], default: int) -> Column:
    table = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(w))]
    found = F.element_at(F.create_map(*table), F.col(column)) if table else F.lit(None)
    return F.coalesce(found, F.lit(default)).cast("decimal(38,0)")


def shares(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split ``budget`` (of the parent) over children with ``weight`` and ``capacity``.

    Children are taken by the level at which they run dry; those dry below the common level
    give all they have, the others get their part of the rest, whole tokens left over going
    one by one to the first names.
    """
    order = Window.partitionBy(*parent).orderBy(
        F.col("capacity").cast("double") / F.col("weight").cast("double"), child
    )
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    below = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy(*parent)
    named = Window.partitionBy(*parent).orderBy("dry", child)
    whole = "decimal(38,0)"
    zero = F.lit(0).cast(whole)
    return (
        children.withColumn("used", F.coalesce(F.sum("capacity").over(above), zero).cast(whole))
        .withColumn("open", F.sum("weight").over(below).cast(whole))
        .withColumn("dry", F.expr("capacity * open <= (budget - used) * weight"))
        .withColumn("dry_sum", F.sum(F.when(F.col("dry"), F.col("capacity")).otherwise(zero)).over(all_rows).cast(whole))
        .withColumn("open_sum", F.sum(F.when(~F.col("dry"), F.col("weight")).otherwise(zero)).over(all_rows).cast(whole))
        .withColumn(
            "share",
            F.expr(
                "CASE WHEN dry THEN capacity ELSE "
                "CAST((weight * (budget - dry_sum)) DIV open_sum AS DECIMAL(38,0)) END"
            ),
        )
        .withColumn("rest", (F.col("budget") - F.sum("share").over(all_rows)).cast(whole))
        # Rows that ran dry sort last (false before true) and take nothing of the rest.
        .withColumn("place", F.row_number().over(named))
        .withColumn(
            "share",
            F.expr("CAST(share + CASE WHEN NOT dry AND place <= rest THEN 1 ELSE 0 END AS DECIMAL(38,0))"),
        )
        .drop("used", "open", "dry", "dry_sum", "open_sum", "rest", "place")
    )


def budgets(counts: DataFrame, mix: Mix) -> DataFrame:
    """Leaf, its tokens and its budget."""
    whole = "decimal(38,0)"
    leaves = counts.groupBy(*LEAF).agg(F.sum("n_tokens").cast("long").alias("tokens"))
    leaves = leaves.withColumn("capacity", (F.col("tokens") * mix.epochs).cast(whole))

    def level(keys: list[str], column: str, weights: dict[str, int], above) -> DataFrame:
        nodes = leaves.groupBy(*keys, column).agg(F.sum("capacity").cast(whole).alias("capacity"))
        nodes = nodes.withColumn("weight", weight_of(column, weights, mix.default))
        nodes = nodes.join(above, keys) if keys else nodes.withColumn("budget", above)
        split = shares(nodes, keys or [F.lit(0)], column)
        return split.select(*keys, column, F.col("share").alias("budget"))

    wanted = F.expr(f"LEAST(SUM(capacity), CAST(SUM(tokens) * {mix.budget_percent} DIV 100 AS DECIMAL(38,0)))")
    total = leaves.agg(F.coalesce(wanted, F.lit(0)).cast("long").alias("budget")).first()[0]
    root = F.lit(total).cast(whole)
    domains = level([], "domain", mix.domains, root)
    langs = level(["domain"], "lang", mix.langs, domains)
    sources = level(["domain", "lang"], "source", mix.sources, langs)
    return sources.join(leaves.select(*LEAF, "tokens"), list(LEAF)).withColumn(
        "budget", F.col("budget").cast("long")
    )


def cuts(counts: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf: whole epochs, then up to ``cut`` in the order of the next epoch.

    Documents at the cut give ``cut_take`` tokens each.
    """
    plan = staged(
        budgets(counts, mix)
        .withColumn("epochs", F.expr("CAST(budget DIV tokens AS INT)"))
        .withColumn("left", F.expr("budget % tokens")),
        "mix",
    )
    shift = 60 - BUCKET_BITS
    rows = (
        counts.join(plan.filter("left > 0"), list(LEAF))
        .withColumn("key", order_key(F.col("epochs"), F.col("doc_id"), mix.seed))
        .groupBy(*LEAF, "left", "key")
        .agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        .withColumn("bucket", F.shiftright("key", shift))
    )
    sums = rows.groupBy(*LEAF, "left", "bucket").agg(F.sum("n").alias("n"))

    def crossing(table: DataFrame, order: str, base: Column) -> DataFrame:
        before = (
            Window.partitionBy(*LEAF).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        )
        told = table.withColumn("before", base + F.coalesce(F.sum("n").over(before), F.lit(0)))
        return told.filter("before < left AND before + n >= left")

    bucket = crossing(sums, "bucket", F.lit(0)).select(*LEAF, "bucket", F.col("before").alias("base"))
    inside = rows.join(bucket, [*LEAF, "bucket"])
    cut = crossing(inside, "key", F.col("base")).select(
        *LEAF,
        F.col("key").alias("cut"),
        F.expr("(left - before) DIV docs").alias("cut_take"),
    )
    return plan.join(cut, list(LEAF), "left").select(*LEAF, "epochs", "cut", "cut_take")


def chosen(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (with doc_id and leaf) once per selected epoch; ``cut_take`` is null if whole."""
    picked = (
        rows.join(counted_side(plan, "mix"), list(LEAF))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
        .withColumn("key", F.when(F.col("epoch") == F.col("epochs"), order_key(F.col("epoch"), F.col("doc_id"), mix.seed)))
        .filter("key IS NULL OR key <= cut")
    )
    at_cut = F.col("key").isNotNull() & (F.col("key") == F.col("cut"))
    return picked.withColumn("cut_take", F.when(at_cut, F.col("cut_take"))).drop("epochs", "key", "cut")


def mixture(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row per selected document and epoch with the tokens it gives."""
    mix = mix or Mix()
    counts = counted(docs)
    picked = chosen(counts, cuts(counts, mix), mix)
    take = F.least(F.col("n_tokens"), F.coalesce(F.col("cut_take"), F.col("n_tokens")))
    return (
        picked.withColumn("take_tokens", take)
        .filter("take_tokens > 0")
        .select("doc_id", *LEAF, "epoch", "n_tokens", "take_tokens")
    )


def mixed_docs(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The selected documents with all their columns, a row per epoch, cut at the prefix."""
    mix = mix or Mix()
    plan = cuts(counted(docs), mix)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(own, F.col("`doc_id`").alias("doc_id"), *leaf_columns()).filter(
        F.regexp_like(F.coalesce(F.col("`text`"), F.lit("")), F.lit(WORDS))
    )
    picked = chosen(rows, plan, mix).filter("cut_take IS NULL OR cut_take > 0")
    # White space goes with the word after it, so pieces joined give back the text's front.
    pieces = F.split(F.col("__row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    front = F.array_join(F.slice(pieces, 1, F.col("cut_take").cast("int")), "")
    text = F.when(F.col("cut_take").isNull(), F.col("__row.text")).otherwise(front)

    def column(name: str) -> Column:
        if name == "text":
            return text.alias(name)
        value = F.col(f"__row.`{name}`")
        if name == "n_chars":
            return F.when(F.col("cut_take").isNull(), value).otherwise(
                F.length(front).cast(docs.schema[name].dataType)
            ).alias(name)
        return value.alias(name)

    return picked.select(*[column(c) for c in docs.columns])


def _weights_sql(column: str, weights: dict[str, int], default: int) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in sorted(weights.items()))
    return f"CAST(CASE {column} {cases} ELSE {default} END AS HUGEINT)"


def _level_sql(name: str, keys: list[str], column: str, weights: dict[str, int], mix: Mix, above: str) -> str:
    cols = ", ".join([*keys, column])
    part = "PARTITION BY " + (", ".join(keys) if keys else "1")
    join = f"JOIN {above} USING ({', '.join(keys)})" if keys else f"CROSS JOIN {above}"
    return f"""
{name}_0 AS (SELECT {cols}, CAST(sum(capacity) AS HUGEINT) AS capacity FROM leaves GROUP BY {cols}),
{name}_1 AS (SELECT n.*, {_weights_sql(column, weights, mix.default)} AS weight, budget FROM {name}_0 n {join}),
{name}_2 AS (SELECT *, capacity * sum(weight) OVER ({part} ORDER BY capacity::DOUBLE / weight::DOUBLE, {column}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (budget - coalesce(sum(capacity) OVER ({part} ORDER BY capacity::DOUBLE / weight::DOUBLE, {column}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS dry FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN dry THEN capacity ELSE
    CAST(weight * (budget - sum(CASE WHEN dry THEN capacity ELSE 0 END) OVER ({part})) AS HUGEINT)
    // CAST(sum(CASE WHEN dry THEN 0 ELSE weight END) OVER ({part}) AS HUGEINT) END AS share FROM {name}_2),
{name} AS (SELECT {cols}, share + CASE WHEN NOT dry AND row_number() OVER ({part} ORDER BY dry, {column})
    <= budget - sum(share) OVER ({part}) THEN 1 ELSE 0 END AS budget FROM {name}_3)"""


def oracle(mix: Mix | None = None) -> str:
    """DuckDB twin of :func:`mixture`."""
    mix = mix or Mix()
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    number = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    key = f"CAST('0x' || substr(md5('{mix.seed}:' || epoch || ':' || doc_id), 1, 15) AS BIGINT)"
    return f"""
WITH c AS (
  SELECT doc_id, CASE WHEN {number} = '' THEN 'other'
      ELSE list_extract([{names}], CAST(TRY_CAST({number} AS INTEGER) % {len(DOMAINS)} + 1 AS INTEGER)) END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS n_tokens
  FROM documents),
counts AS (SELECT * FROM c WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens,
  CAST(sum(n_tokens) * {mix.epochs} AS HUGEINT) AS capacity FROM counts GROUP BY ALL),
root AS (SELECT least(sum(capacity), CAST(sum(tokens) * {mix.budget_percent} AS HUGEINT) // 100) AS budget FROM leaves),
{_level_sql('dom', [], 'domain', mix.domains, mix, 'root')},
{_level_sql('lan', ['domain'], 'lang', mix.langs, mix, 'dom')},
{_level_sql('src', ['domain', 'lang'], 'source', mix.sources, mix, 'lan')},
plan AS (SELECT domain, lang, source, CAST(budget AS HUGEINT) // tokens AS epochs, CAST(budget AS HUGEINT) % tokens AS rest
  FROM src JOIN leaves USING (domain, lang, source)),
e AS (SELECT counts.*, epochs, rest, unnest(range(CAST(epochs + 1 AS BIGINT))) AS epoch
  FROM counts JOIN plan USING (domain, lang, source)),
k AS (SELECT *, CASE WHEN epoch = epochs THEN {key} END AS key FROM e),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key RANGE UNBOUNDED PRECEDING)
    - sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch, key) AS before,
    count(*) OVER (PARTITION BY domain, lang, source, epoch, key) AS docs,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch, key) AS together FROM k),
t AS (SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens,
    CAST(CASE WHEN epoch < epochs OR before + together < rest THEN n_tokens
      WHEN before >= rest THEN 0
      ELSE least(n_tokens, CAST(rest - before AS HUGEINT) // docs) END AS BIGINT) AS take_tokens FROM s)
SELECT * FROM t WHERE take_tokens > 0
"""
