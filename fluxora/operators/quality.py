"""Validations and reconciliations, each as one aggregate per period or per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxora.functions.labels import AGE_UNKNOWN
from fluxora.operators.clean import CRITICAL, DERIVED, RECOMMENDED_INPUT, REQUIRED_INPUT
from fluxora.operators.order_stats import join_null_safe
from fluxora.operators.territory import _scalars
from fluxora.sources.files import path_value

CATEGORICAL = (
    "uf", "municipio", "secao", "cbo2002ocupacao", "sexo", "racacor", "graudeinstrucao",
)
METRICS = ("admissoes", "desligamentos", "saldo")
CRITICAL_CLEAN = ("horascontratuais", "salario", "valorsalariofixo")


def issue_list(checks: Sequence[tuple[str, str, Column]]) -> Column:
    """(level, code) structs of the checks that fire."""
    found = [
        F.when(cond, F.struct(F.lit(level).alias("nivel"), F.lit(code).alias("codigo")))
        for level, code, cond in checks
    ]
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def status_of(issues: Column) -> Column:
    def has(level: str) -> Column:
        return F.exists(issues, lambda s: s["nivel"] == level)

    return F.when(has("error"), "error").when(has("warning"), "warning").otherwise("ok")


def codes_of(issues: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(issues, lambda s: s["codigo"])), ",")


def column_checks(columns: Sequence[str]) -> list[tuple[str, str, Column]]:
    """Contract checks that depend on the schema alone."""
    rules = (
        ("error", "missing_required", REQUIRED_INPUT),
        ("error", "missing_derived", DERIVED),
        ("warning", "missing_recommended", RECOMMENDED_INPUT),
    )
    return [
        (level, f"{code}:{c}", F.lit(True))
        for level, code, names in rules
        for c in names
        if c not in columns
    ]


def validate_landing(
    parsed: DataFrame, min_bytes: int = 50_000, required: Sequence[str] = REQUIRED_INPUT,
    recommended: Sequence[str] = RECOMMENDED_INPUT,
) -> DataFrame:
    """Issue codes, columns and status of every month of landing files; the worst file decides.

    ``parsed`` has a row per file, with its first lines and its parsed header; the month is
    that of the file's folder.
    """
    year, month = (path_value(c).try_cast("int") for c in ("ano", "mes"))
    place = F.array_position("colunas", "competenciamov")
    cells = F.transform("linhas", lambda x: F.split(x, F.concat(F.lit("\\Q"), F.col("separador"), F.lit("\\E")), -1))
    values = F.transform(cells, lambda x: F.trim(F.translate(F.get(x, (place - 1).cast("int")), '"', "")))

    def absent(names: Sequence[str]) -> Column:
        return F.array_except(F.array(*[F.lit(c) for c in names]), "colunas")

    known = F.array(*[F.lit(c) for c in dict.fromkeys([*required, *recommended])])
    has_header = F.size("colunas") > 0
    checks = [
        ("error", "empty", F.col("length") == 0),
        ("warning", "small", (F.col("length") > 0) & (F.col("length") < min_bytes)),
        ("warning", "encoding", F.col("codificacao") != "utf-8"),
        ("error", "separator", ~F.col("separador_ok")),
        ("error", "missing_required", F.size(absent(required)) > 0),
        ("error", "no_rows", F.size("linhas") == 0),
        (
            "error",
            "period_mismatch",
            (place > 0) & F.exists(values, lambda v: v != F.format_string("%04d%02d", year, month)),
        ),
    ]
    named = parsed.select(
        year.alias("ano"), month.alias("mes"), issue_list(checks).alias("__issues"),
        F.when(has_header, absent(required)).alias("__sem"),
        F.when(has_header, absent(recommended)).alias("__rec"),
        F.when(has_header, F.array_except("colunas", known)).alias("__mais"),
    )

    def united(column: str) -> Column:
        """The names of all files of a month: as many as the headers have columns."""
        every = F.array_distinct(F.flatten(F.collect_set(column)))
        return F.array_join(F.sort_array(every), ",")

    merged = named.groupBy("ano", "mes").agg(
        # At most one struct per check and file remains after the set union.
        F.array_distinct(F.flatten(F.collect_set("__issues"))).alias("__issues"),
        united("__sem").alias("sem_obrigatorias"),
        united("__rec").alias("sem_recomendadas"),
        united("__mais").alias("extras"),
        F.count(F.lit(1)).alias("arquivos"),
    )
    return merged.select(
        "ano", "mes", codes_of(F.col("__issues")).alias("codigos"),
        status_of(F.col("__issues")).alias("status"),
        "arquivos", "sem_obrigatorias", "sem_recomendadas", "extras",
    )


def validate_clean(df: DataFrame, period: Sequence[str], expected: Column) -> DataFrame:
    """One row per period: counters, issue codes and status of the cleaned table.

    ``expected`` is the period text every row of that period should carry in
    ``competenciamov``.
    """
    cols = set(df.columns)
    # A missing column is reported by its check and counts as all NULL here.
    kinds = {"competenciamov": "string", "faixa_etaria": "string"}
    needed = ("saldomovimentacao", "admissao", "desligamento", *kinds)
    df = df.withColumns(
        {c: F.lit(None).cast(kinds.get(c, "int")) for c in needed if c not in cols}
    )
    sign = F.col("saldomovimentacao")
    hires = (sign == 1).cast("int")
    leaves = (sign == -1).cast("int")
    unit = F.when(sign.isin(1, -1), sign).otherwise(0)
    text = F.regexp_replace(F.col("competenciamov").cast("string"), r"\.0$", "")
    counted = df.groupBy(*period).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.sum(F.col("admissao").cast("long")).alias("admissao_sum"),
        F.sum(F.col("desligamento").cast("long")).alias("desligamento_sum"),
        F.sum(unit.cast("long")).alias("__unit"),
        F.count_if(~sign.isin(1, -1)).alias("fora_do_sinal"),
        F.count_if(F.col("admissao") != hires).alias("adm_divergente"),
        F.count_if(F.col("desligamento") != leaves).alias("des_divergente"),
        F.count_if(text != expected).alias("periodo_divergente"),
        F.count_if(F.col("faixa_etaria") != AGE_UNKNOWN).alias("__banded"),
        *[F.count(c).alias(f"__nn_{c}") for c in {*CRITICAL, *CATEGORICAL} if c in cols],
    )
    net = F.col("admissao_sum") - F.col("desligamento_sum")
    checks = column_checks([c for c in df.columns if c in cols])
    checks += [
        ("error", f"all_null:{c}", F.col(f"__nn_{c}") == 0) for c in CRITICAL if c in cols
    ]
    checks += [
        ("warning", f"all_null:{c}", F.col(f"__nn_{c}") == 0) for c in CATEGORICAL if c in cols
    ]
    checks += [
        ("error", "period_mismatch", F.col("periodo_divergente") > 0),
        ("warning", "sign_outside", F.col("fora_do_sinal") > 0),
        (
            "error",
            "flag_mismatch",
            (F.col("adm_divergente") > 0) | (F.col("des_divergente") > 0),
        ),
        ("warning", "net_differs", net != F.col("__unit")),
        ("warning", "bands_unknown", F.col("__banded") == 0),
    ]
    out = counted.withColumn("__issues", issue_list(checks))
    return out.select(
        *period,
        "linhas",
        "admissao_sum",
        "desligamento_sum",
        net.alias("saldo_sum"),
        "fora_do_sinal",
        "adm_divergente",
        "des_divergente",
        "periodo_divergente",
        codes_of(F.col("__issues")).alias("codigos"),
        status_of(F.col("__issues")).alias("status"),
    )


def fail_on_error(validation: DataFrame) -> None:
    """Raise with the failing periods (at most ten named) when any status is "error"."""
    failed = validation.where(F.col("status") == "error").limit(10).collect()
    if failed:
        raise ValueError("validation failed: " + "; ".join(str(r.asDict()) for r in failed))


def gate_periods(df: DataFrame, validation: DataFrame, period: Sequence[str]) -> DataFrame:
    """Rows of the periods that may go on: error blocks, warning and missing pass noted.

    ``validation`` has one row per calendar period and is broadcast.
    """
    status = validation.select(*period, F.col("status").alias("__status"))
    note = (
        F.when(F.col("__status") == "warning", "warning")
        .when(F.col("__status").isNull(), "not validated")
        .otherwise("")
    )
    joined = join_null_safe(df, F.broadcast(status), list(period), "left")
    passed = F.coalesce(F.col("__status"), F.lit("")) != "error"
    return joined.where(passed).withColumn("nota", note).drop("__status")


def table_invariants(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NULL metrics and keys, net identity, negative counts and duplicate keys: one row."""
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    per_key = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(
            F.when(F.greatest(*[F.col(m).isNull() for m in METRICS]), 1).otherwise(0)
        ).alias("__null"),
        F.count_if(F.col("saldo") != F.col("admissoes") - F.col("desligamentos")).alias("__net"),
        F.count_if((F.col("admissoes") < 0) | (F.col("desligamentos") < 0)).alias("__neg"),
    )
    zero = F.lit(0).cast("long")

    def total(c: str, name: str) -> Column:
        return F.coalesce(F.sum(c), zero).alias(name)

    return per_key.agg(
        total("__n", "linhas"),
        total("__null", "metricas_nulas"),
        total("__net", "saldo_incoerente"),
        total("__neg", "negativos"),
        F.coalesce(F.sum(F.when(null_key, F.col("__n"))), zero).alias("chaves_nulas"),
        F.count_if(F.col("__n") > 1).alias("chaves_duplicadas"),
    )


def table_totals(matrix: DataFrame) -> DataFrame:
    """Row count and metric totals of every table of a matrix."""
    return matrix.groupBy("tabela").agg(
        F.count(F.lit(1)).alias("linhas"), *[F.sum(m).alias(m) for m in METRICS]
    )


def reconcile_totals(matrix: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Compare table totals with a reference table: ``groups`` maps it to its peers.

    The totals are one row per table name, a list fixed by the matrix specification.
    """
    pairs = [(base, peer) for base, peers in groups.items() for peer in peers]
    wanted = matrix.sparkSession.createDataFrame(pairs, "referencia string, tabela string")
    totals = table_totals(matrix).drop("linhas")
    base = totals.withColumnsRenamed({"tabela": "referencia", **{m: f"ref_{m}" for m in METRICS}})
    joined = wanted.join(totals, "tabela", "left").join(base, "referencia", "left")
    same = F.lit(True)
    for m in METRICS:
        same = same & F.col(m).eqNullSafe(F.col(f"ref_{m}"))
    return joined.withColumn("confere", same)


def validate_gold(totals: DataFrame, clean: DataFrame, required: Sequence[str]) -> DataFrame:
    """Gate of the aggregate layer: required tables, net identity, cross-layer totals.

    ``totals`` has one row per table, ``clean`` the movement sums as one row.
    """
    names = F.array(*[F.lit(n) for n in required])
    summary = totals.where(F.col("tabela") == "tabela_resumo")
    row = totals.agg(
        F.array_except(names, F.collect_set("tabela")).alias("__missing"),
        F.count(F.lit(1)).alias("tabelas"),
    )
    first = summary.agg(*[F.max(m).alias(m) for m in METRICS])
    sums = clean.agg(*[F.max(m).alias(f"clean_{m}") for m in METRICS])
    row = row.select("*", *_scalars(first))
    row = row.select("*", *_scalars(sums))
    checks = [
        ("error", "missing_tables", F.size("__missing") > 0),
        (
            "error",
            "net_differs",
            F.col("saldo") != F.col("admissoes") - F.col("desligamentos"),
        ),
    ]
    checks += [
        ("warning", f"clean_{m}", F.col(m) != F.col(f"clean_{m}")) for m in METRICS
    ]
    out = row.withColumn("__issues", issue_list(checks))
    return out.select(
        "tabelas",
        F.size("__missing").cast("long").alias("n_faltando"),
        *METRICS,
        codes_of(F.col("__issues")).alias("codigos"),
        status_of(F.col("__issues")).alias("status"),
    )


def validate_gold_months(
    tables: DataFrame, copy: DataFrame, clean: DataFrame, required: Sequence[str], period: Sequence[str]
) -> DataFrame:
    """:func:`validate_gold` for every month at once, with the parity of both copies.

    ``tables`` and ``copy`` are the published matrix in either format, ``clean`` its movements.
    """
    keys = ["tabela", *period]
    totals = tables.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.count_if(F.col("saldo") != F.col("admissoes") - F.col("desligamentos")).alias("__net"),
        *[F.sum(m).alias(m) for m in METRICS],
    )
    copied = copy.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copy"))
    both = totals.join(copied, keys, "full")
    is_total = F.col("tabela") == "tabela_resumo"
    months = both.groupBy(*period).agg(
        F.count("linhas").alias("tabelas"),
        F.sum("linhas").alias("linhas"),
        # Table names are a list fixed by the matrix specification.
        F.array_except(
            F.array(*[F.lit(n) for n in required]),
            F.collect_set(F.when(F.col("linhas").isNotNull(), F.col("tabela"))),
        ).alias("__missing"),
        F.sum("__net").alias("__net"),
        F.count_if(~F.col("linhas").eqNullSafe(F.col("__copy"))).alias("copias_divergentes"),
        *[F.max(F.when(is_total, F.col(m))).alias(m) for m in METRICS],
    )
    sums = clean.groupBy(*period).agg(
        F.sum(F.col("admissao").cast("long")).alias("__admissoes"),
        F.sum(F.col("desligamento").cast("long")).alias("__desligamentos"),
        F.sum(F.col("saldomovimentacao").cast("long")).alias("__saldo"),
    )
    checks = [
        ("error", "missing_tables", F.size("__missing") > 0),
        ("error", "net_differs", F.col("__net") > 0),
        ("error", "copies_differ", F.col("copias_divergentes") > 0),
    ]
    checks += [
        ("warning", f"clean_{m}", F.col(m).isNotNull() & ~F.col(m).eqNullSafe(F.col(f"__{m}")))
        for m in METRICS
    ]
    out = months.join(sums, list(period), "left").withColumn("__issues", issue_list(checks))
    return out.select(
        *period, "tabelas", "linhas", "copias_divergentes",
        F.array_join(F.sort_array("__missing"), ",").alias("faltando"), *METRICS,
        codes_of(F.col("__issues")).alias("codigos"), status_of(F.col("__issues")).alias("status"),
    )


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ints: Sequence[str],
    doubles: Sequence[str],
    tolerance: float = 1e-6,
    warn_below: float = 1e-3,
) -> DataFrame:
    """Compare two copies on the keys of the left one: one row per check.

    Integer sums must agree exactly; mean, minimum and maximum of doubles within
    ``tolerance`` (a warning up to ``warn_below``, a failure beyond).
    """
    keys = list(keys)
    shared = right.join(left.select(*keys).distinct(), keys, "left_semi")

    def stats(df: DataFrame, side: str) -> DataFrame:
        aggs = {"linhas": F.count(F.lit(1)).cast("double")}
        aggs |= {f"{c}_soma": F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in ints}
        for c in doubles:
            aggs |= {
                f"{c}_media": F.avg(c), f"{c}_min": F.min(c), f"{c}_max": F.max(c),
            }
        row = df.agg(*[v.cast("double").alias(n) for n, v in aggs.items()])
        return row.unpivot([], list(aggs), "medida", side)

    both = stats(left, "esquerda").join(stats(shared, "direita"), "medida")
    gap = F.abs(F.col("esquerda") - F.col("direita"))
    exact = F.col("medida").endswith("_soma") | (F.col("medida") == "linhas")
    a_null, b_null = F.col("esquerda").isNull(), F.col("direita").isNull()
    verdict = (
        F.when(a_null & b_null, "ok")
        .when(a_null | b_null, "fail")
        .when(gap <= F.when(exact, 0.0).otherwise(tolerance), "ok")
        .when(~exact & (gap < warn_below), "warning")
        .otherwise("fail")
    )
    return both.withColumn("resultado", verdict)


def validate_index(
    index: DataFrame, period: Sequence[str], key: str, required: Sequence[str], expected: Column
) -> DataFrame:
    """Per period: rows, missing and duplicate keys, empty required texts, expected rows."""
    per_key = index.groupBy(*period, key).agg(
        F.count(F.lit(1)).alias("__n"),
        *[
            F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(f"__e_{c}") for c in required
        ],
    )
    counted = per_key.groupBy(*period).agg(
        F.sum("__n").alias("linhas"),
        F.count_if(F.col(key).isNull() | (F.trim(key) == "")).alias("sem_chave"),
        F.count_if(F.col("__n") > 1).alias("chaves_duplicadas"),
        *[F.sum(f"__e_{c}").alias(f"vazio_{c}") for c in required],
    )
    sound = (F.col("sem_chave") == 0) & (F.col("chaves_duplicadas") == 0)
    for c in required:
        sound = sound & (F.col(f"vazio_{c}") == 0)
    return counted.withColumn("esperadas", expected).withColumn(
        "valido", sound & (F.col("linhas") == F.col("esperadas"))
    )
