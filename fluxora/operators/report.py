"""Report blocks over an index table: one row per territory and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxora.functions.numbers import ratio
from fluxora.operators.order_stats import exact_quantiles, join_null_safe
from fluxora.operators.rank import CLASS_MISSING, top_bottom, top_within


def index_summary(index: DataFrame, period: Sequence[str], score: str, rank: str) -> DataFrame:
    """Totals, coverage, mean / median / range and the leader of every period."""
    valid = F.col(score).isNotNull()
    leader = F.min_by(
        F.when(valid, F.struct("municipio", rank)), F.when(valid, F.struct(rank, "municipio"))
    )
    base = index.groupBy(*period).agg(
        F.count(F.lit(1)).alias("municipios_total"),
        F.count(score).alias("municipios_com_indice"),
        F.avg(score).alias("media"),
        F.min(score).alias("minimo"),
        F.max(score).alias("maximo"),
        leader.alias("__leader"),
        *[
            F.coalesce(F.sum(F.when(valid, F.col(m))), F.lit(0).cast("long")).alias(f"{m}_total")
            for m in ("admissoes", "desligamentos", "saldo")
        ],
    )
    medians = exact_quantiles(index, period, score, {"mediana": 0.5})
    out = join_null_safe(base, medians, period, "left")
    covered = F.col("municipios_com_indice")
    return out.select(
        *period,
        "municipios_total",
        "municipios_com_indice",
        (F.col("municipios_total") - covered).alias("municipios_sem_base"),
        (ratio(covered, F.col("municipios_total")) * 100.0).alias("percentual_com_indice"),
        "media",
        "mediana",
        "minimo",
        "maximo",
        F.col("__leader.municipio").alias("municipio_lider"),
        F.col(f"__leader.{rank}").alias("ranking_lider"),
        "admissoes_total",
        "desligamentos_total",
        "saldo_total",
    )


def monthly_evolution(
    index: DataFrame, period: Sequence[str], score: str, rank: str, upto: Column
) -> DataFrame:
    """The summary of every period up to a target one, in order."""
    return index_summary(index.where(upto), period, score, rank).orderBy(*period)


def class_distribution(index: DataFrame, period: Sequence[str], label: str) -> DataFrame:
    name = F.coalesce(F.col(label), F.lit(CLASS_MISSING)).alias("classe")
    return index.groupBy(*period, name).agg(F.count(F.lit(1)).alias("n"))


def dimension_summary(
    index: DataFrame, period: Sequence[str], score: str, dimensions: Sequence[str]
) -> DataFrame:
    """Per dimension: mean, median, range and the territories at both ends."""
    tall = (
        index.where(F.col(score).isNotNull())
        .select(*period, "municipio", *dimensions)
        .unpivot([*period, "municipio"], list(dimensions), "dimensao", "valor")
        .where(F.col("valor").isNotNull())
    )
    keys = [*period, "dimensao"]
    # Ties go to the first name.
    base = tall.groupBy(*keys).agg(
        F.avg("valor").alias("media"),
        F.min("valor").alias("minimo"),
        F.max("valor").alias("maximo"),
        F.min_by("municipio", F.struct(-F.col("valor"), "municipio")).alias("municipio_maior"),
        F.min_by("municipio", F.struct("valor", "municipio")).alias("municipio_menor"),
    )
    medians = exact_quantiles(tall, keys, "valor", {"mediana": 0.5})
    return join_null_safe(base, medians, keys, "left")


def diagnostic_flags(
    index: DataFrame,
    period: Sequence[str],
    score: str,
    rank: str,
    rules: dict[str, tuple[str, str]],
    low: float = 0.0,
    leaders: int = 20,
) -> DataFrame:
    """Territories that stand out in one dimension while another is below ``low``.

    ``rules`` maps a flag to (strong, weak).  With ``strong`` equal to the rank column
    the first ``leaders`` territories qualify, otherwise those strictly above the 75th
    percentile of that dimension in their period.
    """
    valid = index.where(F.col(score).isNotNull())
    strong = sorted({s for s, _ in rules.values() if s != rank})
    parts = []
    if strong:
        tall = valid.unpivot([*period], strong, "__dim", "__val")
        cuts = exact_quantiles(tall, [*period, "__dim"], "__val", {"__p75": 0.75})
        wide = cuts.groupBy(*period).agg(
            *[F.max(F.when(F.col("__dim") == s, F.col("__p75"))).alias(f"__p75_{s}") for s in strong]
        )
        # Size bound: one row per calendar period.
        cut_rows = join_null_safe(valid, F.broadcast(wide), list(period), "left")
    for flag, (first, weak) in rules.items():
        if first == rank:
            order = [F.asc(rank), F.asc("municipio")]
            chosen = top_within(valid, period, order, leaders).where(F.col(weak) < low)
        else:
            chosen = cut_rows.where(
                (F.col(first) > F.col(f"__p75_{first}")) & (F.col(weak) < low)
            )
        parts.append(
            chosen.select(
                *period,
                F.lit(flag).alias("alerta"),
                "municipio",
                F.col(score).alias("indice"),
                F.col(rank).alias("ranking"),
                F.col(weak).alias("valor"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def index_kpis(index: DataFrame, period: Sequence[str], score: str) -> DataFrame:
    valid = F.col(score).isNotNull()
    return index.groupBy(*period).agg(
        F.count(score).alias("calculados"),
        F.avg(score).alias("media"),
        F.min_by(
            "municipio", F.when(valid, F.struct(-F.col(score), F.col("municipio")))
        ).alias("municipio_topo"),
        F.max(score).alias("indice_topo"),
        F.count_if(~valid).alias("insuficientes"),
        F.count_if(F.col("reliability_class") == "reduced").alias("n_reduced"),
        F.count_if(F.col("reliability_class") == "higher").alias("n_higher"),
    )


def run_summary(
    index: DataFrame, period: Sequence[str], status: str, label: str, rank: str, k: int = 10
) -> DataFrame:
    """Counts by status and by class, the first k ranks and five samples per status."""
    keys = list(period)

    def counted(column: str, block: str) -> DataFrame:
        return index.groupBy(*keys, F.col(column).alias("rotulo")).agg(
            F.count(F.lit(1)).alias("n")
        ).select(*keys, F.lit(block).alias("bloco"), "rotulo", "n")

    first = top_within(
        index.where(F.col(rank).isNotNull()), keys, [F.asc(rank), F.asc("municipio")], k
    )
    sample = top_within(index, [*keys, status], [F.asc("municipio")], 5)
    tops = first.select(
        *keys,
        F.lit("ranking").alias("bloco"),
        F.col("municipio").alias("rotulo"),
        F.col("pos").cast("long").alias("n"),
    )
    samples = sample.select(
        *keys,
        F.concat(F.lit("amostra_"), F.col(status)).alias("bloco"),
        F.col("municipio").alias("rotulo"),
        F.col("pos").cast("long").alias("n"),
    )
    return (
        counted(status, "status")
        .unionByName(counted(label, "classe"))
        .unionByName(tops)
        .unionByName(samples)
    )


REPORT_BLOCKS = ("summary", "classes", "top_bottom", "dimensions", "alerts")


def report_json(
    index: DataFrame,
    period: Sequence[str],
    score: str,
    rank: str,
    label: str,
    dimensions: Sequence[str],
    rules: dict[str, tuple[str, str]],
    low: float = 0.0,
) -> DataFrame:
    """The report as JSON lines: (period, bloco, documento).

    One line per summary, class, list entry, dimension and alert, so no block of a hot
    period has to fit into one row.  Doubles are rounded to two digits.
    """
    keys = list(period)
    blocks = {
        "summary": index_summary(index, keys, score, rank),
        "classes": class_distribution(index, keys, label),
        "top_bottom": top_bottom(
            index.select(*keys, "municipio", rank, score), keys, rank, ["municipio"]
        ),
        "dimensions": dimension_summary(index, keys, score, dimensions),
        "alerts": diagnostic_flags(index, keys, score, rank, rules, low),
    }

    def lines(name: str, df: DataFrame) -> DataFrame:
        cells = [
            F.round(c, 2).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
            if c not in keys
        ]
        return df.select(
            *keys, F.lit(name).alias("bloco"), F.to_json(F.struct(*cells)).alias("documento")
        )

    parts = [lines(name, df) for name, df in blocks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_problems(
    report: DataFrame,
    period: Sequence[str],
    required: Sequence[str] = ("summary", "classes", "top_bottom", "dimensions"),
) -> DataFrame:
    """Periods with a missing block or a line that carries a NaN."""
    checked = report.groupBy(*period).agg(
        F.array_except(
            F.array(*[F.lit(b) for b in required]), F.collect_set("bloco")
        ).alias("faltando"),
        F.count_if(F.col("documento").contains("NaN")).alias("linhas_nan"),
    )
    return checked.where((F.size("faltando") > 0) | (F.col("linhas_nan") > 0))
