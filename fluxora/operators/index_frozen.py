"""The index with frozen normalisation bounds, and its versioned specification."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxora.functions.numbers import ratio, valid_positive
from fluxora.functions.scoring import (
    absorption_balance,
    calculable,
    quality_component,
    reliability_class,
    score_frozen,
    wage_eligible,
)
from fluxora.functions.text import is_yes
from fluxora.operators.order_stats import (
    exact_quantiles,
    quantiles_of_counts,
    rank_where,
    value_counts,
)
from fluxora.operators.rank import with_stats
from fluxora.operators.territory import diversity, expand_to_universe

BOUND_COLUMNS = (
    "a_volume_raw", "salario_relativo_r4", "shannon_cbo", "shannon_subclasse", "shannon_secao",
)
DIVERSITY = {"cbo": "cbo2002ocupacao", "subclasse": "subclasse", "secao": "secao"}
REQUIRED = (
    "municipio", "uf", "saldomovimentacao", "admissao", "desligamento", "salario",
    "indtrabintermitente", "indtrabparcial", "cbo2002ocupacao", "subclasse", "secao",
)
INPUT_COUNTS = (
    "n_movimentacoes", "admissoes", "desligamentos", "saldo",
    "n_parcial", "n_intermitente", "n_salarios_r4", "n_cbo", "n_subclasse", "n_secao",
)
SCORE_COLUMNS = (
    "admissoes", "desligamentos", "n_movimentacoes", "saldo", "calculavel", "reliability_class",
    "a_volume_raw", "a_volume_score", "a_saldo", "absorcao",
    "n_salarios_r4", "salario_mediano_r4_municipio", "salario_mediano_r4_escopo",
    "salario_relativo_r4", "remuneracao",
    "n_parcial", "perc_parcial_admissao", "q_parcial",
    "n_intermitente", "perc_intermitente_admissao", "q_intermitente", "qualidade_contratual",
    "shannon_cbo", "shannon_subclasse", "shannon_secao",
    "d_cbo", "d_subclasse", "d_secao", "diversificacao",
    "indice", "rank_n10", "rank_n20",
    "methodology_version", "normalization_version", "reference_period",
)


class SpecError(ValueError):
    """The specification is inconsistent."""


class UnknownYearError(ValueError):
    """A movement lies in a year without a versioned wage floor."""


@dataclass(frozen=True)
class IndexSpec:
    methodology_version: str
    normalization_version: str
    reference_period: str
    weights: dict[str, float]
    absorption_weights: dict[str, float]
    contract_weights: dict[str, float]
    diversity_weights: dict[str, float]
    balance_c: float
    balance_lambda: float
    penalty: dict[str, float]
    min_calculable: int
    min_robust: int
    wage_low: float
    wage_high: float
    wage_floor: dict[int, float]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, group in self.weight_groups().items():
            if abs(sum(group.values()) - 1.0) > 1e-9:
                raise SpecError(f"weights of {name} must sum to 1")

    def weight_groups(self) -> dict[str, dict[str, float]]:
        return {
            "index": self.weights,
            "absorption": self.absorption_weights,
            "contract": self.contract_weights,
            "diversity": self.diversity_weights,
        }

    def with_bounds(self, bounds: dict[str, tuple[float, float]], version: str) -> IndexSpec:
        return replace(self, bounds=bounds, normalization_version=version)

    def floor_of(self, year: int) -> float:
        if year not in self.wage_floor:
            raise UnknownYearError(f"no wage floor for {year}")
        return self.wage_floor[year]


def load_spec(path: str | Path) -> IndexSpec:
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    raw["wage_floor"] = {int(y): float(v) for y, v in raw["wage_floor"].items()}
    raw["bounds"] = {k: (float(b["p05"]), float(b["p95"])) for k, b in raw["bounds"].items()}
    return IndexSpec(**raw)


def floor_table(spark: SparkSession, spec: IndexSpec) -> DataFrame:
    """(ano, salario_minimo): one row per calendar year of the specification."""
    rows = sorted(spec.wage_floor.items())
    return spark.createDataFrame(rows, "ano int, salario_minimo double")


def join_floor(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """Attach the wage floor of the year; unknown years keep NULL (see unknown_years)."""
    # Size bound: one row per calendar year, written by hand in the specification.
    return df.join(F.broadcast(floor_table(df.sparkSession, spec)), "ano", "left")


def unknown_years(df: DataFrame, spec: IndexSpec) -> DataFrame:
    return (
        df.join(F.broadcast(floor_table(df.sparkSession, spec)), "ano", "left_anti")
        .groupBy("ano")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))


def eligible_wages(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """Hires whose wage counts for pay: not intermittent and within the floor limits."""
    wage = valid_positive(F.col("salario"))
    ok = wage_eligible(
        wage, is_yes(F.col("indtrabintermitente")), F.col("salario_minimo"),
        spec.wage_low, spec.wage_high,
    )
    # A year without a floor fails the job: its wages must not vanish silently.
    unknown = F.col("ano").isNotNull() & F.col("salario_minimo").isNull()
    message = F.concat(F.lit("no wage floor for year "), F.col("ano").cast("string"))
    joined = join_floor(df, spec).withColumn(
        "salario_minimo",
        F.when(unknown, F.raise_error(message).cast("double")).otherwise(F.col("salario_minimo")),
    )
    return joined.where((F.col("admissao") == 1) & ok)


def relative_wages(
    df: DataFrame, period: Sequence[str], place: Sequence[str], spec: IndexSpec
) -> DataFrame:
    """Median eligible wage of each territory, of the whole scope, and their ratio."""
    period, place = list(period), list(place)
    wages = eligible_wages(df, spec).select(*period, *place, "salario")
    keys = [*period, *place]
    counts, rows = value_counts(wages, keys, "salario")
    # The counts per (territory, wage) serve the local and the pooled medians.
    local = quantiles_of_counts(counts, rows, keys, {"salario_mediano_r4_municipio": 0.5})
    pooled = exact_quantiles(counts, period, "__v", {"salario_mediano_r4_escopo": 0.5}, "__n")
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("n_salarios_r4"))
    joined = sizes.join(local, keys, "left")
    # Size bound: one row per calendar period.
    joined = joined.join(F.broadcast(pooled), period, "left")
    return joined.withColumn(
        "salario_relativo_r4",
        ratio(F.col("salario_mediano_r4_municipio"), F.col("salario_mediano_r4_escopo")),
    )


def index_inputs(
    df: DataFrame, period: Sequence[str], place: Sequence[str], spec: IndexSpec
) -> DataFrame:
    """One row per (period, territory) with every raw input of the four components."""
    require_columns(df)
    keys = [*period, *place]
    hire = F.col("admissao") == 1
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_movimentacoes"),
        F.sum(F.col("admissao").cast("long")).alias("admissoes"),
        F.sum(F.col("desligamento").cast("long")).alias("desligamentos"),
        F.sum(F.col("saldomovimentacao").cast("long")).alias("saldo"),
        F.count_if(hire & is_yes(F.col("indtrabparcial"))).alias("n_parcial"),
        F.count_if(hire & is_yes(F.col("indtrabintermitente"))).alias("n_intermitente"),
    )
    wages = relative_wages(df, period, place, spec)
    spread = diversity(df, keys, DIVERSITY)
    out = counts.join(wages, keys, "left").join(spread, keys, "left")
    return out.fillna(0, subset=["n_salarios_r4"])


def expand_index(inputs: DataFrame, spine: DataFrame, period: Sequence[str]) -> DataFrame:
    """All territories of the spine; the scope median belongs to the whole period."""
    keys = [c for c in spine.columns if c in inputs.columns]
    out = expand_to_universe(inputs, spine, keys, INPUT_COUNTS)
    median = "salario_mediano_r4_escopo"
    return with_stats(out, period, __scope=F.max(median)).withColumn(
        median, F.col("__scope")
    ).drop("__scope")


def score_index(inputs: DataFrame, period: Sequence[str], spec: IndexSpec) -> DataFrame:
    """Components, index, reliability and version stamps: column expressions only."""
    n, left = F.col("admissoes"), F.col("desligamentos")

    def share(count: str) -> Column:
        return ratio(F.col(count), n) * 100.0

    def frozen(name: str) -> Column:
        return score_frozen(F.col(name), *spec.bounds[name])

    def weighted(group: dict[str, float]) -> Column:
        total = F.lit(0.0)
        for name, weight in group.items():
            total = total + F.col(name) * F.lit(weight)
        return total

    out = (
        inputs.withColumns(
            {
                "a_volume_raw": F.log1p(n.cast("double")),
                "a_saldo": absorption_balance(n, left, spec.balance_c, spec.balance_lambda),
                "perc_parcial_admissao": share("n_parcial"),
                "perc_intermitente_admissao": share("n_intermitente"),
                "calculavel": calculable(n, spec.min_calculable),
                "reliability_class": reliability_class(n, spec.min_calculable, spec.min_robust),
                "remuneracao": frozen("salario_relativo_r4"),
                "d_cbo": frozen("shannon_cbo"),
                "d_subclasse": frozen("shannon_subclasse"),
                "d_secao": frozen("shannon_secao"),
            }
        )
        .withColumns(
            {
                "a_volume_score": frozen("a_volume_raw"),
                "q_parcial": quality_component(
                    F.col("perc_parcial_admissao"), spec.penalty["q_parcial"]
                ),
                "q_intermitente": quality_component(
                    F.col("perc_intermitente_admissao"), spec.penalty["q_intermitente"]
                ),
            }
        )
        .withColumns(
            {
                "absorcao": weighted(spec.absorption_weights),
                "qualidade_contratual": weighted(spec.contract_weights),
                "diversificacao": weighted(spec.diversity_weights),
            }
        )
    )
    # A NULL part makes the weighted sum NULL by itself.
    return out.withColumns(
        {
            "indice": F.when(F.col("calculavel"), weighted(spec.weights)),
            "methodology_version": F.lit(spec.methodology_version),
            "normalization_version": F.lit(spec.normalization_version),
            "reference_period": F.lit(spec.reference_period),
        }
    )


def rank_index(scored: DataFrame, period: Sequence[str], spec: IndexSpec) -> DataFrame:
    """Ranks in the two eligibility universes; territories outside keep NULL."""
    n = F.coalesce(F.col("admissoes"), F.lit(0))
    out = rank_where(scored, period, "indice", n >= spec.min_calculable, "rank_n10")
    return rank_where(out, period, "indice", n >= spec.min_robust, "rank_n20")


def fit_bounds(
    inputs: DataFrame, spec: IndexSpec, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """(variavel, p05, p95) pooled over every eligible territory-period of the window."""
    eligible = inputs.where(F.col("admissoes") >= spec.min_calculable)
    if "a_volume_raw" not in eligible.columns:
        eligible = eligible.withColumn("a_volume_raw", F.log1p(F.col("admissoes").cast("double")))
    tall = eligible.unpivot([], list(BOUND_COLUMNS), "variavel", "valor")
    return exact_quantiles(tall, ["variavel"], "valor", {"p05": low, "p95": high})


def bounds_from(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Fitted bounds as specification values (one row per bound variable)."""
    return {r["variavel"]: (r["p05"], r["p95"]) for r in rows.collect()}


def public_view(index: DataFrame, detail: Sequence[str]) -> DataFrame:
    """Score and ranks only where calculable; components stay visible."""
    shown = {
        c: F.when(F.col("calculavel"), F.col(c)) for c in ("indice", "rank_n10", "rank_n20")
    }
    return index.withColumns(shown).select(*detail)


def version_check(index: DataFrame, period: Sequence[str], spec: IndexSpec) -> DataFrame:
    """Per period: exactly one methodology and one normalisation version, as expected."""
    counted = index.groupBy(*period).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.count_distinct("methodology_version").alias("n_methodology"),
        F.count_distinct("normalization_version").alias("n_normalization"),
        F.max("methodology_version").alias("methodology_version"),
        F.max("normalization_version").alias("normalization_version"),
    )
    ok = (
        (F.col("n_methodology") == 1)
        & (F.col("n_normalization") == 1)
        & (F.col("methodology_version") == spec.methodology_version)
        & (F.col("normalization_version") == spec.normalization_version)
    )
    return counted.withColumn("compativel", F.coalesce(ok, F.lit(False)))
