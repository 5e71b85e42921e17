"""The index by principal components, for every period in one job.

Only moments leave the data: per period one row with means, deviations and pairwise
correlations.  The first eigenvector of each (at most 8 x 8) correlation matrix is found
in an Arrow batch of such rows; the scores are column expressions again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxora.functions.numbers import format_br, format_currency_br, format_ordinal
from fluxora.operators.order_stats import dense_rank_desc, join_null_safe
from fluxora.operators.rank import CLASS_MISSING, impute_median, minmax_score, quantile_classes
from fluxora.session import stage

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Dimension:
    name: str
    variables: tuple[str, ...]
    inverted: tuple[str, ...] = ()

    def sign(self, variable: str) -> int:
        return -1 if variable in self.inverted else 1


# Dimensions of the index, their variables and the inverted ones (fixed values).
DIMENSIONS = (
    Dimension(
        "dim_dinamismo",
        ("n_movimentacoes", "admissoes", "desligamentos", "saldo"),
        ("desligamentos",),
    ),
    Dimension(
        "dim_remuneracao",
        (
            "salario_mediano_admissao", "salario_medio_admissao",
            "salario_mediano_desligamento", "salario_medio_desligamento",
            "gap_salarial_adm_des",
        ),
    ),
    Dimension(
        "dim_qualidade_emprego",
        ("horas_media_admissao", "perc_parcial_admissao", "perc_intermitente_admissao"),
        ("perc_parcial_admissao", "perc_intermitente_admissao"),
    ),
    Dimension("dim_perfil_trabalhador", ("idade_media_admissao",)),
    Dimension(
        "dim_complexidade",
        (
            "n_cbo", "n_subclasse", "n_secao", "n_categoria",
            "shannon_cbo", "shannon_subclasse", "shannon_secao", "shannon_categoria",
        ),
    ),
)
DIMENSION_NAMES = tuple(d.name for d in DIMENSIONS)
# Status texts (fixed values).
CALCULATED, INSUFFICIENT = "calculado", "sem_dados_suficientes"


def first_loadings(correlations: list[float], useful: list[bool], signs: list[int]) -> list[float]:
    """Leading eigenvector over the useful variables, zero elsewhere.

    ``correlations`` lists the pairs (i < j) of the unsigned variables.  The vector is
    turned so that the first useful variable that is not inverted loads positively.
    """
    size = len(useful)
    matrix = np.eye(size)
    for (i, j), value in zip(combinations(range(size), 2), correlations):
        ok = useful[i] and useful[j] and value is not None
        matrix[i, j] = matrix[j, i] = value * signs[i] * signs[j] if ok else 0.0
    kept = [i for i in range(size) if useful[i]]
    out = [0.0] * size
    if not kept:
        return out
    _, vectors = np.linalg.eigh(matrix[np.ix_(kept, kept)])
    vector = vectors[:, -1]
    reference = next((p for p, i in enumerate(kept) if signs[i] > 0), 0)
    if vector[reference] < 0:
        vector = -vector
    for place, i in enumerate(kept):
        out[i] = float(vector[place])
    return out


def _loadings(correlations: Column, useful: Column, signs: list[int]) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for corr, mask in batches:
            yield pd.Series([first_loadings(c, m, signs) for c, m in zip(corr, mask)])

    return solve(correlations, useful)


def component_scores(
    df: DataFrame, period: Sequence[str], dimensions: Sequence[Dimension]
) -> DataFrame:
    """Add one score column per dimension, period by period.

    A variable is useful with at least two distinct values.  No useful variable gives
    NULL, one gives its sample z-score, more give the first principal component of the
    standardised variables.
    """
    period = list(period)
    names = list(dict.fromkeys(v for d in dimensions for v in d.variables))
    spread = [(F.min(v) < F.max(v)).alias(f"__u_{v}") for v in names]
    useful_row = df.groupBy(*period).agg(*spread)

    filled = stage(impute_median(df, period, names), "imputed")
    moments = [F.avg(v).alias(f"__m_{v}") for v in names]
    moments += [F.stddev_pop(v).alias(f"__p_{v}") for v in names]
    moments += [F.stddev_samp(v).alias(f"__s_{v}") for v in names]
    for d in dimensions:
        moments += [
            F.covar_pop(a, b).alias(f"__c_{d.name}_{i}")
            for i, (a, b) in enumerate(combinations(d.variables, 2))
        ]
    rows = join_null_safe(filled.groupBy(*period).agg(*moments), useful_row, period, "left")

    def correlations(d: Dimension) -> Column:
        """Pairwise correlations; NULL where a variable is constant."""
        cells = [
            F.col(f"__c_{d.name}_{i}")
            / F.nullif(F.col(f"__p_{a}") * F.col(f"__p_{b}"), F.lit(0.0))
            for i, (a, b) in enumerate(combinations(d.variables, 2))
        ]
        return F.array(*cells).cast("array<double>")

    def mask(d: Dimension) -> Column:
        return F.array(*[F.coalesce(F.col(f"__u_{v}"), F.lit(False)) for v in d.variables])

    rows = rows.withColumns(
        {
            f"__l_{d.name}": _loadings(
                correlations(d), mask(d), [d.sign(v) for v in d.variables]
            )
            for d in dimensions
        }
    )
    # Size bound: one row of moments per calendar period.
    joined = join_null_safe(filled, F.broadcast(rows), period, "left")

    def score(d: Dimension) -> Column:
        n_useful = F.size(F.filter(mask(d), lambda u: u))
        component, single = F.lit(0.0), F.lit(0.0)
        for i, v in enumerate(d.variables):
            centred = (F.col(v) - F.col(f"__m_{v}")) * d.sign(v)
            used = F.col(f"__u_{v}")
            part = F.get(f"__l_{d.name}", F.lit(i)) * centred / F.nullif(F.col(f"__p_{v}"), F.lit(0.0))
            component = component + F.when(used, part).otherwise(0.0)
            alone = centred / F.nullif(F.col(f"__s_{v}"), F.lit(0.0))
            single = single + F.when(used, F.coalesce(alone, F.lit(0.0))).otherwise(0.0)
        return F.when(n_useful > 1, component).when(n_useful == 1, single)

    scored = joined.withColumns({d.name: score(d) for d in dimensions})
    originals = df.select(*period, *[c for c in df.columns if c not in period])
    # Imputed inputs are internal: the caller keeps its own columns.
    kept = [c for c in originals.columns if c not in names]
    return scored.select(*kept, *names, *[d.name for d in dimensions])


def dimension_scores(indicators: DataFrame, period: Sequence[str], place: Sequence[str]) -> DataFrame:
    """Dimension columns for every territory; NULL where data are insufficient."""
    keys = [*period, *place]
    enough = (F.col("admissoes") > 0) & (F.col("n_movimentacoes") > 0)
    variables = list(dict.fromkeys(v for d in DIMENSIONS for v in d.variables))
    analytic = indicators.where(enough).select(
        *keys, *[F.col(v).cast("double").alias(v) for v in variables]
    )
    scores = component_scores(analytic, period, DIMENSIONS).select(*keys, *DIMENSION_NAMES)
    return join_null_safe(indicators, scores, keys, "left")


def final_index(scored: DataFrame, period: Sequence[str], place: Sequence[str]) -> DataFrame:
    """Index 0-100 from the first component of the dimensions, with its status."""
    keys = [*period, *place]
    enough = (F.col("admissoes") > 0) & (F.col("n_movimentacoes") > 0)
    analytic = scored.where(enough).select(*keys, *DIMENSION_NAMES)
    whole = Dimension("bruto", DIMENSION_NAMES)
    raw = component_scores(analytic, period, [whole]).select(*keys, "bruto")
    scaled = minmax_score(stage(raw, "raw-index"), period, "bruto", "indice").drop("bruto")
    out = join_null_safe(scored, scaled, keys, "left")
    status = F.when(F.col("indice").isNotNull(), CALCULATED).otherwise(INSUFFICIENT)
    return out.withColumn("status_calculo", status)


def derive(index: DataFrame, period: Sequence[str]) -> DataFrame:
    """Rank, min-max percentile, class and the readable summary of each row."""
    out = dense_rank_desc(index, period, "indice", "ranking")
    out = minmax_score(out, period, "indice", "percentil")
    out = quantile_classes(stage(out, "ranked-index"), period, "indice", "classe")
    return out.withColumn("resumo", summary_text(DIMENSION_LABELS))


def pca_index(indicators: DataFrame, period: Sequence[str], place: Sequence[str]) -> DataFrame:
    staged = stage(indicators, "indicators")
    scored = stage(dimension_scores(staged, period, place), "dimensions")
    return derive(stage(final_index(scored, period, place), "index"), period)


DIMENSION_LABELS = {
    "Dinamismo": "dim_dinamismo",
    "Remuneração": "dim_remuneracao",
    "Qualidade": "dim_qualidade_emprego",
    "Perfil": "dim_perfil_trabalhador",
    "Complexidade": "dim_complexidade",
}


def summary_text(
    parts: dict[str, str],
    wage: str = "salario_mediano_admissao",
    diversity: str = "shannon_cbo",
) -> Column:
    """Several lines of text per territory; another text where the index is missing."""

    def line(cells: dict[str, Column]) -> Column:
        return F.concat_ws(
            " | ", *[F.concat(F.lit(f"{name}: "), cell) for name, cell in cells.items()]
        )

    head = line(
        {
            "Índice": format_br(F.col("indice"), 1),
            "Classe": F.coalesce(F.trim("classe"), F.lit("--")),
            "Ranking": format_ordinal(F.col("ranking")),
            "Percentil": format_br(F.col("percentil"), 1),
        }
    )
    counts = line(
        {
            "Admissões": format_br(F.col("admissoes"), 0),
            "Desligamentos": format_br(F.col("desligamentos"), 0),
            "Saldo": format_br(F.col("saldo"), 0),
        }
    )
    dims = F.concat_ws(
        " | ",
        *[F.concat(F.lit(f"{n} "), format_br(F.col(c), 2)) for n, c in parts.items()],
    )
    full = F.concat_ws(
        "\n",
        F.trim("municipio"),
        head,
        counts,
        F.concat(F.lit("Salário admissão: "), format_currency_br(F.col(wage))),
        F.concat(F.lit("Dimensões: "), dims),
        F.concat(F.lit("Shannon CBO: "), format_br(F.col(diversity), 2)),
    )
    empty = F.concat_ws("\n", F.trim("municipio"), F.lit(f"Status: {CLASS_MISSING}"))
    return F.when(F.col("indice").isNull(), empty).otherwise(full)
