"""Score components of the frozen index as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_frozen(x: Column, p05: float, p95: float) -> Column:
    """100 x position of ``x`` between two fixed bounds, clipped; NULL stays NULL."""
    span = p95 - p05
    if span == 0:
        raise ValueError("frozen bounds must differ")
    scaled = (x - F.lit(float(p05))) / F.lit(float(span))
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNotNull(), clipped * 100.0)


def absorption_balance(hires: Column, separations: Column, c: float, lam: float) -> Column:
    return (hires + F.lit(float(c))) * 100.0 / (hires + separations + F.lit(float(lam)))


def quality_component(percent: Column, penalty: float) -> Column:
    """100 minus a capped penalty per percentage point; NULL stays NULL."""
    return F.when(
        percent.isNotNull(), F.lit(100.0) - F.least(F.lit(100.0), percent * float(penalty))
    )


def reliability_class(hires: Column, min_n: int, robust_n: int) -> Column:
    n = F.coalesce(hires, F.lit(0))
    return F.when(n >= robust_n, "higher").when(n >= min_n, "reduced")


def calculable(hires: Column, min_n: int) -> Column:
    return F.coalesce(hires, F.lit(0)) >= min_n


def wage_eligible(wage: Column, intermittent: Column, floor: Column, low: float, high: float) -> Column:
    """Not intermittent and inside [low, high] floors, both ends included.

    A missing flag makes the row ineligible.
    """
    inside = (wage >= floor * float(low)) & (wage <= floor * float(high)) & (wage > 0)
    return F.coalesce(~intermittent & inside, F.lit(False))
