"""Uncertainty, selection and row scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demur.functions.arrays import let, mean_of, median_of

# Names of the row scores.
METHODS = ("avg", "median", "min", "max")
# All-equal rows must keep their models although a mean of equal doubles may differ in the last digit.
TOLERANCE = 1e-12


def model_uncertainty(probas: str = "probas") -> Column:
    """1 - highest class probability, by model."""
    return F.expr(f"transform({probas}, p -> 1D - array_max(p))")


def row_score(values: str, method: str, strict: bool = True) -> Column:
    """One score by row from one value by model.

    ``strict``: an unknown name is an error (pool); otherwise it means the average (selector).
    """
    if strict and method not in (*METHODS, "mean"):
        raise ValueError(f"score method must be one of {METHODS + ('mean',)}, not {method!r}")
    if method == "median":
        return F.expr(median_of(values))
    if method == "min":
        return F.array_min(values)
    if method == "max":
        return F.array_max(values)
    return F.expr(mean_of(values))


def select_models(uncertainty: str = "uncertainty") -> Column:
    """Models that are at most as uncertain as the row's mean."""
    keep = f"transform({uncertainty}, u -> u <= mean + {TOLERANCE}D)"
    return F.expr(let("mean", mean_of(uncertainty), keep))


def select_competent(competences: str = "competences") -> Column:
    """Models that are at least as competent as the row's mean."""
    keep = f"transform({competences}, c -> c >= mean - {TOLERANCE}D)"
    return F.expr(let("mean", mean_of(competences), keep))


def normalise_rate(rate: float) -> float:
    """A rate above 1 is a percentage."""
    return rate / 100 if rate > 1 else rate


def normalised_rate(column: str) -> Column:
    """The same for a column of rates."""
    return F.expr(f"if({column} > 1, {column} / 100, {column})")


def score_key(score: Column, highest_first: bool = True) -> Column:
    """Integer order key: 9 digits of the score, smallest key = first to be rejected.

    Scores beyond 9.2e9 on either side share the last key, and row ids settle their order.
    """
    digits = F.least(F.greatest(F.round(F.round(score, 9) * F.lit(1e9), 0), F.lit(-9.2e18)), F.lit(9.2e18)).cast("bigint")
    return -digits if highest_first else digits
