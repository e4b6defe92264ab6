"""Rejection by rate, by threshold and by empty selection.

Class indices are kept as ``pred_idx``; ``pred`` is the label and is NULL for a rejected row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.functions.fusion import decide, fuse_masked_mean
from demur.functions.scores import (
    METHODS,
    model_uncertainty,
    normalise_rate,
    row_score,
    score_key,
    select_models,
)
from demur.operators.order import before_cut, method_cuts


def with_uncertainty(scored: DataFrame) -> DataFrame:
    """Adds ``uncertainty array<double>``."""
    return scored.withColumn("uncertainty", model_uncertainty("probas"))


def label_of(index: str, labels: list) -> Column:
    """Label of a class index."""
    return F.element_at(F.array(*[F.lit(v) for v in labels]), F.col(index) + 1)


def reject_top_rate(
    scored: DataFrame, score: Column, rate: float, highest_first: bool = True
) -> DataFrame:
    """Adds ``rejected``: the ``floor(rate * n)`` rows that come first by (score, row_id)."""
    keyed = scored.withColumn("_key", score_key(score, highest_first))
    _, cuts = method_cuts(keyed, {"_": F.col("_key")}, [rate])
    return keyed.withColumn("rejected", F.expr(before_cut("_key", "row_id", cuts[("_", rate)]))).drop("_key")


def reject_low_competence(scored: DataFrame, method: str, rate: float) -> DataFrame:
    """Adds ``rejected`` by lowest competence; an unknown method name means the average."""
    return reject_top_rate(scored, row_score("competences", method, strict=False), rate, highest_first=False)


def reject_threshold(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """Adds ``rejected``: score above the threshold. Row-local."""
    return scored.withColumn("rejected", F.round(score, 9) > threshold)


def reject_if_none_competent(scored: DataFrame, threshold: float) -> DataFrame:
    """Adds ``selected`` by a fixed competence cut and rejects rows that no model passes."""
    picked = F.transform("competences", lambda c: F.round(c, 9) >= threshold)
    return scored.withColumn("selected", picked).withColumn(
        "rejected", ~F.exists("selected", lambda s: s)
    )


def pool_decision(scored: DataFrame, labels: list) -> DataFrame:
    """Adds uncertainty, selection and the fused decision; independent of rate and method."""
    return (
        with_uncertainty(scored)
        .withColumn("selected", select_models("uncertainty"))
        .withColumn("fused", fuse_masked_mean("probas", "selected"))
        .withColumn("pred_idx", decide("fused"))
        .withColumn("pred_label", label_of("pred_idx", labels))
    )


def reject_predict(scored: DataFrame, labels: list, rate: float, method: str = "avg") -> DataFrame:
    """Pool prediction with rejection of the ``floor(rate * n)`` most uncertain rows."""
    if method not in (*METHODS, "mean"):
        row_score("uncertainty", method)  # raises
    decided = pool_decision(scored, labels).withColumn("score", row_score("uncertainty", method))
    out = reject_top_rate(decided, F.col("score"), normalise_rate(rate))
    return out.withColumn("pred", F.when(~F.col("rejected"), F.col("pred_label")))


def reject_alert(predicted: DataFrame) -> DataFrame:
    """One row: counts and whether nothing or everything was rejected."""
    return predicted.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("rejected").alias("n_rejected")
    ).withColumn(
        "status",
        F.when(F.col("n_rejected") == 0, "none rejected")
        .when(F.col("n_rejected") == F.col("n_rows"), "all rejected")
        .otherwise("ok"),
    )
