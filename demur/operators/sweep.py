"""Metrics over a whole grid of methods, rates and thresholds in one aggregate.

The prediction of a row does not depend on method or rate, only its acceptance does. With the exact
cuts of each (method, rate) cell as literals, a row knows at how many of the ascending rates it is
still accepted (``level``); counts by (method, level, y, pred) then hold every cell's confusion
matrix. Rows are never ranked or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.functions.scores import METHODS, row_score, score_key
from demur.operators.metrics import average_mode, metrics_from_confusion, positive_label
from demur.operators.order import Cut, before_cut, method_cuts


def complete_rates(rates: Iterable[float], required: float = 0.0) -> list[float]:
    """Sorted distinct rates with ``required`` among them; a rate outside [0, 1] is an error."""
    rates = [float(r) for r in rates]
    if any(r < 0 or r > 1 for r in rates):
        raise ValueError("rates must lie between 0 and 1")
    return sorted({*rates, float(required)})


def sweep_grid(spark, methods: Iterable[str], rates: Iterable[float], thresholds: Iterable[float] = ()) -> DataFrame:
    """The grid as a table, made by exploding literals."""
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    grid = grid.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    thresholds = list(thresholds)
    if thresholds:
        grid = grid.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return grid


def _level(key: str, cuts: list[Cut], row_id: str = "row_id") -> Column:
    """At how many of the ascending cuts the row is still accepted."""
    terms = [f"cast(not {before_cut(key, row_id, c)} as int)" for c in cuts]
    return F.expr(" + ".join(terms))


def _levels(
    decided: DataFrame,
    scores: dict[str, Column],
    rates: list[float],
    highest_first: bool,
    carry: list[str],
) -> DataFrame:
    """Rows exploded by method with their level; still row-local after the cuts are known."""
    keys = {m: score_key(c, highest_first) for m, c in scores.items()}
    _, cuts = method_cuts(decided, keys, rates)
    keyed = decided.select(*carry, "row_id", *[k.alias(f"_key_{i}") for i, k in enumerate(keys.values())])
    each = [
        F.struct(F.lit(m).alias("method"), _level(f"_key_{i}", [cuts[(m, r)] for r in rates]).alias("level"))
        for i, m in enumerate(keys)
    ]
    return keyed.select(*carry, "row_id", F.explode(F.array(*each)).alias("e")).select(*carry, "row_id", "e.*")


def _curve(levels: DataFrame, rates: list[float], by: list[str], labels: list) -> DataFrame:
    """Metrics of every cell from counts by level."""
    cells = (
        levels.where("level > 0")
        .groupBy(*by, "method", "level", "y", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rate_of = F.array(*[F.lit(r) for r in rates])
    cells = (
        cells.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("level"))))
        .groupBy(*by, "method", "j", "y", "pred")
        .agg(F.sum("n").alias("n"))
    )
    keys = [*by, "method", "j"]
    return metrics_from_confusion(cells, keys, average_mode(labels), positive_label(labels)).select(
        *by, "method", F.element_at(rate_of, F.col("j")).alias("rate"), "accuracy", "precision", "recall", "f1"
    )


def pool_scores(methods: Iterable[str]) -> dict[str, Column]:
    return {m: row_score("uncertainty", m) for m in methods}


def competence_scores(methods: Iterable[str]) -> dict[str, Column]:
    return {m: row_score("competences", m, strict=False) for m in methods}


def sweep_rates(
    decided: DataFrame,
    labels: list,
    rates: Iterable[float],
    methods: Iterable[str] = METHODS,
    kind: str = "pool",
    y: str = "y",
    pred: str = "pred_label",
) -> DataFrame:
    """Accuracy, precision, recall and F1 on accepted rows by (method, rate); 0 is always a rate.

    ``decided`` comes from ``pool_decision`` (kind "pool", most uncertain first) or from the selector
    (kind "selector", least competent first). ``labels`` are those of the whole y.
    """
    rates = complete_rates(rates)
    scores = pool_scores(methods) if kind == "pool" else competence_scores(methods)
    rows = decided.withColumn("_y", F.col(y)).withColumn("_pred", F.col(pred))
    levels = _levels(rows, scores, rates, kind == "pool", ["_y", "_pred"])
    levels = levels.withColumnsRenamed({"_y": "y", "_pred": "pred"})
    return _curve(levels, rates, [], labels)


def first_reject_rate(
    decided: DataFrame, rates: Iterable[float], methods: Iterable[str] = METHODS, kind: str = "pool"
) -> DataFrame:
    """Lowest rate at which each row is rejected, by method; rate 1 rejects every row."""
    rates = complete_rates(rates, required=1.0)
    scores = pool_scores(methods) if kind == "pool" else competence_scores(methods)
    return _first_rates(_levels(decided, scores, rates, kind == "pool", []), rates)


def _first_rates(levels: DataFrame, rates: list[float]) -> DataFrame:
    """A row that passes ``level`` of the ascending rates is refused at the next one."""
    rate_of = F.array(*[F.lit(r) for r in rates])
    return levels.select("row_id", "method", F.element_at(rate_of, F.col("level") + 1).alias("rate"))


def sweep_history(
    decided: DataFrame,
    labels: list,
    rates: Iterable[float],
    methods: Iterable[str] = METHODS,
    kind: str = "pool",
) -> tuple[DataFrame, DataFrame]:
    """``(curve, history)`` from one set of cuts: rate 1 is added for the history but accepts no row."""
    full = complete_rates(rates, required=1.0)
    scores = pool_scores(methods) if kind == "pool" else competence_scores(methods)
    rows = decided.withColumn("_y", F.col("y")).withColumn("_pred", F.col("pred_label"))
    levels = _levels(rows, scores, full, kind == "pool", ["_y", "_pred"])
    levels = levels.withColumnsRenamed({"_y": "y", "_pred": "pred"})
    return _curve(levels, full, [], labels), _first_rates(levels, full)


def sweep_thresholds(
    scored: DataFrame,
    labels: list,
    rates: Iterable[float],
    thresholds: Iterable[float],
    decide_at,
    methods: Iterable[str] = METHODS,
) -> DataFrame:
    """Adds an axis of selection thresholds.

    ``decide_at(threshold)`` gives the column with the decision (label) at that threshold. The row
    scores do not depend on it, so one set of cuts serves all thresholds.
    """
    rates = complete_rates(rates)
    thresholds = [float(t) for t in thresholds]
    rows = scored.withColumn(
        "_at",
        F.array(*[F.struct(F.lit(t).alias("threshold"), decide_at(t).alias("pred")) for t in thresholds]),
    )
    levels = _levels(rows, competence_scores(methods), rates, False, ["y", "_at"])
    levels = levels.select("y", "method", "level", F.explode("_at").alias("t")).select(
        "y", "method", "level", "t.threshold", "t.pred"
    )
    return _curve(levels.where("pred is not null"), rates, ["threshold"], labels)


def sweep_models(
    scored: DataFrame, labels: list, model_names: list[str], rates: Iterable[float]
) -> DataFrame:
    """One curve for every single model: its own uncertainty orders the rows, its own label decides."""
    rates = complete_rates(rates)
    label_array = F.array(*[F.lit(v) for v in labels])
    scores = {name: F.expr(f"1D - array_max(probas[{i}])") for i, name in enumerate(model_names)}
    rows = scored.withColumn(
        "_preds",
        F.create_map(
            *[
                x
                for i, name in enumerate(model_names)
                for x in (
                    F.lit(name),
                    F.element_at(label_array, F.expr(f"cast(array_position(probas[{i}], array_max(probas[{i}])) as int)")),
                )
            ]
        ),
    )
    levels = _levels(rows, scores, rates, True, ["y", "_preds"])
    levels = levels.select("y", "method", "level", F.col("_preds")[F.col("method")].alias("pred"))
    curve = _curve(levels, rates, [], labels)
    return curve.withColumnRenamed("method", "model")


def new_rejections(history: DataFrame) -> DataFrame:
    """How many rows are rejected for the first time at each (method, rate)."""
    return history.groupBy("method", "rate").agg(F.count(F.lit(1)).alias("n_new"))
