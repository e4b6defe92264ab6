"""Fusion rules over ``probas array<array<double>>`` (outer index = model, inner = class).

Each rule gives one ``array<double>`` of scores by class; the decision is its first maximum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demur.functions.arrays import argmax_index, let, median_of, sum_of

# Names of the fusion rules.
RULES = (
    "majority_voting",
    "sum_rule",
    "product_rule",
    "max_rule",
    "min_rule",
    "median_rule",
    "borda_count",
)


def _merge(probas: str, start: str, step: str) -> str:
    """Class-wise fold over the models."""
    return (
        f"aggregate({probas}, transform({probas}[0], v -> {start}),"
        f" (acc, p) -> zip_with(acc, p, (a, b) -> {step}))"
    )


def fuse_sum(probas: str = "probas") -> Column:
    # 9 digits, so that ties in exact arithmetic stay ties in doubles
    return F.expr(f"transform({_merge(probas, '0D', 'a + b')}, v -> round(v, 9))")


def fuse_product(probas: str = "probas") -> Column:
    return F.expr(_merge(probas, "1D", "a * b"))


def fuse_max(probas: str = "probas") -> Column:
    return F.expr(_merge(probas, "double('-Infinity')", "greatest(a, b)"))


def fuse_min(probas: str = "probas") -> Column:
    return F.expr(_merge(probas, "double('Infinity')", "least(a, b)"))


def fuse_median(probas: str = "probas") -> Column:
    middle = median_of(f"transform({probas}, p -> p[c])")
    return F.expr(f"transform(sequence(0, size({probas}[0]) - 1), c -> round({middle}, 9))")


def fuse_borda(probas: str = "probas") -> Column:
    """Sum over models of the class rank 0..C-1 by ascending probability, ties by class index."""
    ranks = (
        f"transform({probas}, p -> transform(p, (x, i) ->"
        " cast(size(filter(p, (q, j) -> q < x or (q = x and j < i))) as double)))"
    )
    return F.expr(_merge(ranks, "0D", "a + b"))


def model_labels(probas: str = "probas") -> Column:
    """Predicted class index of every model."""
    return F.expr(f"transform({probas}, p -> cast(array_position(p, array_max(p)) - 1 as int))")


def class_votes(preds: str, n_classes: int, selected: str | None = None) -> Column:
    """Votes by class, over the selected models only if a mask is given."""
    votes = preds
    if selected:
        votes = f"filter({preds}, (v, i) -> {selected}[i])"
    return F.expr(
        f"transform(sequence(0, {n_classes - 1}), c -> cast(size(filter({votes}, v -> v = c)) as double))"
    )


def fuse_majority(preds: str, n_classes: int) -> Column:
    return class_votes(preds, n_classes)


def fuse_hard_share(preds: str, n_classes: int, selected: str) -> Column:
    """Share of the selected models' votes by class."""
    votes = f"filter({preds}, (v, i) -> {selected}[i])"
    shares = f"transform(sequence(0, {n_classes - 1}), c -> size(filter(votes, v -> v = c)) / size(votes))"
    return F.expr(let("votes", votes, shares))


def fuse_masked_mean(probas: str, selected: str) -> Column:
    """Mean probability by class over the selected models."""
    mean = f"transform({_merge('kept', '0D', 'a + b')}, v -> round(v / size(kept), 9))"
    return F.expr(let("kept", f"filter({probas}, (p, i) -> {selected}[i])", mean))


def fuse_weighted(probas: str, weights: str, selected: str | None = None) -> Column:
    """Weighted mean by class: all models ("weighting") or the selected ones ("hybrid")."""
    w = weights if selected is None else f"transform({weights}, (w, i) -> if({selected}[i], w, 0D))"
    scaled = f"zip_with({probas}, ws, (p, w) -> transform(p, x -> x * w))"
    mean = let("total", sum_of("ws"), f"transform({_merge('scaled', '0D', 'a + b')}, v -> round(v / total, 9))")
    return F.expr(let("ws", w, let("scaled", scaled, mean)))


def fuse_weighted_votes(preds: str, weights: str, n_classes: int, selected: str | None = None) -> Column:
    """Weighted votes by class, as shares of the total weight."""
    w = weights if selected is None else f"transform({weights}, (w, i) -> if({selected}[i], w, 0D))"
    mine = sum_of(f"zip_with({preds}, ws, (v, w) -> if(v = c, w, 0D))")
    shares = f"transform(sequence(0, {n_classes - 1}), c -> round({mine} / total, 9))"
    return F.expr(let("ws", w, let("total", sum_of("ws"), shares)))


def fuse(rule: str, n_classes: int, probas: str = "probas", preds: str = "preds") -> Column:
    """Scores by class for a rule name of ``RULES``."""
    if rule == "majority_voting":
        return fuse_majority(preds, n_classes)
    by_name = {
        "sum_rule": fuse_sum,
        "product_rule": fuse_product,
        "max_rule": fuse_max,
        "min_rule": fuse_min,
        "median_rule": fuse_median,
        "borda_count": fuse_borda,
    }
    if rule not in by_name:
        raise ValueError(f"unknown fusion rule {rule!r}")
    return by_name[rule](probas)


def decide(scores: Column | str) -> Column:
    """Class index of the first maximum."""
    return argmax_index(scores)
