"""Array expressions on SQL text. ``col`` is any SQL expression that yields an array of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, so that the value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sum_of(col: str) -> str:
    return f"aggregate({col}, 0D, (s, x) -> s + x)"


def mean_of(col: str) -> str:
    return f"({sum_of(col)} / size({col}))"


def median_of(col: str) -> str:
    """Middle value, or the mean of the two middle values."""
    middle = "(o[cast((size(o) - 1) div 2 as int)] + o[cast(size(o) div 2 as int)]) / 2"
    return let("o", f"sort_array({col})", middle)


def softmax(col: str) -> str:
    """Probabilities from log scores, shifted by their maximum before exp."""
    powers = let("top", f"array_max({col})", f"transform({col}, x -> exp(x - top))")
    scaled = let("total", sum_of("e"), "transform(e, x -> x / total)")
    return let("e", powers, scaled)


def argmax_index(col: str | Column) -> Column:
    """0-based index of the first maximum."""
    column = F.col(col) if isinstance(col, str) else col
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def euclid(a: str, b: str) -> str:
    return f"sqrt({sum_of(f'zip_with({a}, {b}, (u, v) -> (u - v) * (u - v))')})"


def dot(a: str, b: str) -> str:
    return sum_of(f"zip_with({a}, {b}, (u, v) -> u * v)")
