"""Labelled 2-D shapes over given row ids.

A point depends on its id, the seed and the shape only: normal noise comes from hash bits, so the
points are the same for any partitioning and after any recomputation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.session import num_lit

_HASH_SPACE = float(2**40)


def uniform_sql(tag: str, seed: int, row_id: str = "row_id") -> str:
    """Uniform in (0, 1) from 40 hash bits."""
    return (
        f"((cast(conv(substr(md5(concat('{seed}-{tag}-', {row_id})), 1, 10), 16, 10) as double) + 0.5D)"
        f" / {num_lit(_HASH_SPACE)})"
    )


def normal_sql(tag: str, seed: int, row_id: str = "row_id") -> str:
    """Standard normal by the Box-Muller formula."""
    u, v = uniform_sql(tag + "u", seed, row_id), uniform_sql(tag + "v", seed, row_id)
    return f"(sqrt(-2 * ln({u})) * cos({num_lit(2 * math.pi)} * {v}))"


def _noisy(df: DataFrame, noise: str, seed: int) -> DataFrame:
    return df.select(
        "row_id",
        F.expr(f"x0 + {noise} * {normal_sql('a', seed)}").alias("x0"),
        F.expr(f"x1 + {noise} * {normal_sql('b', seed)}").alias("x1"),
        "label",
    )


def two_moons(ids: DataFrame, noise: float, seed: int) -> DataFrame:
    """Two interleaved half circles: even ids above, odd ids below."""
    t = f"({num_lit(math.pi)} * {uniform_sql('t', seed)})"
    base = ids.select(
        "row_id",
        F.expr(f"if(row_id % 2 = 0, cos({t}), 1 - cos({t}))").alias("x0"),
        F.expr(f"if(row_id % 2 = 0, sin({t}), 0.5D - sin({t}))").alias("x1"),
        F.expr("cast(row_id % 2 as int)").alias("label"),
    )
    return _noisy(base, num_lit(noise), seed)


def circles(ids: DataFrame, noise: float, factor: float, seed: int) -> DataFrame:
    """A circle and a smaller one inside it."""
    t = f"({num_lit(2 * math.pi)} * {uniform_sql('t', seed)})"
    r = f"if(row_id % 2 = 0, 1D, {num_lit(factor)})"
    base = ids.select(
        "row_id",
        F.expr(f"{r} * cos({t})").alias("x0"),
        F.expr(f"{r} * sin({t})").alias("x1"),
        F.expr("cast(row_id % 2 as int)").alias("label"),
    )
    return _noisy(base, num_lit(noise), seed)


def blobs(ids: DataFrame, centers: list, std: float | list[float], seed: int) -> DataFrame:
    """Normal clusters in equal parts, with one spread or one for each cluster."""
    k = len(centers)
    stds = [float(std)] * k if isinstance(std, (int, float)) else [float(s) for s in std]
    if len(stds) != k:
        raise ValueError("one deviation by centre is needed")
    label = f"cast(row_id % {k} as int)"

    def pick(values):
        return f"element_at(array({', '.join(num_lit(float(v)) for v in values)}), {label} + 1)"

    base = ids.select(
        "row_id",
        F.expr(pick([c[0] for c in centers])).alias("x0"),
        F.expr(pick([c[1] for c in centers])).alias("x1"),
        F.expr(label).alias("label"),
        F.expr(pick(stds)).alias("_std"),
    )
    return _noisy(base, "_std", seed)


def affine_project(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """``(x0, x1) . matrix``."""
    (a, b), (c, d) = matrix
    return df.withColumns(
        {
            "x0": F.expr(f"x0 * {num_lit(float(a))} + x1 * {num_lit(float(c))}"),
            "x1": F.expr(f"x0 * {num_lit(float(b))} + x1 * {num_lit(float(d))}"),
        }
    )


def classification(
    ids: DataFrame, seed: int, n_features: int = 20, n_informative: int = 10, n_redundant: int = 2, classes: int = 2
) -> DataFrame:
    """Two clusters by class at corners of a cube, mixed features and noise features."""
    clusters = 2 * classes
    cluster = f"cast(row_id % {clusters} as int)"
    out = ids.withColumn("label", F.expr(f"{cluster} % {classes}"))

    def corner(i):
        # the corner's sign comes from one bit of the cluster number
        return f"if(shiftright({cluster} + 1, {i % max(1, clusters.bit_length())}) % 2 = 0, -1D, 1D)"

    cols = {f"x{i}": F.expr(f"{corner(i)} + {normal_sql(f'f{i}', seed)}") for i in range(n_informative)}
    out = out.withColumns(cols)
    for r in range(n_redundant):
        terms = [f"{math.cos(1 + r + i):.6f}D * x{i}" for i in range(n_informative)]
        out = out.withColumn(f"x{n_informative + r}", F.expr(" + ".join(terms)))
    rest = range(n_informative + n_redundant, n_features)
    return out.withColumns({f"x{i}": F.expr(normal_sql(f"n{i}", seed)) for i in rest})
