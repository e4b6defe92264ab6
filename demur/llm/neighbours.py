"""Approximate nearest neighbours with learnt partitions.

A bounded sample's neighbour graph is cut into balanced parts (spectral bisection, then swaps that keep
the balance). A small network learns to name a vector's part, with the parts of its neighbours as soft
labels. Every row is filed under its most probable part; a query goes to its most probable parts until
their probabilities reach ``MASS`` and is compared exactly with all rows there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demur.llm.registry import query, stored, table

# distinct vectors that partitions and network are fitted on, at most (those with the smallest hash)
SAMPLE_ROWS = 8192
NEIGHBOURS = 10
# parts grow with the rows up to this number
ROWS_BY_PART, MAX_PARTS = 1024, 256
HIDDEN, EPOCHS, BATCH = 128, 30, 256
# probability that the searched parts reach together
MASS = 0.995
# rows of a part and queries that meet in one group
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512


class Router(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        z = hidden @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """k nearest other rows of each row, by blocks."""
    k = min(k, len(x) - 1)
    square = (x * x).sum(axis=1)
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = square[None, :] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row; parts differ by one row at most after each bisection."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    level = 1
    while level < parts:
        inside = part[a] == part[b]
        ai, bi = a[inside], b[inside]
        degree = np.bincount(ai, minlength=n) + 1e-9
        # slow mode of the walk on each part's graph, started from the part's main direction
        v = np.zeros(n)
        for p in range(level):
            rows = np.flatnonzero(part == p)
            y = x[rows] - x[rows].mean(axis=0)
            axis = np.ones(y.shape[1])
            for _ in range(12):
                axis = y.T @ (y @ axis)
                axis /= np.linalg.norm(axis) + 1e-30
            v[rows] = y @ axis
        size = np.bincount(part, weights=degree, minlength=level)
        for _ in range(40):
            v = 0.5 * v + 0.5 * np.bincount(ai, weights=v[bi], minlength=n) / degree
            v -= (np.bincount(part, weights=v * degree, minlength=level) / size)[part]
            v /= (np.sqrt(np.bincount(part, weights=v * v, minlength=level)) + 1e-30)[part]
        order = np.lexsort((v, part))
        count = np.bincount(part, minlength=level)
        place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        side = np.zeros(n, np.int64)
        side[order] = place >= np.repeat((count + 1) // 2, count)
        # swap the rows of both halves that gain most, as many from each
        for _ in range(8):
            other = np.bincount(ai, weights=(side[ai] != side[bi]), minlength=n)
            gain = 2 * other - degree
            moved = 0
            for p in range(level):
                rows = np.flatnonzero(part == p)
                left = rows[(side[rows] == 0) & (gain[rows] > 0)]
                right = rows[(side[rows] == 1) & (gain[rows] > 0)]
                m = min(len(left), len(right)) // 2
                if m:
                    side[left[np.argsort(-gain[left])[:m]]] = 1
                    side[right[np.argsort(-gain[right])[:m]]] = 0
                    moved += m
            if not moved:
                break
        part = 2 * part + side
        level *= 2
    return part


def fit_router(x: np.ndarray, parts: int, seed: int = 3) -> Router:
    """Partitions a sample's neighbour graph and trains the network that names the parts."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    parts = min(parts, 1 << max(0, len(x) // 8).bit_length() >> 1) if len(x) >= 8 else 1
    parts = max(1, parts)
    d = x.shape[1]
    if parts == 1:
        return Router(mean, scale, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    z = (x - mean) / scale
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(z, graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
    soft = 0.5 * soft
    soft[np.arange(len(x)), part] += 0.5
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [0.0] * 4, [0.0] * 4, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = 3e-3 * (1 - epoch / EPOCHS)
        for s in range(0, len(x), BATCH):
            i = order[s : s + BATCH]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            q = h @ p[2] + p[3]
            q = np.exp(q - q.max(axis=1, keepdims=True))
            g = (q / q.sum(axis=1, keepdims=True) - soft[i]) / len(i)
            back = (g @ p[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((z[i].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, x``: rows whose vector is not null, not zero and holds finite numbers only."""
    df = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.expr(f"cast(`{vector_col}` as array<double>)").alias("x"))
    finite = "forall(x, y -> y is not null and not isnan(y) and abs(y) < double('inf'))"
    return df.where(f"id is not null and x is not null and {finite} and exists(x, y -> y <> 0)")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def route(rows: DataFrame, router: Router, d: int, mass: float | None, held: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """``id, x, part``: the most probable part, or as many as reach ``mass`` and hold ``least`` rows, two at least.

    ``held``: rows by part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = router.probabilities(_matrix(batch.column(1), d))
            if mass is None:
                row, part = np.arange(len(p)), p.argmax(axis=1)
            else:
                order = np.argsort(-p, axis=1, kind="stable")
                ranked = np.take_along_axis(p, order, axis=1)
                rows_before = np.cumsum(held[order], axis=1) - held[order]
                row, place = np.nonzero((np.cumsum(ranked, axis=1) - ranked < mass) | (rows_before < least) | (np.arange(len(held)) < 2))
                part = order[row, place]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(part.astype(np.int64))], names=["id", "x", "part"]
            )

    return rows.mapInArrow(run, "id long, x array<double>, part long")


def search(
    vectors: DataFrame,
    queries: str = "id % 100 = 0",
    k: int = 10,
    mass: float = MASS,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row that fulfils ``queries``.

    Euclidean distance over the original components in double precision; ties go to the smaller id.
    Vectors that are null, zero, hold null or other than finite numbers, or differ in length from the most
    common one take no part. Rows with one id are each other's own row and never each other's neighbour.
    Equal vectors share a part, which is cut into blocks by id, so a vector that most rows have stays
    spread. Without rows there is no result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("x") == d)
    sample = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(sample_rows).toArrow()
    parts = 1 << max(0, min(MAX_PARTS, -(-n // ROWS_BY_PART)) - 1).bit_length()
    router = fit_router(_matrix(sample.column(0).combine_chunks(), d), parts)
    filed = stored(route(rows, router, d, None), "vectors")
    # a query goes on until its parts hold k rows beside its own ones
    held = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    most = filed.groupBy("id").count().agg(F.max("count")).first()[0]
    counts = np.array([held.get(p, 0) for p in range(router.probabilities(np.zeros((1, d))).shape[1])])
    asked = stored(route(filed.where(queries).select("id", "x"), router, d, mass, counts, k + most), "queries")
    # one row by part: how many blocks its rows and its queries make
    wanted = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = {p: (-(-held[p] // BLOCK_ROWS), -(-n // BLOCK_QUERIES)) for p, n in wanted.items() if p in held}
    if not blocks:
        return spark.createDataFrame([], empty)
    plan = F.broadcast(spark.createDataFrame([(p, a, b) for p, (a, b) in blocks.items()], "part long, na long, nb long"))
    left = filed.join(plan, "part").select(
        "part", "id", "x", F.expr("pmod(xxhash64(id), na)").alias("a"), F.explode(F.expr("sequence(0L, nb - 1)")).alias("b")
    )
    right = asked.join(plan, "part").select(
        "part", "id", "x", F.expr("pmod(xxhash64(id), nb)").alias("b"), F.explode(F.expr("sequence(0L, na - 1)")).alias("a")
    )

    def nearest(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(c) and len(q):
            c = c.sort_values("id")
            ids, x = c["id"].to_numpy(), np.stack(c["x"].to_numpy())
            y, own = np.stack(q["x"].to_numpy()), q["id"].to_numpy()
            for i in range(len(y)):
                # components are added up one after the other, so equal vectors get equal scores
                dist = np.sqrt(np.square(x - y[i]).sum(axis=1))
                dist[ids == own[i]] = np.inf
                m = min(k, len(dist))
                limit = np.partition(dist, m - 1)[m - 1]
                at = np.flatnonzero(dist <= limit)
                at = at[np.argsort(dist[at], kind="stable")][:m]
                at = at[np.isfinite(dist[at])]
                found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[at], "score": dist[at]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    near = (
        left.groupBy("part", "a", "b")
        .cogroup(right.groupBy("part", "a", "b"))
        .applyInPandas(nearest, "query_id long, vec_id long, score double")
    )
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
