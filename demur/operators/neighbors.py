"""Exact k-nearest-neighbour join by pivots and distance bounds.

Reference vectors are filed under their nearest pivot. A cell of many rows gets pivots of its own, and so
on, so the tree of cells grows with the table while every node has at most ``FANOUT`` children; below the
first level it is a table, never held by the driver. A query first searches its home leaf, then walks down
to those leaves that the triangle inequality and, for Euclidean distances, the bisectors of the pivots do not
exclude at the distance found so far. Where the
bounds leave more than ``WIDE_SHARE`` of the rows open (many dimensions without clusters), cells only cost
copies: such a query meets all rows in tiles as large as memory allows.

Query chunks and reference blocks meet in a cogrouped job, where numpy compares them; only the k best of
each chunk leave the task, so neither side is broadcast, no table of pairs exists, and no group grows with
the data. Copies of a vector are compared once: k neighbours cannot hold more than the k smallest ids of
one vector.

Order of neighbours: distance rounded to 9 digits, then reference id.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from demur.functions.arrays import dot
from demur.session import num_lit, settle, small_table

# Reference vectors by block and queries by chunk.
BLOCK_ROWS = 2048
CHUNK_ROWS = 2048
# Pivots and cells of the first level of the tree, and doubles that its pivots take on the driver and in each task.
TOP_PIVOTS = 1024
TOP_CELLS = 65_536
TOP_DOUBLES = 4_000_000
# A cell of more than SPLIT_BLOCKS blocks gets up to FANOUT pivots of its own, LEVELS times at most.
SPLIT_BLOCKS = 4
FANOUT = 256
LEVELS = 5
# A query to which more than this share of the rows stays open meets all of them, in tiles of so many doubles;
# a row counts its numbers, its ids and ROW_DOUBLES for the rest.
WIDE_SHARE = 0.5
WIDE_DOUBLES = 2_500_000
ROW_DOUBLES = 8
# Doubles that one numpy step may hold, queries that it compares, and a tile that fits a core's cache.
STEP_CELLS = 1_000_000
STEP_QUERIES = 512
TILE = (32, 2048)
# Pairs of nearly equal distances that wait for their exact ones.
STEP_PAIRS = 250_000
# Nearest pivots of a query whose bisectors bound its distance to a cell.
BISECTORS = 8
# Covariances that one aggregate computes.
COVARIANCES = 256

METRICS = ("minkowski", "cosine", "mahalanobis")

# tasks get the kernels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- kernels (run inside tasks) ------------------------------------------------------------
def _raised(d: np.ndarray, p: float) -> np.ndarray:
    """Powers of non-negative numbers; small whole ones by products, which numpy does many times faster."""
    if p == int(p) and 1 <= p <= 8:
        out = d.copy()
        for _ in range(int(p) - 1):
            out *= d
        return out
    return d**p


def _pair_distance(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Row-wise Minkowski distance of two equally long lists of vectors."""
    d = np.abs(a - b)
    if p == 2:
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    if p == 1:
        return d.sum(axis=1)
    return _raised(d, p).sum(axis=1) ** (1.0 / p)


def _listed_distance(q: np.ndarray, r: np.ndarray, qi: np.ndarray, ri: np.ndarray, p: float) -> np.ndarray:
    """Distances of listed pairs, some at a time."""
    out = np.empty(len(qi))
    step = max(1, STEP_CELLS // max(1, q.shape[1]))
    for i in range(0, len(qi), step):
        out[i : i + step] = _pair_distance(q[qi[i : i + step]], r[ri[i : i + step]], p)
    return out


def _listed_pairs(x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs of a few vectors, one difference at a time."""
    out = np.empty((len(x), len(x)))
    for i, v in enumerate(x):
        out[i] = np.sqrt(((x - v) ** 2).sum(axis=1))
    return out


def _power_sums(q: np.ndarray, r: np.ndarray, p: float) -> np.ndarray:
    """Sums of the powered differences of all pairs, one dimension after another over tiles that fit a cache."""
    out = np.zeros((len(q), len(r)), q.dtype)
    qt, rt = np.ascontiguousarray(q.T), np.ascontiguousarray(r.T)
    side, wide = TILE
    for i in range(0, len(q), side):
        for j in range(0, len(r), wide):
            total = np.zeros((min(side, len(q) - i), min(wide, len(r) - j)), q.dtype)
            d = np.empty_like(total)
            for a, b in zip(qt[:, i : i + side], rt[:, j : j + wide]):
                np.subtract(a[:, None], b[None, :], out=d)
                np.abs(d, out=d)
                total += d if p == 1 else _raised(d, p)
            out[i : i + side, j : j + wide] = total
    return out


def _single_sums(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Manhattan distances of all pairs in single precision, from |a - b| = 2 max(a, b) - a - b."""
    out = np.empty((len(q), len(r)), np.float32)
    qt, rt = np.ascontiguousarray(q.T), np.ascontiguousarray(r.T)
    side, wide = TILE
    for i in range(0, len(q), side):
        for j in range(0, len(r), wide):
            total = np.zeros((min(side, len(q) - i), min(wide, len(r) - j)), np.float32)
            d = np.empty_like(total)
            for a, b in zip(qt[:, i : i + side], rt[:, j : j + wide]):
                np.maximum(a[:, None], b[None, :], out=d)
                total += d
            out[i : i + side, j : j + wide] = total
    out *= 2
    out -= q.sum(axis=1)[:, None]
    out -= r.sum(axis=1)[None, :]
    return out


def _all_distances(q: np.ndarray, r: np.ndarray, p: float) -> tuple[np.ndarray, float]:
    """Distances of all pairs of two bounded blocks and a bound of their error."""
    if p == 2:
        q2, r2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
        d2 = q @ r.T
        d2 *= -2.0
        d2 += q2[:, None]
        d2 += r2[None, :]
        np.maximum(d2, 0.0, out=d2)
        # the expanded square loses digits relative to the squared norms
        err = math.sqrt(1e-12 * (q.shape[1] + 8) * (q2.max(initial=0.0) + r2.max(initial=0.0)))
        return np.sqrt(d2, out=d2), err
    out = _power_sums(q, r, p)
    if p != 1:
        out **= 1.0 / p
    return out, 1e-12 * (1.0 + float(out.max(initial=0.0)))


def _bisected(d: np.ndarray, err: float, between: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Least Euclidean distances from queries to cells of nearest pivots: how far the cell lies behind the bisectors.

    ``d``: queries by pivots, near the true distances by ``err``; ``between``: the pivots' own; ``far``: the farthest row of each cell.
    """
    out = np.full_like(d, -np.inf)
    some = np.argsort(d, axis=1)[:, :BISECTORS]
    with np.errstate(divide="ignore", invalid="ignore"):
        for at in some.T:
            near, apart = d[np.arange(len(d)), at][:, None], between[at]
            # rows near a bisector may be filed on either side of it, and both distances are off by err
            lost = 4 * err * (d + near + 2 * far + 2 * err)
            bound = (d * d - near * near - lost) / (2 * apart) - 2 * err * far / apart
            np.maximum(out, np.where(apart > 4 * err, bound, -np.inf), out=out)
    return out


class _Rough:
    """Quick distances of blocks: near the true ones by ``err``, or below them.

    ``stretch``: the quick distance is at most so many times the true one, plus ``err``. Above the Euclidean
    power it is the Euclidean distance, which d numbers stretch by no more than d ** (1/2 - 1/p). For p = 1 it
    is summed in single precision around the mean.
    """

    def __init__(self, q: np.ndarray, r: np.ndarray, p: float):
        self.p, d = p, q.shape[1]
        self.stretch = d ** max(0.0, 0.5 - 1.0 / p)
        self.below = p > 2
        if p >= 2:
            self.q, self.r = q, r
            self.err = math.sqrt(1e-12 * (d + 8) * sum(np.einsum("ij,ij->i", x, x).max(initial=0.0) for x in (q, r)))
            return
        mean = r.mean(axis=0)
        q0, r0 = q - mean, r - mean
        largest = sum(np.abs(x).sum(axis=1).max(initial=0.0) for x in (q0, r0))
        lost = 4e-15 * (d + 4) * sum(np.abs(x).sum(axis=1).max(initial=0.0) for x in (q, r))
        if p == 1 and largest < 1e30:
            self.q, self.r = q0.astype(np.float32), r0.astype(np.float32)
            self.err = 6e-8 * (4 * d + 8) * largest + 1e-36 * d + lost
        else:
            self.q, self.r, self.err = q, r, 1e-12 * (1.0 + largest) + lost

    def __call__(self, at: slice, to: slice) -> np.ndarray:
        if self.q.dtype == np.float32:
            return _single_sums(self.q[at], self.r[to])
        return _all_distances(self.q[at], self.r[to], 2 if self.p >= 2 else self.p)[0]


def _lowest(top: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The smallest numbers of each row of both, as many as ``top`` has."""
    return np.partition(np.concatenate([top, more], axis=1), top.shape[1] - 1, axis=1)[:, : top.shape[1]]


def _candidates(q, r, rough, start, k, p, cosine, reach) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of some queries (numbered from ``start``) with all references that may be among the k best.

    At most STEP_PAIRS at a time: where distances differ by less than their error, every pair is a candidate.
    """
    n = len(q)
    top, reach = np.full((n, k), np.inf), np.full(n, np.inf) if reach is None else reach
    slack = 0.0 if rough.below else rough.err
    found, waiting = [], 0

    def bound() -> np.ndarray:
        # all that round to the k-th distance stay candidates
        limit = np.minimum(top.max(axis=1) + slack, reach)
        return np.sqrt(limit * limit + 8e-9) if cosine else limit + 2e-9

    def open_pairs() -> tuple[np.ndarray, ...]:
        qi, ri, value = (np.concatenate(x) for x in zip(*found))
        keep = value <= bound()[qi] + slack
        return qi[keep], ri[keep], value[keep]

    step = max(1, STEP_CELLS // max(1, n))
    for j in range(0, len(r), step):
        near = rough(slice(start, start + n), slice(j, j + step))
        first = np.flatnonzero(np.isinf(top).any(axis=1) & np.isinf(reach))
        if len(first) and near.shape[1] > k:
            # nothing is known of these queries: any k references bound the k-th distance
            some = np.argpartition(near[first], k - 1, axis=1)[:, :k]
            if rough.below:
                value = _listed_distance(q, r, np.repeat(first, k), some.ravel() + j, p).reshape(-1, k)
            else:
                value = np.take_along_axis(near[first], some, axis=1)
            kept, top[first] = top[first], _lowest(top[first], value)
            within = bound()
            top[first] = kept
        else:
            within = bound()
        qi, ri = np.nonzero(near <= (within * rough.stretch + rough.err)[:, None])
        if not len(qi):
            continue
        value = _listed_distance(q, r, qi, ri + j, p) if rough.below else near[qi, ri]
        if rough.below:
            keep = value <= within[qi]
            qi, ri, value = qi[keep], ri[keep], value[keep]
        rows, at, times = np.unique(qi, return_index=True, return_counts=True)
        if len(rows):
            more = np.full((len(rows), int(times.max())), np.inf)
            line = np.repeat(np.arange(len(rows)), times)
            more[line, np.arange(len(qi)) - at[line]] = value
            top[rows] = _lowest(top[rows], more)
            found.append((qi, ri + j, value))
            waiting += len(qi)
        if waiting > STEP_PAIRS:
            found = [open_pairs()]
            waiting = len(found[0][0])
            if waiting > STEP_PAIRS:
                yield from _slices(*found.pop()[:2])
                waiting = 0
    if found:
        yield from _slices(*open_pairs()[:2])


def _slices(qi: np.ndarray, ri: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for s in range(0, len(qi), STEP_PAIRS):
        yield qi[s : s + STEP_PAIRS], ri[s : s + STEP_PAIRS]


def _best(q: np.ndarray, r: np.ndarray, counts: np.ndarray, flat: np.ndarray, k: int, p: float, cosine: bool = False, reach: np.ndarray | None = None):
    """``(query index, id, distance)`` of the k best references of each query, in order.

    Reference i stands for ``counts[i]`` ids, listed in ``flat``. ``cosine``: the vectors have unit length and
    the distance is 1 - cosine, half the squared one. ``reach``: a distance beyond which a query needs none.
    """
    rough, starts, out = _Rough(q, r, p), np.concatenate([[0], np.cumsum(counts)[:-1]]), []
    for i in range(0, len(q), STEP_QUERIES):
        part = q[i : i + STEP_QUERIES]
        best, worst = (np.zeros(0, np.int64), np.zeros(0, flat.dtype), np.zeros(0)), np.full(len(part), np.inf)
        for qi, ri in _candidates(part, r, rough, i, k, p, cosine, None if reach is None else reach[i : i + STEP_QUERIES]):
            exact = _listed_distance(part, r, qi, ri, p)
            exact = np.round(exact * exact / 2 if cosine else exact, 9)
            some = exact <= worst[qi]
            qi, ri, exact = qi[some], ri[some], exact[some]
            # one candidate vector stands for its few smallest ids
            times = counts[ri]
            pair = np.repeat(np.arange(len(ri)), times)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
            rid = flat[starts[ri[pair]] + inner]
            qid, rid, dist = (np.concatenate(x) for x in zip(best, (qi[pair], rid, exact[pair])))
            order = np.lexsort((rid, dist, qid))
            qid, rid, dist = qid[order], rid[order], dist[order]
            at = np.arange(len(qid)) - np.searchsorted(qid, qid, side="left")
            worst[qid[at == k - 1]] = dist[at == k - 1]
            best = qid[at < k], rid[at < k], dist[at < k]
        out.append((best[0] + i, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    column = table.column(name).combine_chunks()
    ends = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or ends["min"] != ends["max"]:
        raise ValueError("vectors must not be null and have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


# --- vectors and metrics -------------------------------------------------------------------
def metric_vector(vec: str, metric: str = "minkowski", inverse_covariance: np.ndarray | None = None) -> Column:
    """Vector whose Minkowski distances order rows as the metric does.

    Cosine: unit length. Mahalanobis: whitened by a factor of the inverse covariance.
    """
    if metric == "minkowski":
        return F.col(vec)
    if metric == "cosine":
        norm = f"sqrt({dot(vec, vec)})"
        unit = f"transform(array({norm}), n -> if(n = 0, raise_error('a zero vector has no direction'), transform({vec}, x -> x / n)))[0]"
        return F.expr(unit)
    if metric == "mahalanobis":
        if inverse_covariance is None:
            raise ValueError("the Mahalanobis metric needs the inverse covariance")
        factor = np.linalg.cholesky(np.asarray(inverse_covariance, dtype=float))
        rows = ", ".join("array(" + ", ".join(num_lit(float(x)) for x in row) + ")" for row in factor.T)
        return F.expr(f"transform(array({rows}), w -> {dot('w', vec)})")
    raise ValueError(f"metric must be one of {METRICS}")


def inverse_covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Inverse of the sample covariance: an aggregate by COVARIANCES pairs, a small matrix on the driver."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = []
    for at in range(0, len(pairs), COVARIANCES):
        part = pairs[at : at + COVARIANCES]
        row += df.agg(*[F.covar_samp(columns[i], columns[j]) for i, j in part]).first()
    cov = np.zeros((d, d))
    for (i, j), v in zip(pairs, row):
        cov[i, j] = cov[j, i] = v
    return np.linalg.inv(cov)


# --- the join ------------------------------------------------------------------------------
def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    p: float = 2.0,
    exclude_self: bool = False,
    metric: str = "minkowski",
    vi: np.ndarray | None = None,
) -> DataFrame:
    """``(row_id, neighbors array<struct<dist double, ref_id bigint>>)``, nearest first.

    ``queries`` and ``refs`` have ``row_id bigint, vec array<double>``. ``exclude_self`` leaves out the
    reference with the query's own id.
    """
    return _join(queries, refs.withColumn("g", F.lit(0)), 1, k, p, exclude_self, metric, vi).drop("g")


def knn_equal_class(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    labels: list,
    y: str = "y",
    p: float = 2.0,
    exclude_self: bool = False,
    metric: str = "minkowski",
    vi: np.ndarray | None = None,
) -> DataFrame:
    """The same number of neighbours from each class: ``(row_id, y, neighbors)``."""
    label_array = F.array(*[F.lit(v) for v in labels])
    coded = refs.withColumn("g", (F.array_position(label_array, F.col(y)) - 1).cast("int")).where("g >= 0")
    found = _join(queries, coded, len(labels), k, p, exclude_self, metric, vi)
    return found.select("row_id", F.element_at(label_array, F.col("g") + 1).alias(y), "neighbors")


def _join(queries, refs, groups, k, p, exclude_self, metric, vi) -> DataFrame:
    """Neighbours within each reference group ``g`` of 0..groups-1."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if p < 1:
        raise ValueError("p must be at least 1")
    if metric != "minkowski":
        p = 2.0
    spark = queries.sparkSession
    keep, cosine = (k + 1 if exclude_self else k), metric == "cosine"

    def keyed(df, *more):
        return df.select("row_id", *more, metric_vector("vec", metric, vi).alias("vec")).withColumn("h", F.xxhash64("vec"))

    asked = keyed(queries)
    vectors = settle(_distinct_references(keyed(refs, "g"), keep), "knn-refs")
    pivots = _pivots(vectors, groups)
    if not len(pivots):
        return queries.select(
            "row_id", F.lit(0).alias("g"), F.array().cast("array<struct<dist:double,ref_id:bigint>>").alias("neighbors")
        )
    many = len(pivots)
    distinct = settle(asked.groupBy("h", "vec").agg(F.min("row_id").alias("qid")), "knn-queries")
    if many == 1 and groups == 1:
        # few references: a single cell, nothing to exclude
        rows = vectors.withColumn("node", F.lit(0).cast("bigint"))
        probes = distinct.select("qid", "vec", F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("node"), F.lit(None).cast("double").alias("reach"))
        blocks, chunks = math.ceil(vectors.count() / BLOCK_ROWS), math.ceil(distinct.count() / CHUNK_ROWS)
        found = _search(probes, rows, (blocks, max(1, chunks)), keep, p, cosine)
    else:
        vectors = vectors.withColumn("z", _nearest_pivot(pivots, p)("vec")).select(
            "h", "vec", "ids", "g", (F.col("g") * many + F.col("z.cell")).alias("cell"), F.col("z.dist").alias("dp")
        )
        vectors = settle(vectors, "knn-cells")
        cells = _cell_stats(vectors, keep)
        tree = _grow(vectors, cells, p)
        home = _descend(settle(_home_probes(distinct, pivots, cells, p), "knn-probes"), tree, p, nearest=True)
        found = settle(_search_leaves(home, tree, keep, p, cosine), "knn-home")
        farthest = F.sqrt(2 * F.max("dist") + 4e-9) if cosine else F.max("dist")
        reach = found.groupBy("qid", "g").agg(
            F.when(F.count(F.lit(1)) >= keep, farthest).alias("reach")
        )
        every = distinct.select("qid", "vec", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        far = settle(_far_probes(every.join(reach, ["qid", "g"], "left"), pivots, cells, tree.deep, keep, p), "knn-far")
        leaves = _descend(far.where("node >= 0"), tree, p)
        found = found.unionByName(_search_leaves(leaves, tree, keep, p, cosine))
        found = found.unionByName(_search_all(far.where("node < 0"), vectors, cells, many, keep, p, cosine))
    best = W.partitionBy("qid", "g").orderBy("dist", "ref_id")
    # a leaf may have been searched twice; equal rows share their rank and are one neighbour
    found = found.withColumn("_rn", F.dense_rank().over(best)).where(F.col("_rn") <= keep)
    lists = found.groupBy("qid", "g").agg(F.array_sort(F.collect_set(F.struct("dist", "ref_id"))).alias("neighbors"))

    out = asked.join(distinct, ["h", "vec"]).select("row_id", "qid").join(lists, "qid").select("row_id", "g", "neighbors")
    if exclude_self:
        out = out.withColumn("neighbors", F.expr("filter(neighbors, n -> n.ref_id != row_id)"))
    return out.withColumn("neighbors", F.slice("neighbors", 1, k))


def _distinct_references(known: DataFrame, keep: int) -> DataFrame:
    """One row by vector and group with its ``keep`` smallest ids; the limit applies before the shuffle."""
    w = W.partitionBy("h", "vec", "g").orderBy("row_id")
    few = known.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    return few.groupBy("h", "vec", "g").agg(F.array_sort(F.collect_list("row_id")).alias("ids"))


def _pivots(vectors: DataFrame, groups: int) -> np.ndarray:
    """Pivots of the first level: a sample of the distinct vectors in hash order."""
    n = vectors.count()
    if n == 0:
        return np.empty((0, 0))
    wanted = max(1, min(TOP_PIVOTS, n // BLOCK_ROWS))
    width = len(vectors.select("vec").first()[0])
    wanted = max(1, min(wanted, TOP_DOUBLES // max(1, width), TOP_CELLS // groups))
    rows = vectors.orderBy("h").limit(wanted).select("vec").collect()
    return np.array([r[0] for r in rows], dtype=float)


def _nearest_pivot(pivots: np.ndarray, p: float):
    @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())]))
    def nearest(vec: pd.Series) -> pd.DataFrame:
        x, step = _matrix(vec), _step(len(pivots))
        cell, dist = np.empty(len(x), np.int32), np.empty(len(x))
        for i in range(0, len(x), step):
            d, _ = _all_distances(x[i : i + step], pivots, p)
            at = d.argmin(axis=1)
            cell[i : i + step], dist[i : i + step] = at, d[np.arange(len(d)), at]
        return pd.DataFrame({"cell": cell, "dist": dist})

    return nearest


def _step(pivots: int) -> int:
    """Rows that meet so many pivots at a time."""
    return max(1, STEP_CELLS // max(1, pivots))


def _pieces(batches: Iterator[pd.DataFrame], pivots: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), _step(pivots)):
            yield b.iloc[i : i + _step(pivots)]


def _cell_stats(vectors: DataFrame, keep: int) -> dict:
    """By cell: vectors, nearest and farthest vector, and the ``keep`` smallest distances."""
    stats = vectors.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("dp").alias("lo"), F.max("dp").alias("hi")
    )
    w = W.partitionBy("cell").orderBy("dp", "h")
    near = (
        vectors.select("cell", "dp", "h", F.row_number().over(w).alias("rn"))
        .where(F.col("rn") <= keep)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("dp")).alias("near"))
    )
    return {
        r["cell"]: {
            "n": r["n"],
            "lo": r["lo"],
            "hi": r["hi"],
            "near": list(r["near"]),
        }
        for r in stats.join(near, "cell").collect()
    }


PROBE_SCHEMA = "qid bigint, vec array<double>, g int, node bigint, reach double"
ROW_SCHEMA = "h bigint, vec array<double>, ids array<bigint>, node bigint, dp double"


# --- the tree below the first level --------------------------------------------------------
class Tree(NamedTuple):
    """``rows``: references by leaf; ``sizes``: rows by leaf; ``levels``: the children of each level's large nodes."""

    rows: DataFrame
    sizes: DataFrame
    levels: list[DataFrame]
    deep: set[int]


def _parts(n: str, rows: int) -> Column:
    return F.ceil(F.col(n) / rows).cast("int")


def _grow(vectors: DataFrame, cells: dict, p: float) -> Tree:
    """Gives large cells pivots of their own until no leaf has more than SPLIT_BLOCKS blocks.

    Nodes below the first level are numbered by level and path. Rows meet their node's pivots in parts of
    bounded size, so a hot cell is spread over many tasks.
    """
    spark = vectors.sparkSession
    limit = SPLIT_BLOCKS * BLOCK_ROWS
    deep = {c for c, v in cells.items() if v["n"] > limit}
    rows = vectors.select("h", "vec", "ids", F.col("cell").cast("bigint").alias("node"), "dp")
    sizes = small_table(
        spark,
        {"node": list(cells), "n": [v["n"] for v in cells.values()]},
        pa.schema([("node", pa.int64()), ("n", pa.int64())]),
    )
    leaves, leaf_sizes, levels = [], [], []
    for level in range(1, LEVELS + 1):
        if level > 1 and not sizes.where(F.col("n") > limit).limit(1).count() or not deep:
            break
        sized = rows.join(sizes, "node")
        leaves.append(sized.where(F.col("n") <= limit).drop("n"))
        leaf_sizes.append(sizes.where(F.col("n") <= limit))
        large = sized.where(F.col("n") > limit)
        first = F.row_number().over(W.partitionBy("node").orderBy("h"))
        pivots = (
            large.select("node", "n", "h", F.col("vec").alias("pivot"), first.alias("i"))
            .where(F.col("i") <= FANOUT)
            .where(F.col("i") <= F.greatest(F.lit(2), F.col("n") / BLOCK_ROWS))
        )
        path = F.col("node").bitwiseAND((1 << 56) - 1) * FANOUT + F.col("i") - 1
        pivots = settle(pivots.select("node", "n", "pivot", (path + (level << 56)).alias("child")), "knn-pivots")
        left = large.withColumn("part", F.pmod(F.xxhash64("h"), _parts("n", BLOCK_ROWS)).cast("int"))
        left = left.select("node", "part", "h", "vec", "ids")
        right = pivots.select(
            "node", F.explode(F.sequence(F.lit(0), _parts("n", BLOCK_ROWS) - 1)).alias("part"), "pivot", "child"
        )
        rows = settle(
            left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInPandas(_filer(p), ROW_SCHEMA),
            "knn-rows",
        )
        sums = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("dp").alias("lo"), F.max("dp").alias("hi"))
        nodes = pivots.select("node", "pivot", "child").join(sums.withColumnRenamed("node", "child"), "child")
        large_child = (F.col("n") > limit) if level < LEVELS else F.lit(False)
        nodes = settle(nodes.withColumn("large", large_child), "knn-nodes")
        levels.append(nodes)
        sizes = nodes.select(F.col("child").alias("node"), "n")
    leaves.append(rows)
    leaf_sizes.append(sizes)
    return Tree(reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, leaf_sizes), levels, deep)


def _filer(p: float):
    """Files rows of one node under the nearest of its pivots."""

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"h": [], "vec": [], "ids": [], "node": [], "dp": []})
        d, _ = _all_distances(_matrix(rows["vec"]), _matrix(pivots["pivot"]), p)
        at = d.argmin(axis=1)
        out = rows[["h", "vec", "ids"]].copy()
        out["node"], out["dp"] = pivots["child"].to_numpy()[at], d[np.arange(len(d)), at]
        return out

    return run


def _descend(probes: DataFrame, tree: Tree, p: float, nearest: bool = False) -> DataFrame:
    """Probes of leaves out of probes of first-level cells.

    ``probes`` are written already. ``nearest``: the nearest child of each node; else all children that may hold a
    vector within reach.
    """
    if not tree.levels:
        return probes
    done = []
    for level, nodes in enumerate(tree.levels):
        if level == 0:
            inner = nodes.select("node").distinct()
            done.append(probes.join(inner, "node", "left_anti"))
            probes = probes.join(inner, "node", "left_semi")
        else:
            done.append(probes.where("not large").drop("large"))
            probes = probes.where("large").drop("large")
        load = probes.groupBy("node").agg(_parts_of(F.count(F.lit(1)), CHUNK_ROWS).alias("chunks"))
        load = settle(load, "knn-load")
        left = probes.join(load, "node").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
        right = nodes.join(load, "node").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        probes = (
            left.select("node", "chunk", "qid", "vec", "g", "reach")
            .groupBy("node", "chunk")
            .cogroup(right.select("node", "chunk", "pivot", "child", "lo", "hi", "large").groupBy("node", "chunk"))
            .applyInPandas(_walker(p, nearest), PROBE_SCHEMA + ", large boolean")
        )
        probes = settle(probes, "knn-probes")
    done.append(probes.drop("large"))
    return reduce(DataFrame.unionByName, done)


def _parts_of(n: Column, rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / rows).cast("int"))


def _walker(p: float, nearest: bool):
    def run(q: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(nodes):
            return pd.DataFrame({"qid": [], "vec": [], "g": [], "node": [], "reach": [], "large": []})
        d, err = _all_distances(_matrix(q["vec"]), _matrix(nodes["pivot"]), p)
        low = d.min(axis=1)
        if nearest:
            qi, ci = np.arange(len(q)), d.argmin(axis=1)
        else:
            lo, hi = nodes["lo"].to_numpy(), nodes["hi"].to_numpy()
            bound = np.maximum(np.maximum(d - hi, lo - d), (d - low[:, None]) / 2)
            if p == 2:
                pivots = _matrix(nodes["pivot"])
                bound = np.maximum(bound, _bisected(d, err, _listed_pairs(pivots), hi))
            qi, ci = np.nonzero(bound <= q["reach"].to_numpy(dtype=float)[:, None] + 4 * err + 1e-8)
        out = q[["qid", "vec", "g", "reach"]].iloc[qi].copy()
        out["node"], out["large"] = nodes["child"].to_numpy()[ci], nodes["large"].to_numpy()[ci]
        return out[["qid", "vec", "g", "node", "reach", "large"]]

    return run


# --- probes of the first level -------------------------------------------------------------
def _by_group(cells: dict, pivots: np.ndarray) -> dict[int, np.ndarray]:
    """Cells that hold references, by group."""
    out: dict[int, list] = {}
    for c in sorted(cells):
        out.setdefault(c // len(pivots), []).append(c)
    return {g: np.array(cs) for g, cs in out.items()}


def _home_probes(distinct: DataFrame, pivots: np.ndarray, cells: dict, p: float) -> DataFrame:
    """The nearest cell of each group."""
    filled, many = _by_group(cells, pivots), len(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, many):
            d, _ = _all_distances(_matrix(b["vec"]), pivots, p)
            for g, cs in filled.items():
                home = cs[d[:, cs % many].argmin(axis=1)]
                yield pd.DataFrame(
                    {"qid": b["qid"], "vec": b["vec"], "g": np.int32(g), "node": home.astype(np.int64), "reach": np.nan}
                )

    return distinct.select("qid", "vec").mapInPandas(run, PROBE_SCHEMA)


def _far_probes(asked: DataFrame, pivots: np.ndarray, cells: dict, deep: set, keep: int, p: float) -> DataFrame:
    """Cells that may hold a vector within reach, without a home cell that was searched whole.

    A query to which more than WIDE_SHARE of its group's rows stays open gets one probe of node -1 - g instead.
    """
    filled, many, share = _by_group(cells, pivots), len(pivots), WIDE_SHARE
    between = _listed_pairs(pivots) if p == 2 else None
    bounds = {
        g: (
            np.array([cells[c]["lo"] for c in cs]),
            np.array([cells[c]["hi"] for c in cs]),
            np.array([(cells[c]["near"] + [np.inf] * keep)[:keep] for c in cs]),
            np.array([cells[c]["n"] for c in cs]),
            np.array([c in deep for c in cs]),
        )
        for g, cs in filled.items()
    }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches, many):
            for g, b in batch.groupby("g"):
                if g not in filled:
                    continue
                cs, (lo, hi, near, size, split) = filled[g], bounds[g]
                d, err = _all_distances(_matrix(b["vec"]), pivots[cs % many], p)
                slack = 4 * err + 1e-8
                home = d.argmin(axis=1)
                # no vector can be farther than its way over the pivot, so the keep-th of these is enough
                reach = b["reach"].to_numpy(dtype=float, na_value=np.nan).copy()
                for i in np.nonzero(np.isnan(reach))[0]:
                    reach[i] = np.partition((d[i][:, None] + near).ravel(), keep - 1)[keep - 1] + slack
                bound = np.maximum(np.maximum(d - hi, lo - d), (d - d[np.arange(len(d)), home][:, None]) / 2)
                if p == 2:
                    own = between if len(cs) == many else between[np.ix_(cs % many, cs % many)]
                    bound = np.maximum(bound, _bisected(d, err, own, hi))
                ask = bound <= reach[:, None] + slack
                ask[np.arange(len(d)), home] = split[home]
                wide = ask @ size > share * size.sum()
                ask[wide] = False
                qi, ci = np.nonzero(ask)
                qi, node = np.concatenate([qi, np.nonzero(wide)[0]]), np.concatenate([cs[ci], np.full(wide.sum(), -1 - g)])
                step = 4096
                for s in range(0, len(qi), step):
                    part = b.iloc[qi[s : s + step]]
                    yield pd.DataFrame(
                        {
                            "qid": part["qid"].to_numpy(),
                            "vec": part["vec"].to_numpy(),
                            "g": np.int32(g),
                            "node": node[s : s + step].astype(np.int64),
                            "reach": reach[qi[s : s + step]],
                        }
                    )

    return asked.select("qid", "vec", "g", "reach").mapInPandas(run, PROBE_SCHEMA)


# --- search --------------------------------------------------------------------------------
FOUND = pa.schema([("qid", pa.int64()), ("g", pa.int32()), ("ref_id", pa.int64()), ("dist", pa.float64())])


def _tiles(spark, sizes: dict, load: dict, block: int | None = None, chunk: int | None = None) -> DataFrame:
    """``node, blocks, chunks`` of nodes that the driver knows; broadcast, as its size is checked."""
    block, chunk, used = block or BLOCK_ROWS, chunk or CHUNK_ROWS, sorted(load)
    plan = {
        "node": used,
        "blocks": [max(1, math.ceil(sizes[c] / block)) for c in used],
        "chunks": [max(1, math.ceil(load[c] / chunk)) for c in used],
    }
    schema = pa.schema([("node", pa.int64()), ("blocks", pa.int32()), ("chunks", pa.int32())])
    return F.broadcast(small_table(spark, plan, schema))


def _search_leaves(probes: DataFrame, tree: Tree, keep: int, p: float, cosine: bool) -> DataFrame:
    """Search of leaves by probes that are written already; the plan of blocks is a table of one row by leaf."""
    load = probes.groupBy("node").agg(_parts_of(F.count(F.lit(1)), CHUNK_ROWS).alias("chunks"))
    plan = tree.sizes.join(load, "node").select("node", _parts_of(F.col("n"), BLOCK_ROWS).alias("blocks"), "chunks")
    return _search(probes, tree.rows, settle(plan, "knn-plan"), keep, p, cosine)


def _search_all(probes: DataFrame, vectors: DataFrame, cells: dict, many: int, keep: int, p: float, cosine: bool) -> DataFrame:
    """Search of all rows of a group: square tiles, as large as memory and enough tasks allow."""
    spark = probes.sparkSession
    load = {r["node"]: r["n"] for r in probes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not load:
        return probes.selectExpr("qid", "g", "cast(null as bigint) as ref_id", "reach as dist").where("false")
    sizes: dict[int, int] = {}
    for c, v in cells.items():
        sizes[-1 - c // many] = sizes.get(-1 - c // many, 0) + v["n"]
    width = len(probes.select("vec").first()[0])
    pairs = sum(sizes[node] * load[node] for node in load)
    even = math.isqrt(pairs // (4 * spark.sparkContext.defaultParallelism))
    side = max(BLOCK_ROWS, min(WIDE_DOUBLES // (width + keep + ROW_DOUBLES), even))
    rows = vectors.withColumn("node", (-1 - F.col("g")).cast("bigint"))
    return _search(probes, rows, _tiles(spark, sizes, load, side, side), keep, p, cosine)


def _search(probes: DataFrame, rows: DataFrame, plan, keep: int, p: float, cosine: bool) -> DataFrame:
    """The ``keep`` best references of each probe: ``(qid, g, ref_id, dist)``.

    ``plan``: blocks and chunks by node, or two numbers where there is one node.
    """
    key = ["node", "block", "chunk"]

    def planned(df: DataFrame) -> DataFrame:
        if isinstance(plan, tuple):
            return df.withColumns({"blocks": F.lit(plan[0]), "chunks": F.lit(plan[1])})
        return df.join(plan, "node")

    # every chunk of a node's queries meets every block of its references; both are of bounded size
    left = (
        planned(probes)
        .withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*key, "qid", "g", "vec", "reach")
    )
    right = (
        planned(rows)
        .withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*key, F.col("vec").alias("rvec"), "ids")
    )

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return FOUND.empty_table()
        ids = r.column("ids").combine_chunks()
        # the distance that is known to be enough; none in a first search
        reach = q.column("reach").to_numpy().astype(float)
        reach = np.where(np.isnan(reach), np.inf, reach + 1e-8)
        counts = ids.value_lengths().to_numpy().astype(np.int64)
        at, rid, dist = _best(_numbers(q, "vec"), _numbers(r, "rvec"), counts, ids.flatten().to_numpy(), keep, p, cosine, reach)
        asked = q.select(["qid", "g"]).take(pa.array(at))
        return pa.table([*asked.columns, pa.array(rid, pa.int64()), pa.array(dist)], schema=FOUND)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        compare, "qid bigint, g int, ref_id bigint, dist double"
    )


def flat(neighbors: DataFrame) -> DataFrame:
    """``(row_id, rank, ref_id, dist)`` with ranks from 1."""
    return neighbors.select("row_id", F.posexplode("neighbors").alias("pos", "n")).select(
        "row_id", (F.col("pos") + 1).alias("rank"), F.col("n.ref_id").alias("ref_id"), F.col("n.dist").alias("dist")
    )


class KNN:
    """Nearest-neighbour classifier as a pool member."""

    def __init__(self, features: list[str], k: int = 7, weights: str = "uniform", p: float = 2.0):
        if weights not in ("uniform", "distance"):
            raise ValueError("weights must be 'uniform' or 'distance'")
        self.features, self.k, self.weights, self.p = features, k, weights, p
        self.labels: list = []
        self.refs: DataFrame | None = None

    def fit(self, df: DataFrame, y: str = "y") -> KNN:
        from demur.operators.metrics import label_set

        self.labels = label_set(df, y)
        self.refs = settle(df.select("row_id", F.col(y).alias("ref_y"), self._vec()), "knn-fit")
        return self

    def _vec(self) -> Column:
        return F.array(*[F.col(f"`{f}`").cast("double") for f in self.features]).alias("vec")

    def add_probability(self, df: DataFrame, name: str, exclude_self: bool = False) -> DataFrame:
        found = flat(knn_join(df.select("row_id", self._vec()), self.refs, self.k, self.p, exclude_self))
        votes = found.join(self.refs.select(F.col("row_id").alias("ref_id"), "ref_y"), "ref_id")
        if self.weights == "uniform":
            weight = F.count(F.lit(1)).cast("double")
            votes = votes.groupBy("row_id", "ref_y").agg(weight.alias("w"))
        else:
            # neighbours at distance 0 outvote all others
            votes = votes.groupBy("row_id", "ref_y").agg(
                F.count_if(F.col("dist") == 0).cast("double").alias("w0"),
                F.sum(F.when(F.col("dist") > 0, 1.0 / F.col("dist")).otherwise(0.0)).alias("w1"),
            )
        columns = ["w"] if self.weights == "uniform" else ["w0", "w1"]
        tables = {
            c: F.map_from_entries(F.collect_list(F.struct("ref_y", c))).alias(c) for c in columns
        }
        wide = votes.groupBy("row_id").agg(*tables.values())
        source = "w"
        if self.weights == "distance":
            any_zero = "exists(map_values(w0), x -> x > 0)"
            wide = wide.withColumn("w", F.expr(f"if({any_zero}, w0, w1)"))
        label_array = F.array(*[F.lit(v) for v in self.labels])
        shares = F.transform(label_array, lambda v: F.coalesce(F.try_element_at(F.col(source), v), F.lit(0.0)))
        wide = wide.withColumn("_v", shares)
        total = "aggregate(_v, 0D, (s, x) -> s + x)"
        wide = wide.select("row_id", F.expr(f"transform(array({total}), t -> transform(_v, x -> x / t))[0]").alias(name))
        # a row without any neighbour stays, without probabilities
        return df.join(wide, "row_id", "left")
