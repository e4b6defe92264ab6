"""The neighbour join against brute force, with copies, ties and small blocks."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.operators import neighbors as nb


def vectors(n, d, seed, whole=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, d)).astype(float) if whole else rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # a third of all rows are copies
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<double>")


def brute(q, r, k, distance, exclude_self):
    out = {}
    for i, v in enumerate(q):
        d = np.round([distance(v, w) for w in r], 9)
        out[i] = [j for _, j in sorted(zip(d, range(len(r)))) if not (exclude_self and i == j)][:k]
    return out


def ids(found):
    return {r["row_id"]: [n["ref_id"] for n in r["neighbors"]] for r in found.collect()}


def minkowski(p):
    return lambda a, b: (np.abs(a - b) ** p).sum() ** (1 / p)


@pytest.mark.parametrize(
    "n,m,d,p,whole,own",
    [(500, 300, 3, 2, False, True), (300, 300, 2, 1, True, True), (400, 150, 6, 3, False, False)],
)
def test_many_cells_and_blocks(spark, monkeypatch, n, m, d, p, whole, own):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nb, "CHUNK_ROWS", 30)
    r = vectors(n, d, 1, whole)
    q = r[:m].copy() if own else vectors(m, d, 2, whole)
    got = ids(nb.knn_join(frame(spark, q), frame(spark, r), 7, p, exclude_self=own))
    assert got == brute(q, r, 7, minkowski(p), own)


def test_cosine_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 40)
    r = np.abs(vectors(300, 4, 3)) + 0.1
    want = brute(r, r, 5, lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), True)
    assert ids(nb.knn_join(frame(spark, r), frame(spark, r), 5, exclude_self=True, metric="cosine")) == want


def test_far_cells_are_left_out(spark, monkeypatch):
    """Two clusters far apart: no query probes the other one."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    r = np.concatenate([rng.normal(size=(200, 2)), rng.normal(size=(200, 2)) + 1000])
    asked = []
    plain = nb._search
    monkeypatch.setattr(nb, "_search", lambda probes, *a, **k: asked.append(probes) or plain(probes, *a, **k))
    nb.knn_join(frame(spark, r), frame(spark, r), 3, exclude_self=True).collect()
    far = asked[1].select(F.col("vec")[0].alias("x"), "node").collect()
    side = {c: x > 500 for x, c in ((h["x"], h["node"]) for h in asked[0].select(F.col("vec")[0].alias("x"), "node").collect())}
    assert all(side[f["node"]] == (f["x"] > 500) for f in far if f["node"] in side)
    assert not asked[2:]  # nobody needs all rows


def small_tree(monkeypatch, share):
    """Three cells at the top, at most four children, so that a few hundred rows need several levels."""
    for name, value in {"BLOCK_ROWS": 10, "CHUNK_ROWS": 25, "TOP_PIVOTS": 3, "FANOUT": 4, "SPLIT_BLOCKS": 2, "WIDE_SHARE": share}.items():
        monkeypatch.setattr(nb, name, value)


@pytest.mark.parametrize("share,p,own", [(2.0, 1, False), (0.3, 2, True), (0.0, 2, True)])
def test_levels_grow_and_stay_exact(spark, monkeypatch, share, p, own):
    """Share 2: every query walks down the tree; share 0: every query meets all rows."""
    small_tree(monkeypatch, share)
    trees = []
    plain = nb._grow
    monkeypatch.setattr(nb, "_grow", lambda *a: trees.append(plain(*a)) or trees[-1])
    r = vectors(320, 3, 7)
    q = r if own else vectors(120, 3, 8)
    got = ids(nb.knn_join(frame(spark, q), frame(spark, r), 6, p, exclude_self=own))
    assert got == brute(q, r, 6, minkowski(p), own)
    assert len(trees[0].levels) >= 2
    distinct = len(np.unique(r, axis=0))
    assert trees[0].rows.count() == distinct == trees[0].sizes.agg(F.sum("n")).first()[0]


def test_levels_by_class(spark, monkeypatch):
    small_tree(monkeypatch, 2.0)
    r = vectors(200, 2, 9)
    df = frame(spark, r).withColumn("y", (F.col("row_id") % 2).cast("int"))
    for row in nb.knn_equal_class(df, df, 3, [0, 1], exclude_self=True).collect():
        of_class = [j for j in range(200) if j % 2 == row["y"] and j != row["row_id"]]
        d = np.round([np.linalg.norm(r[row["row_id"]] - r[j]) for j in of_class], 9)
        assert [n["ref_id"] for n in row["neighbors"]] == [j for _, j in sorted(zip(d, of_class))][:3]


def test_clusters_in_many_dimensions_are_left_out(spark, monkeypatch):
    """64 dimensions in 40 clusters: fewer than half of the pairs are compared."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(40, 64))
    r = centre[np.arange(800) % 40] + 0.05 * rng.normal(size=(800, 64))
    searched = []
    search = nb._search
    monkeypatch.setattr(nb, "_search", lambda probes, rows, *a: searched.append((probes, rows)) or search(probes, rows, *a))
    got = ids(nb.knn_join(frame(spark, r), frame(spark, r), 5, exclude_self=True))
    assert got == brute(r, r, 5, minkowski(2), True)
    pairs = sum(
        p.groupBy("node").count().withColumnRenamed("count", "a").join(v.groupBy("node").count(), "node").agg(F.sum(F.col("a") * F.col("count"))).first()[0] or 0
        for p, v in searched
    )
    assert pairs < 0.5 * 800 * 800


def test_bisectors_leave_out_cells_in_few_dimensions(spark, monkeypatch):
    """Six even dimensions: 0.51 of the pairs are compared; the triangle inequality alone left 0.77 of them."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 20)
    r = np.random.default_rng(11).random((1600, 6))
    searched = []
    search = nb._search
    monkeypatch.setattr(nb, "_search", lambda probes, rows, *a: searched.append((probes, rows)) or search(probes, rows, *a))
    got = ids(nb.knn_join(frame(spark, r), frame(spark, r), 3, exclude_self=True))
    assert got == brute(r, r, 3, minkowski(2), True)
    pairs = sum(
        p.groupBy("node").count().withColumnRenamed("count", "a").join(v.groupBy("node").count(), "node").agg(F.sum(F.col("a") * F.col("count"))).first()[0] or 0
        for p, v in searched
    )
    assert pairs < 0.6 * 1600 * 1600


def test_fewer_references_than_k(spark):
    r = vectors(4, 2, 5)
    got = ids(nb.knn_join(frame(spark, r), frame(spark, r), 9, exclude_self=True))
    assert all(sorted(v) == [j for j in range(4) if j != i] for i, v in got.items())


@pytest.mark.parametrize("block", [2048, 20])
def test_same_number_by_class(spark, monkeypatch, block):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)
    r = vectors(90, 3, 6)
    df = frame(spark, r).withColumn("y", (F.col("row_id") % 3).cast("int"))
    found = nb.knn_equal_class(df, df, 4, [0, 1, 2], exclude_self=True)
    for row in found.collect():
        of_class = [j for j in range(90) if j % 3 == row["y"] and j != row["row_id"]]
        d = np.round([np.linalg.norm(r[row["row_id"]] - r[j]) for j in of_class], 9)
        assert [n["ref_id"] for n in row["neighbors"]] == [j for _, j in sorted(zip(d, of_class))][:4]


def test_arguments(spark):
    df = frame(spark, vectors(5, 2, 0))
    for bad in ({"k": 0}, {"k": 1, "p": 0.5}, {"k": 1, "metric": "jaccard"}, {"k": 1, "metric": "mahalanobis"}):
        with pytest.raises(ValueError):
            nb.knn_join(df, df, **bad)
    with pytest.raises(ValueError):
        nb.KNN(["x"], weights="square")


def test_plan_has_no_cross_join(spark):
    df = frame(spark, vectors(60, 2, 0))
    plan = nb.knn_join(df, df, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("p", [1, 1.5, 2, 3])
def test_blocks_meet_in_little_memory(p):
    """Rows far from zero, many references: as brute force, and no step holds all distances."""
    rng = np.random.default_rng(6)
    r = rng.normal(size=(9000, 24)) + 50
    r[4000:4100] = r[0]
    q, counts = r[:700], np.where(np.arange(9000) % 7 == 0, 2, 1)
    flat = np.arange(counts.sum())
    tracemalloc.start()
    at, ref, dist = nb._best(q, r, counts, flat, 5, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    owner = np.repeat(np.arange(9000), counts)
    for i in (0, 1, 699):
        d = np.round((np.abs(r - q[i]) ** p).sum(axis=1) ** (1 / p), 9)[owner]
        want = np.lexsort((flat, d))[:5]
        assert ref[at == i].tolist() == want.tolist() and np.allclose(dist[at == i], d[want], atol=2e-9)


@pytest.mark.parametrize("p", [2, 3])
def test_near_ties_meet_in_little_memory(p):
    """Distances that differ by less than their error, as those of sure output profiles: every pair is a candidate."""
    rng = np.random.default_rng(8)
    r = np.eye(10)[np.zeros((6000, 2), int)].reshape(6000, 20) + rng.uniform(0, 1e-7, (6000, 20))
    q, counts = r[:512], np.where(np.arange(6000) % 7 == 0, 2, 1)
    flat = np.arange(counts.sum())
    tracemalloc.start()
    at, ref, dist = nb._best(q, r, counts, flat, 5, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    owner = np.repeat(np.arange(6000), counts)
    for i in (0, 1, 511):
        d = np.round((np.abs(r - q[i]) ** p).sum(axis=1) ** (1 / p), 9)[owner]
        want = np.lexsort((flat, d))[:5]
        assert ref[at == i].tolist() == want.tolist() and np.allclose(dist[at == i], d[want], atol=2e-9)


def test_reach_cuts_what_a_query_needs():
    r = np.random.default_rng(7).normal(size=(500, 3))
    one = np.ones(500, np.int64)
    at, ref, dist = nb._best(r[:50], r, one, np.arange(500), 5, 2)
    fifth = np.array([dist[at == i].max() for i in range(50)])
    for p in (2, 3, 1):
        full = nb._best(r[:50], r, one, np.arange(500), 5, p)
        reach = np.array([full[2][full[0] == i].max() for i in range(50)])
        again = nb._best(r[:50], r, one, np.arange(500), 5, p, False, reach)
        assert all(np.array_equal(a, b) for a, b in zip(full, again))
    none = nb._best(r[:50], r + 100, one, np.arange(500), 5, 2, False, fifth)
    assert not len(none[0])


def test_pivots_meet_rows_by_steps(spark, monkeypatch):
    """No task compares a whole batch of rows with all pivots at once."""
    for name, value in {"BLOCK_ROWS": 10, "CHUNK_ROWS": 10, "STEP_CELLS": 400}.items():
        monkeypatch.setattr(nb, name, value)
    plain = nb._all_distances

    def small(q, r, p):
        if len(q) * len(r) > 400:
            raise ValueError(f"{len(q)} x {len(r)} at once")
        return plain(q, r, p)

    monkeypatch.setattr(nb, "_all_distances", small)
    monkeypatch.setattr(nb, "STEP_QUERIES", 10)
    x = vectors(300, 3, 8)
    assert ids(nb.knn_join(frame(spark, x), frame(spark, x), 4, exclude_self=True)) == brute(x, x, 4, minkowski(2), True)


def test_wide_tiles_count_rows_not_numbers_alone(spark, monkeypatch):
    """Two numbers a row do not make a tile of a million rows."""
    monkeypatch.setattr(nb, "BLOCK_ROWS", 5)
    monkeypatch.setattr(nb, "WIDE_DOUBLES", 600)
    monkeypatch.setattr(nb, "WIDE_SHARE", 0.0)
    sides, plain = [], nb._tiles
    monkeypatch.setattr(nb, "_tiles", lambda s, sizes, load, *a: sides.extend(a) or plain(s, sizes, load, *a))
    x = vectors(2000, 2, 9)
    assert ids(nb.knn_join(frame(spark, x), frame(spark, x), 3, exclude_self=True)) == brute(x, x, 3, minkowski(2), True)
    assert sides and max(sides) <= 600 // (2 + 4)
