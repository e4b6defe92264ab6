"""Blocks of rows: the same rows in the same order, even tasks for a fit."""

import numpy as np

from demur.operators import blocks, mlp
from demur.operators.mlp import MLP


def test_blocks_keep_rows_and_order(spark):
    for width, n in ((1, 0), (3, 250), (700, 7)):
        x = np.arange(n * width, dtype=float).reshape(n, width)
        rows = [(list(map(float, r)), i % 5, i % 3 == 0) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, "x array<double>, yi int, held boolean").coalesce(1)
        found = list(blocks.chunks(blocks.packed(df, "bool", n, 1000, "t").toArrow().to_batches(), "bool"))
        assert sum(len(y) for _, y, _ in found) == n
        if n:
            assert (np.concatenate([f[0] for f in found]) == x).all()
            assert np.concatenate([f[1] for f in found]).tolist() == [r[1] for r in rows]
            assert np.concatenate([f[2] for f in found]).tolist() == [r[2] for r in rows]


def test_a_network_passes_over_even_blocks(spark, monkeypatch):
    """Uneven files made uneven tasks, and each epoch converted every row again."""
    monkeypatch.setattr(mlp, "TASK_ROWS", 100)
    many = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(900)], "row_id long, a double, y int").coalesce(1)
    few = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(900, 910)], many.schema).repartition(9)
    seen, epoch = [], MLP._epoch

    def watched(self, rows, *more):
        seen.append(rows)
        return epoch(self, rows, *more)

    monkeypatch.setattr(MLP, "_epoch", watched)
    MLP(["a"], [2], max_iter=1).fit(many.unionByName(few))
    assert seen[0].dtypes[0] == ("x", "binary")
    sizes = [sum(len(r["yi"]) for r in part) // 4 for part in seen[0].rdd.glom().collect()]
    assert sum(sizes) == 910 and len(sizes) == 8 and max(sizes) - min(sizes) <= 20


def test_tanh_by_one_exponential():
    z = np.concatenate([np.linspace(-30, 30, 4001), [-1e4, 1e4, 0.0, 1e-9]])
    assert np.abs(mlp._tanh(z.copy()) - np.tanh(z)).max() < 1e-15
