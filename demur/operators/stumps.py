"""Boosting over stumps (SAMME): a round is one pass over blocks of rows.

The candidate cuts of a round are weighted quantiles of a sample of about ``SAMPLE`` rows, which the driver holds with
its weights; a table of no more rows is its own sample. Every task adds up the weights of its rows by feature, bin and
class. The best cut, its error and the factor of the missed rows all follow from these sums, and the next pass
replays the rounds since the weights were last written.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from demur.operators.blocks import BLOCKS, chunks, packed, to_blocks, written
from demur.operators.mlp import SUMS, _sums, summed

# Bins by feature, rows of the sample, rows that are worth a task of their own.
BINS, SAMPLE, TASK_ROWS = 32, 10_000, 20_000

# tasks get the kernels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Stump(NamedTuple):
    """Class indices of the rows up to the cut and above it; a stump without a cut has the cut infinity."""

    feature: int
    cut: float
    left: int
    right: int


class Round(NamedTuple):
    """``factor``: of the missed rows; ``scale``: by which all weights are divided."""

    stump: Stump
    factor: float
    scale: float


# --- kernels (run inside tasks) ------------------------------------------------------------
def replayed(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: list[Round]) -> np.ndarray:
    """Weights after some rounds."""
    for (feature, cut, left, right), factor, scale in rounds:
        missed = np.where(x[:, feature] <= cut, left, right) != y
        w = np.where(missed, w * factor, w) / scale
    return w


def cell_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], n_labels: int) -> np.ndarray:
    """Weights by feature, bin and class."""
    out = np.zeros((x.shape[1], BINS, n_labels))
    for f, edges in enumerate(cuts):
        cell = np.searchsorted(edges, x[:, f]) * n_labels + y
        out[f] = np.bincount(cell, w, BINS * n_labels).reshape(BINS, n_labels)
    return out


# --- on the driver -------------------------------------------------------------------------
def weighted_cuts(values: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    """Means of neighbouring values that part the weights about evenly; all such means if there are few values."""
    known, at = np.unique(values, return_inverse=True)
    middles = (known[:-1] + known[1:]) / 2
    if len(middles) < bins:
        return middles
    sums = np.bincount(at, w)
    stride = float(sums.sum()) / bins
    chosen, target = [], stride
    reached = np.cumsum(sums).tolist()
    for i, (before, after) in enumerate(zip(reached, reached[1:])):
        if abs(before - target) < abs(after - target):
            chosen.append(i)
            target += stride
    return middles[chosen]


def best_stump(sums: np.ndarray, cuts: list[np.ndarray]) -> tuple[Stump, float, float]:
    """The stump of largest Gini gain, the weight of all rows and that of the rows it misses."""

    def gini(cells: np.ndarray) -> np.ndarray:
        return 1 - ((cells / cells.sum(axis=-1, keepdims=True)) ** 2).sum(axis=-1)

    whole = sums[0].sum(axis=0)
    best, gain = Stump(0, math.inf, int(whole.argmax()), int(whole.argmax())), 0.0
    sides = np.stack([whole, np.zeros_like(whole)])
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        cells = sums[f, : len(edges) + 1]
        left, right = cells.cumsum(axis=0)[:-1], cells[::-1].cumsum(axis=0)[::-1][1:]
        lw, rw = left.sum(axis=1), right.sum(axis=1)
        with np.errstate(invalid="ignore"):
            gains = gini(whole) - (lw * gini(left) + rw * gini(right)) / (lw + rw)
        gains = np.where((lw > 0) & (rw > 0), gains, -np.inf)
        i = int(gains.argmax())
        if gains[i] > gain:
            gain, sides = gains[i], np.stack([left[i], right[i]])
            best = Stump(f, float(edges[i]), int(left[i].argmax()), int(right[i].argmax()))
    wrong = sum(float(np.delete(side, c).sum()) for side, c in zip(sides, (best.left, best.right)))
    if best.left == best.right:
        best = Stump(0, math.inf, best.left, best.right)
    return best, float(whole.sum()), wrong


def boosted(rows: DataFrame, n_labels: int, rounds: int, learning_rate: float, seed: int, cut_every: int) -> list[tuple[float, Stump]]:
    """Stumps with their weights. ``rows``: ``x array<double>, yi int, w double``; the weights are written every ``cut_every`` rounds."""
    n = rows.count()
    blocks = packed(rows, "float64", n, TASK_ROWS, "stump-rows")
    tasks = blocks.rdd.getNumPartitions()
    share = min(1.0, SAMPLE / n)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (x, y, w) in enumerate(chunks(batches, "float64")):
            keep = np.random.default_rng([seed, part, k]).random(len(y)) < share
            if keep.any():
                yield to_blocks(x[keep], y[keep], w[keep])

    some = list(chunks(blocks.mapInArrow(drawn, BLOCKS).toArrow().to_batches(), "float64"))
    sx, sy, sw = (np.concatenate(a) for a in zip(*some))
    pending: list[Round] = []
    out: list[tuple[float, Stump]] = []
    for i in range(rounds):
        if len(pending) >= cut_every:

            def reweighted(batches: Iterator[pa.RecordBatch], since=tuple(pending)) -> Iterator[pa.RecordBatch]:
                for x, y, w in chunks(batches, "float64"):
                    yield to_blocks(x, y, replayed(x, y, w, since))

            blocks, pending = written(blocks.mapInArrow(reweighted, BLOCKS), "stump-rows"), []
            tasks = blocks.rdd.getNumPartitions()
        cuts = [weighted_cuts(sx[:, f], sw, min(BINS, n)) for f in range(sx.shape[1])]

        def run(batches: Iterator[pa.RecordBatch], cuts=cuts, since=tuple(pending)) -> Iterator[pa.RecordBatch]:
            sums, count = np.zeros((len(cuts), BINS, n_labels)), 0
            for x, y, w in chunks(batches, "float64"):
                sums, count = sums + cell_sums(x, y, replayed(x, y, w, since), cuts, n_labels), count + len(y)
            yield _sums(TaskContext.get().partitionId(), [count, 0, 0, 0], sums.ravel())

        sums = sum(np.array(r["state"]) for r in summed(blocks.mapInArrow(run, SUMS), tasks))
        stump, total, wrong = best_stump(sums.reshape(len(cuts), BINS, n_labels), cuts)
        err = wrong / total
        if err <= 0:
            out.append((1.0, stump))
            break
        if err >= 1 - 1 / n_labels:
            break
        alpha = learning_rate * (math.log((1 - err) / err) + math.log(n_labels - 1))
        out.append((alpha, stump))
        # one factor for the missed rows, the other keeps the mean weight near 1
        pending.append(Round(stump, math.exp(alpha), (total - wrong + wrong * math.exp(alpha)) / total))
        sw = replayed(sx, sy, sw, pending[-1:])
    return out
