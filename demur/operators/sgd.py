"""Linear classifiers by stochastic gradient descent: epochs over partitions, weights averaged after each.

Every task walks its own rows in an order drawn from (seed, epoch, partition) and starts from the common
weights; the averages, by rows, are the next epoch's start. With one partition this is plain descent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.functions.arrays import dot, sum_of
from demur.operators.metrics import label_set
from demur.operators.prep import Scaler
from demur.session import num_lit, quoted, settle

# Share of the absolute values in a mixed penalty, power of the falling schedule, least step of the adaptive one.
MIXED, POWER, LEAST_STEP = 0.15, 0.5, 1e-6


def loss_and_slope(loss: str, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and derivative at margins ``p`` for labels ``y`` of -1 and 1."""
    z = p * y
    if loss == "log_loss":
        return np.logaddexp(0.0, -z), -y / (np.exp(np.minimum(z, 700.0)) + 1)
    if loss == "modified_huber":
        return np.where(z >= -1, np.maximum(0.0, 1 - z) ** 2, -4 * z), np.where(z >= 1, 0.0, np.where(z >= -1, -2 * y * (1 - z), -4 * y))
    raise ValueError(f"loss must be 'log_loss' or 'modified_huber', not {loss!r}")


def first_time(loss: str, alpha: float) -> float:
    """Where the optimal schedule starts, so that its first steps fit the weights' expected size."""
    size = math.sqrt(1 / math.sqrt(alpha))
    slope = float(loss_and_slope(loss, np.array(-size), np.array(1.0))[1])
    return 1 / (size / max(1.0, abs(slope)) * alpha)


def descend(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: np.ndarray, start: float, stride: float, eta: float, how: dict) -> tuple[np.ndarray, float]:
    """One walk over rows. ``w``: a row by class, the last column is the intercept; ``y``: -1 or 1 by row and class.

    Returns the weights and the sum of losses met. The penalty on absolute values is taken off as it
    accrues, and never carries a weight across zero.
    """
    w = w.copy()
    l1 = {"l2": 0.0, "l1": 1.0, "elasticnet": MIXED}[how["penalty"]]
    alpha, schedule, total = how["alpha"], how["schedule"], 0.0
    owed, paid = 0.0, np.zeros_like(w[:, :-1])
    for k, i in enumerate(order):
        t = start + k * stride
        if schedule == "optimal":
            step = 1 / (alpha * (how["t0"] + t))
        elif schedule == "invscaling":
            step = eta / (t + 1) ** POWER
        else:
            step = eta
        p = w[:, :-1] @ x[i] + w[:, -1]
        loss, slope = loss_and_slope(how["loss"], p, y[i])
        total += loss.sum()
        w[:, :-1] *= max(0.0, 1 - (1 - l1) * step * alpha)
        w[:, :-1] -= step * slope[:, None] * x[i]
        w[:, -1] -= step * slope
        if l1:
            owed += l1 * step * alpha
            old = w[:, :-1].copy()
            new = np.where(old > 0, np.maximum(0.0, old - (owed + paid)), np.where(old < 0, np.minimum(0.0, old + (owed - paid)), old))
            paid += new - old
            w[:, :-1] = new
    return w, total


@dataclass
class SGD:
    """Pool member on standardised features; one margin by class, a single one for two labels.

    ``schedule``: constant, optimal, invscaling or adaptive. It ends after ``max_iter`` epochs or ``patience`` ones
    that lower the mean loss by less than ``tol``; the adaptive schedule then goes on with a fifth of the step.
    """

    features: list[str]
    loss: str = "log_loss"
    penalty: str = "l2"
    alpha: float = 1e-4
    schedule: str = "optimal"
    eta0: float = 0.01
    max_iter: int = 1000
    tol: float = 1e-3
    patience: int = 5
    seed: int = 42
    labels: list = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    weights: list = field(default_factory=list)
    losses: list = field(default_factory=list)

    def __post_init__(self):
        if self.schedule not in ("constant", "optimal", "invscaling", "adaptive"):
            raise ValueError(f"unknown schedule {self.schedule!r}")
        loss_and_slope(self.loss, np.zeros(1), np.ones(1))

    def fit(self, df: DataFrame, y: str = "y") -> SGD:
        self.labels = label_set(df, y)
        scaler = Scaler.fit(df, self.features)
        self.stats = {c: list(v) for c, v in scaler.stats.items()}
        yi = (F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col(y)) - 1).cast("int")
        x = F.array(*[F.col(quoted(f)) for f in self.features])
        rows = settle(scaler.apply(df.where(F.col(y).isNotNull())).select(x.alias("x"), yi.alias("yi")), "sgd-rows")
        n, parts = rows.count(), max(1, rows.rdd.getNumPartitions())
        margins = 1 if len(self.labels) == 2 else len(self.labels)
        w, eta = np.zeros((margins, len(self.features) + 1)), self.eta0
        how = {"penalty": self.penalty, "alpha": self.alpha, "schedule": self.schedule, "loss": self.loss}
        how["t0"] = first_time(self.loss, self.alpha) if self.schedule == "optimal" else 0.0
        best, waited, self.losses = math.inf, 0, []
        for epoch in range(self.max_iter):
            w, loss = self._epoch(rows, w, eta, how, epoch, n, parts)
            self.losses.append(loss)
            waited = waited + 1 if loss > best - self.tol else 0
            best = min(best, loss)
            if waited >= self.patience:
                if self.schedule != "adaptive" or eta / 5 < LEAST_STEP:
                    break
                eta, waited = eta / 5, 0
        self.weights = w.tolist()
        return self

    def _epoch(self, rows: DataFrame, w: np.ndarray, eta: float, how: dict, epoch: int, n: int, parts: int) -> tuple[np.ndarray, float]:
        """Averages of the weights that the tasks end with, by their rows, and the mean loss."""
        seed = self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            mine, done, total = w, 0, 0.0
            for k, batch in enumerate(batches):
                m = batch.num_rows
                if not m:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
                c = batch.column(1).to_numpy()
                y = np.where(c[:, None] == (np.arange(len(w)) if len(w) > 1 else np.array([1])), 1.0, -1.0)
                order = np.random.default_rng([seed, epoch, part, k]).permutation(m)
                mine, loss = descend(x, y, mine, order, epoch * n + done * parts, parts, eta, how)
                done, total = done + m, total + loss
            yield pa.RecordBatch.from_arrays([pa.array([float(done)]), pa.array([total]), pa.array([mine.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "loss", "w"])

        # a row by task
        found = rows.mapInArrow(run, "n double, loss double, w array<double>").collect()
        share = np.array([r["n"] for r in found]) / max(1, n)
        return np.tensordot(share, np.array([r["w"] for r in found]), 1).reshape(w.shape), sum(r["loss"] for r in found) / max(1, n)

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        scaled = ", ".join(f"(cast({quoted(f)} as double) - {num_lit(m)}) / {num_lit(s)}" for f, (m, s) in self.stats.items())
        margins = [f"{dot('_x', 'array(' + ', '.join(num_lit(v) for v in row[:-1]) + ')')} + {num_lit(row[-1])}" for row in self.weights]
        to_share = "1 / (1 + exp(-p))" if self.loss == "log_loss" else "(least(1D, greatest(-1D, p)) + 1) / 2"
        out = df.withColumn("_x", F.expr(f"array({scaled})")).withColumn("_p", F.expr(f"transform(array({', '.join(margins)}), p -> {to_share})"))
        if len(margins) == 1:
            shares = "array(1 - _p[0], _p[0])"
        else:
            shares = f"transform(array({sum_of('_p')}), t -> transform(_p, p -> if(t = 0, {num_lit(1 / len(margins))}, p / t)))[0]"
        return out.select(*df.columns, F.expr(shares).alias(name))
