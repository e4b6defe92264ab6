"""Feed-forward networks by mini-batches: every task walks its own rows, the states are averaged after each epoch.

An epoch is one job. A task starts from the common weights and the common memory of the solver, takes its
rows in mini-batches in an order drawn from (seed, epoch, partition), and hands on one state. States are summed
by a tree of tasks, so the driver sees a few of them however many tasks there are. With one partition this is
plain mini-batch descent.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demur.operators.blocks import chunks, packed
from demur.operators.metrics import label_set
from demur.operators.prep import Scaler
from demur.session import quoted, settle

# Momentum of plain descent, decay of the two means of Adam, its least denominator, least step of the adaptive schedule.
MOMENTUM, DECAY, LEAST_ROOT, LEAST_STEP = 0.9, (0.9, 0.999), 1e-8, 1e-6

# rows that are worth a task of their own, states that one task adds up, share of the rows held out by the early stop
TASK_ROWS, FAN_IN, HELD_OUT = 20_000, 32, 10

ACTIVATIONS = ("relu", "tanh", "logistic")

# tasks get the kernels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- kernels (run inside tasks) ------------------------------------------------------------
def layers(w: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Views of the flat weights: a matrix by layer, whose last row is the intercept."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(w[at : at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def _tanh(z: np.ndarray) -> np.ndarray:
    """Hyperbolic tangent in place by one exponential, to the last digit of 1; numpy's own takes about twice as long."""
    z *= 2
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.divide(-2.0, z, out=z)
    z += 1
    return z


def _activate(z: np.ndarray, activation: str) -> np.ndarray:
    if activation == "relu":
        return np.maximum(z, 0.0)
    return _tanh(z) if activation == "tanh" else 0.5 * (1 + _tanh(z / 2))


def _activation_slope(a: np.ndarray, activation: str) -> np.ndarray:
    """Derivative of the activation, from its value."""
    if activation == "relu":
        return (a > 0).astype(float)
    if activation == "tanh":
        slope = a * a
        return np.subtract(1, slope, out=slope)
    return a * (1 - a)


def forward(w: np.ndarray, sizes: list[int], x: np.ndarray, activation: str) -> list[np.ndarray]:
    """Values of all layers; the last are the margins."""
    values = [x]
    parts = layers(w, sizes)
    for i, m in enumerate(parts):
        z = values[-1] @ m[:-1]
        z += m[-1]
        values.append(z if i == len(parts) - 1 else _activate(z, activation))
    return values


def shares(margins: np.ndarray, n_labels: int) -> np.ndarray:
    """Probabilities by label; two labels have a single margin."""
    if n_labels == 2:
        p = 0.5 * (1 + np.tanh(margins / 2))
        return np.hstack([1 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(w: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, n_labels: int, activation: str, alpha: float) -> tuple[float, np.ndarray]:
    """Mean log loss with the penalty ``alpha / 2 * |weights|^2 / rows`` (intercepts are free), and its gradient."""
    n, values = len(x), forward(w, sizes, x, activation)
    z = values[-1]
    if n_labels == 2:
        loss = float((np.logaddexp(0.0, z[:, 0]) - z[:, 0] * y).mean())
        delta = (shares(z, 2)[:, 1:] - y[:, None]) / n
    else:
        top = z.max(axis=1)
        loss = float((np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(n), y]).mean())
        delta = shares(z, n_labels)
        delta[np.arange(n), y] -= 1
        delta /= n
    gradient = np.empty_like(w)
    parts, slots = layers(w, sizes), layers(gradient, sizes)
    for i in range(len(parts) - 1, -1, -1):
        m, g = parts[i], slots[i]
        g[:-1] = values[i].T @ delta + alpha / n * m[:-1]
        g[-1] = delta.sum(axis=0)
        loss += alpha / (2 * n) * float((m[:-1] ** 2).sum())
        if i:
            delta = delta @ m[:-1].T
            delta *= _activation_slope(values[i], activation)
    return loss, gradient


def advance(state: np.ndarray, gradient: np.ndarray, solver: str, eta: float) -> None:
    """One step in place. ``state``: weights, one or two means of the gradients, number of steps."""
    d = len(gradient)
    w = state[:d]
    state[-1] += 1
    if solver == "sgd":
        speed = state[d : 2 * d]
        speed *= MOMENTUM
        speed -= eta * gradient
        w += MOMENTUM * speed - eta * gradient
        return
    first, second = state[d : 2 * d], state[2 * d : 3 * d]
    first *= DECAY[0]
    first += (1 - DECAY[0]) * gradient
    second *= DECAY[1]
    second += (1 - DECAY[1]) * gradient**2
    step = eta * math.sqrt(1 - DECAY[1] ** state[-1]) / (1 - DECAY[0] ** state[-1])
    w -= step * first / (np.sqrt(second) + LEAST_ROOT)


def first_weights(sizes: list[int], activation: str, seed: int) -> np.ndarray:
    """Even draws whose spread fits the widths of the two layers that they join."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = math.sqrt((2 if activation == "logistic" else 6) / (a + b))
        out.append(rng.uniform(-bound, bound, (a + 1) * b))
    return np.concatenate(out)


def _sums(part: int, counts: list[float], state: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), *(pa.array([float(c)]) for c in counts), pa.array([state], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "loss", "held", "hits", "state"])


SUMS = "part int, n double, loss double, held double, hits double, state array<double>"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a task."""
    part, counts, state = None, np.zeros(4), None
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.column(0)[i].as_py() if part is None else part
            counts += [batch.column(k)[i].as_py() for k in range(1, 5)]
            one = batch.column(5)[i].values.to_numpy()
            state = one.copy() if state is None else state + one
    if state is not None:
        yield _sums(part, counts.tolist(), state)


def summed(found: DataFrame, tasks: int) -> list:
    """At most ``FAN_IN`` rows with the sums of all tasks, in the order of the tasks."""
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        found = found.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_added, SUMS)
    return sorted(found.collect(), key=lambda r: r["part"])


# --- the member ----------------------------------------------------------------------------
@dataclass
class MLP:
    """Pool member on standardised features; a logistic output for two labels, else one by label.

    ``solver``: adam, or sgd with momentum; ``schedule``: constant or adaptive (sgd goes on with a fifth of the step
    where it would end). It ends after ``max_iter`` epochs or ``patience`` ones without a gain above ``tol``: in the
    mean loss or, with ``early_stop``, in the accuracy on a tenth of the rows that is held out by the hash of
    ``row_id``; the weights are then those of the best epoch. Rows with a null or NaN feature are left out of the fit and score null.
    """

    features: list[str]
    hidden: list[int] = field(default_factory=lambda: [100])
    activation: str = "relu"
    solver: str = "adam"
    alpha: float = 1e-4
    schedule: str = "constant"
    eta0: float = 1e-3
    max_iter: int = 200
    early_stop: bool = False
    tol: float = 1e-4
    patience: int = 10
    batch: int = 200
    seed: int = 42
    labels: list = field(default_factory=list)
    stats: dict = field(default_factory=dict)
    weights: list = field(default_factory=list)
    losses: list = field(default_factory=list)

    def __post_init__(self):
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"activation must be one of {ACTIVATIONS}")
        if self.solver not in ("adam", "sgd"):
            raise ValueError("solver must be 'adam' or 'sgd'")
        if self.schedule not in ("constant", "adaptive"):
            raise ValueError("schedule must be 'constant' or 'adaptive'")
        if any(h < 1 for h in self.hidden):
            raise ValueError("a layer needs at least one node")

    def sizes(self) -> list[int]:
        return [len(self.features), *self.hidden, 1 if len(self.labels) == 2 else len(self.labels)]

    def _whole(self) -> str:
        """Condition: no feature is null or NaN."""
        return " and ".join(f"{quoted(f)} is not null and not isnan(cast({quoted(f)} as double))" for f in self.features)

    def fit(self, df: DataFrame, y: str = "y") -> MLP:
        known = df.where(F.col(y).isNotNull() & F.expr(self._whole()))
        self.labels = label_set(known, y)
        if not self.labels:
            raise ValueError("there is no row with a label and all features")
        scaler = Scaler.fit(known, self.features)
        self.stats = {c: list(v) for c, v in scaler.stats.items()}
        yi = (F.array_position(F.array(*[F.lit(v) for v in self.labels]), F.col(y)) - 1).cast("int")
        x = F.array(*[F.col(quoted(f)).cast("double") for f in self.features])
        out = F.expr(f"pmod(xxhash64({self.seed}L, row_id), {HELD_OUT}) = 0") if self.early_stop else F.lit(False)
        rows = settle(scaler.apply(known).select(x.alias("x"), yi.alias("yi"), out.alias("held")), "mlp-rows")
        rows = packed(rows, "bool", rows.count(), TASK_ROWS, "mlp-blocks")
        tasks = rows.rdd.getNumPartitions()
        w = first_weights(self.sizes(), self.activation, self.seed)
        state = np.concatenate([w, np.zeros(len(w) * (2 if self.solver == "adam" else 1) + 1)])
        eta, best, kept, waited, self.losses = self.eta0, -math.inf, w, 0, []
        # an epoch scores the held rows by the weights it starts from, so the last weights need one more
        for epoch in range(self.max_iter + self.early_stop):
            n, loss, held, hits, after = self._epoch(rows, state, eta, epoch, tasks)
            self.losses.append(loss)
            gain = hits / held if held else -loss
            if gain > best:
                kept = state[: len(w)] if held else after[: len(w)]
            waited = 0 if gain > best + self.tol else waited + 1
            best, state = max(best, gain), after
            if waited >= self.patience:
                if self.solver != "sgd" or self.schedule != "adaptive" or eta <= LEAST_STEP:
                    break
                eta, waited = eta / 5, 0
        self.weights = (kept if self.early_stop else state[: len(w)]).tolist()
        return self

    def _epoch(self, rows: DataFrame, start: np.ndarray, eta: float, epoch: int, tasks: int | None = None) -> tuple[float, float, float, float, np.ndarray]:
        """Rows, mean loss, held rows, those of them that the first weights get right, and the mean state by rows."""
        sizes, n_labels, size = self.sizes(), len(self.labels), self.batch
        activation, solver, alpha, seed = self.activation, self.solver, self.alpha, self.seed
        d = sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            state, n, total, held, hits = start.copy(), 0, 0.0, 0, 0
            for k, (x, y, out) in enumerate(chunks(batches, "bool")):
                if out.any():
                    p = shares(forward(start[:d], sizes, x[out], activation)[-1], n_labels)
                    held, hits = held + int(out.sum()), hits + int((p.argmax(axis=1) == y[out]).sum())
                order = np.flatnonzero(~out)
                order = order[np.random.default_rng([seed, epoch, part, k]).permutation(len(order))]
                for at in range(0, len(order), size):
                    own = order[at : at + size]
                    loss, gradient = loss_and_gradient(state[:d], sizes, x[own], y[own], n_labels, activation, alpha)
                    advance(state, gradient, solver, eta)
                    n, total = n + len(own), total + loss * len(own)
            yield _sums(part, [n, total, held, hits], state * n)

        found, tasks = rows.mapInArrow(run, SUMS), tasks or rows.rdd.getNumPartitions()
        n, loss, held, hits, state = 0.0, 0.0, 0.0, 0.0, np.zeros_like(start)
        for r in summed(found, tasks):
            n, loss, held, hits = n + r["n"], loss + r["loss"], held + r["held"], hits + r["hits"]
            state += np.array(r["state"])
        return n, loss / max(1.0, n), held, hits, state / n if n else start

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        w, sizes, n_labels, activation = np.array(self.weights), self.sizes(), len(self.labels), self.activation
        mean, spread = (np.array([self.stats[f][i] for f in self.features]) for i in (0, 1))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(x: pa.Array) -> pa.Array:
            v = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, sizes[0]))
            p = shares(forward(w, sizes, (v - mean) / spread, activation)[-1], n_labels)
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * n_labels)
            return pa.ListArray.from_arrays(offsets, pa.array(p.ravel()), mask=pa.array(np.isnan(v).any(axis=1)))

        x = F.array(*[F.col(quoted(f)).cast("double") for f in self.features])
        return df.select(*df.columns, score(x).alias(name))


def fit_network(features: list[str], hidden: tuple[int, ...] = (64, 32), max_iter: int = 500, seed: int = 42) -> MLP:
    """The network of the studies: rectified nodes, Adam, ended by the mean loss."""
    return MLP(features, list(hidden), max_iter=max_iter, seed=seed)
