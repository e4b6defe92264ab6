"""Gaussian naive Bayes and quadratic discriminant: one grouped aggregate to fit, expressions to score."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.functions.arrays import softmax
from demur.operators.metrics import MAX_LABELS
from demur.session import num_lit, quoted

# Fixed value: share of the largest feature variance added to every variance.
VAR_SMOOTHING = 1e-9
# Terms of a member's log scores that are written out as compiled code.
UNROLLED_TERMS = 40


def _long_sum(features: list[str], const: float, mean: list[float], var: list[float]) -> str:
    """Log density over arrays: short code for any number of features."""
    xs = f"array({', '.join(quoted(f) for f in features)})"
    ms = f"array({', '.join(num_lit(m) for m in mean)})"
    ws = f"array({', '.join(num_lit(0.5 / v) for v in var)})"
    gaps = f"zip_with({xs}, {ms}, (x, m) -> x - m)"
    return f"aggregate(zip_with({gaps}, {ws}, (d, w) -> d * d * w), {num_lit(const)}, (s, t) -> s - t)"


def add_softmax(df: DataFrame, log_scores: dict[str, list[str]]) -> DataFrame:
    """Adds one array of probabilities by name from its log scores by class (SQL).

    Two steps: the long sums are compiled code over plain columns, the soft-max works on short arrays.
    """
    raw = {f"_ll_{name}": F.expr(f"array({', '.join(terms)})") for name, terms in log_scores.items()}
    out = df.withColumns(raw)
    out = out.withColumns({name: F.expr(softmax(quoted(f"_ll_{name}"))) for name in log_scores})
    return out.drop(*raw)


@dataclass
class GaussianNB:
    """Fitted parameters; ``labels`` fix the order of the classes."""

    features: list[str]
    labels: list = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    mean: list[list[float]] = field(default_factory=list)
    var: list[list[float]] = field(default_factory=list)

    def fit(self, df: DataFrame, y: str = "y") -> GaussianNB:
        fit_gaussian_nb_pool([self], df, y)
        return self

    def log_scores(self) -> list[str]:
        """Joint log likelihood by class, as SQL."""
        out = []
        for prior, mean, var in zip(self.prior, self.mean, self.var):
            const = math.log(prior) - 0.5 * sum(math.log(2 * math.pi * v) for v in var)
            if len(self.features) * len(self.labels) > UNROLLED_TERMS:
                out.append(_long_sum(self.features, const, mean, var))
                continue
            terms = [num_lit(const)]
            for name, m, v in zip(self.features, mean, var):
                d = f"({quoted(name)} - {num_lit(m)})"
                terms.append(f"-({d} * {d} / {num_lit(2 * v)})")
            out.append("(" + " + ".join(terms) + ")")
        return out

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        return add_softmax(df, {name: self.log_scores()})


def fit_gaussian_nb_pool(members: list[GaussianNB], df: DataFrame, y: str = "y") -> list[GaussianNB]:
    """Fits several members in one pass over the data: statistics of the union of their features."""
    names = sorted({f for m in members for f in m.features})
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        aggs += [F.avg(quoted(name)).alias(f"m{i}"), F.var_pop(quoted(name)).alias(f"v{i}")]
    rows = df.groupBy(F.col(y).alias("y")).agg(*aggs).limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"{y} has more than {MAX_LABELS} distinct labels")
    rows = sorted(rows, key=lambda r: r["y"])
    total = sum(r["n"] for r in rows)
    for m in members:
        at = [names.index(f) for f in m.features]
        # variance of the whole column from the class moments
        spread = []
        for i in at:
            centre = sum(r["n"] * r[f"m{i}"] for r in rows) / total
            spread.append(sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - centre) ** 2) for r in rows) / total)
        floor = VAR_SMOOTHING * max(spread)
        m.labels = [r["y"] for r in rows]
        m.prior = [r["n"] / total for r in rows]
        m.mean = [[r[f"m{i}"] for i in at] for r in rows]
        m.var = [[r[f"v{i}"] + floor for i in at] for r in rows]
    return members


# directions with less than this share of the largest pooled variance, of unit features, count as none
RANK_TOLERANCE = 1e-10


def densities(covs: np.ndarray, pooled: np.ndarray) -> list[tuple[list, float]]:
    """Inverse and log determinant of each covariance in the directions that the pooled one spans."""
    unit = np.sqrt(np.diag(pooled))
    used = unit > 0
    scale = np.where(used, unit, 1.0)
    values, vectors = np.linalg.eigh(pooled / np.outer(scale, scale))
    basis = vectors[:, values > RANK_TOLERANCE * max(values.max(initial=0.0), 1e-300)] / scale[:, None]
    if not basis.shape[1]:
        raise ValueError("no feature varies inside a class")
    floor = VAR_SMOOTHING * values.max()
    out = []
    for cov in covs:
        own, turn = np.linalg.eigh(basis.T @ cov @ basis)
        own = np.maximum(own, floor)
        part = basis @ turn
        out.append(((part / own @ part.T).tolist(), float(np.log(own).sum())))
    return out


@dataclass
class QDA:
    """Quadratic discriminant: class means and sample covariances.

    Features that depend on each other (pooled over the classes) span fewer directions than there are features;
    the densities are those in these directions. In a direction in which one class alone does not vary, its
    variance counts as ``VAR_SMOOTHING`` of the largest pooled one.
    """

    features: list[str]
    labels: list = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    mean: list[list[float]] = field(default_factory=list)
    precision: list[list[list[float]]] = field(default_factory=list)
    logdet: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, y: str = "y") -> QDA:
        d = len(self.features)
        cols = [F.col(quoted(f)).cast("double") for f in self.features]
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        rows = (
            df.groupBy(F.col(y).alias("y"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs],
            )
            .limit(MAX_LABELS + 1)
            .collect()
        )
        if len(rows) > MAX_LABELS:
            raise ValueError(f"{y} has more than {MAX_LABELS} distinct labels")
        rows = sorted(rows, key=lambda r: r["y"])
        total = sum(r["n"] for r in rows)
        self.labels = [r["y"] for r in rows]
        self.prior = [r["n"] / total for r in rows]
        self.mean = [[r[f"m{i}"] for i in range(d)] for r in rows]
        covs = np.zeros((len(rows), d, d))
        for k, r in enumerate(rows):
            for i, j in pairs:
                # a single row has no covariance
                covs[k, i, j] = covs[k, j, i] = r[f"c{i}_{j}"] or 0.0
        weights = np.array([r["n"] - 1 for r in rows], float)
        pooled = np.tensordot(weights, covs, 1) / max(1.0, weights.sum())
        self.precision, self.logdet = zip(*(p for p in densities(covs, pooled)))
        self.precision, self.logdet = list(self.precision), list(self.logdet)
        return self

    def log_scores(self) -> list[str]:
        """Log prior plus log density by class up to a shared constant, as SQL."""
        d = len(self.features)
        scores = []
        for prior, mean, prec, logdet in zip(self.prior, self.mean, self.precision, self.logdet):
            z = [f"({quoted(f)} - {num_lit(m)})" for f, m in zip(self.features, mean)]
            terms = [num_lit(math.log(prior) - 0.5 * logdet)]
            for i in range(d):
                for j in range(i, d):
                    weight = prec[i][j] * (0.5 if i == j else 1.0)
                    terms.append(f"-({num_lit(weight)} * {z[i]} * {z[j]})")
            scores.append("(" + " + ".join(terms) + ")")
        return scores

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        return add_softmax(df, {name: self.log_scores()})
