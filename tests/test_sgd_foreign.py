"""Descent against a plain numpy run in the same order, storage, and members of other libraries."""

import json

import numpy as np
import pytest

from demur.operators import sgd
from demur.operators.foreign import ForeignMember
from demur.operators.pool import Pool
from demur.operators.sgd import SGD
from demur.sources import members
from demur.sources.runs import Registry


def frame(spark, n, n_classes, seed, parts=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1, 50]
    y = np.digitize(x[:, 0] + x[:, 1] / 50 + 0.3 * rng.normal(size=n), [0.0, 1.0][: n_classes - 1])
    rows = [(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, `b b` double, y int").coalesce(parts)


def plain_epochs(x, y, member, epochs, n_margins):
    """The same walk, one class at a time and one weight at a time."""
    n, d = x.shape
    w, losses = np.zeros((n_margins, d + 1)), []
    l1 = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15}[member.penalty]
    t0 = sgd.first_time(member.loss, member.alpha)
    for epoch in range(epochs):
        order = np.random.default_rng([member.seed, epoch, 0, 0]).permutation(n)
        owed, paid, total = 0.0, np.zeros((n_margins, d)), 0.0
        for k, i in enumerate(order):
            t = epoch * n + k
            eta = {"constant": member.eta0, "invscaling": member.eta0 / np.sqrt(t + 1), "optimal": 1 / (member.alpha * (t0 + t))}[member.schedule]
            owed += l1 * eta * member.alpha
            for c in range(n_margins):
                target = 1 if y[i] == (c if n_margins > 1 else 1) else -1
                p = float(w[c, :d] @ x[i] + w[c, d])
                z = p * target
                if member.loss == "log_loss":
                    total += np.log1p(np.exp(-z))
                    slope = -target / (1 + np.exp(z))
                else:
                    total += max(0, 1 - z) ** 2 if z >= -1 else -4 * z
                    slope = 0.0 if z >= 1 else -2 * target * (1 - z) if z >= -1 else -4 * target
                for f in range(d):
                    v = w[c, f] * max(0.0, 1 - (1 - l1) * eta * member.alpha) - eta * slope * x[i, f]
                    if l1:
                        new = max(0.0, v - owed - paid[c, f]) if v > 0 else min(0.0, v + owed - paid[c, f]) if v < 0 else v
                        paid[c, f] += new - v
                        v = new
                    w[c, f] = v
                w[c, d] -= eta * slope
        losses.append(total / n)
    return w, losses


@pytest.mark.parametrize(
    "loss,penalty,schedule,n_classes", [("log_loss", "l2", "optimal", 2), ("modified_huber", "l1", "invscaling", 3), ("log_loss", "elasticnet", "constant", 3)]
)
def test_epochs_equal_a_numpy_run(spark, monkeypatch, loss, penalty, schedule, n_classes):
    monkeypatch.setattr(sgd, "settle", lambda df, name: df)  # one partition stays one
    df = frame(spark, 150, n_classes, 2)
    member = SGD(["a", "b b"], loss, penalty, alpha=0.01, schedule=schedule, eta0=0.05, max_iter=4).fit(df)
    rows = df.orderBy("row_id").collect()
    x = np.array([[r["a"], r["b b"]] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    want, losses = plain_epochs(x, np.array([r["y"] for r in rows]), member, 4, 1 if n_classes == 2 else n_classes)
    assert np.allclose(member.weights, want) and np.allclose(member.losses, losses)
    assert losses[-1] < losses[0]
    p = np.array([r["p"] for r in member.add_probability(df, "p").orderBy("row_id").collect()])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == [r["y"] for r in rows]).mean() > 0.7


def test_several_partitions_and_adaptive_steps(spark):
    df = frame(spark, 800, 2, 3, parts=4).repartition(6)
    member = SGD(["a", "b b"], schedule="adaptive", eta0=0.1, max_iter=40).fit(df)
    p = [(r["y"], r["p"][1]) for r in member.add_probability(df, "p").collect()]
    assert np.mean([(v > 0.5) == bool(y) for y, v in p]) > 0.9 and member.losses[-1] < 0.35
    with pytest.raises(ValueError):
        SGD(["a"], schedule="none")
    with pytest.raises(ValueError):
        SGD(["a"], loss="hinge")


class Nearest:
    """A classifier of someone else: nearest class mean."""

    def fit(self, x, y):
        self.classes_ = np.unique(y)
        self.means = np.stack([x[y == c].mean(axis=0) for c in self.classes_])
        return self

    def predict_proba(self, x):
        e = np.exp(-np.abs(x[:, None, :] - self.means).sum(axis=2))
        return e / e.sum(axis=1, keepdims=True)


def test_foreign_members_fit_store_load_and_score(spark, tmp_path):
    df = frame(spark, 120, 3, 4, parts=2)
    features = ["a", "b b"]
    pool = Pool({"mine": ForeignMember(Nearest(), features, max_rows=100), "sgd": SGD(features, max_iter=3)}).fit(df)
    scored = pool.predict_proba(df).select("row_id", "probas").orderBy("row_id").collect()
    assert all(abs(sum(p) - 1) < 1e-9 for r in scored for p in r["probas"])
    registry = Registry(spark, str(tmp_path / "runs"))
    for name, member in pool.members.items():
        registry.append("e", name, {}, {}, member)
    again = Pool(registry.load_members("e", ["mine", "sgd"]))
    assert again.labels == pool.labels == [0, 1, 2]
    assert again.predict_proba(df).select("row_id", "probas").orderBy("row_id").collect() == scored
    ready = ForeignMember(pool["mine"].model, features)
    assert ready.labels == [0, 1, 2]
    path = registry.lookup("e", "mine")["model_path"]
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    about["mark"]["numpy"] = "0.1"
    with pytest.raises(ValueError, match="was written with"):
        members._read(spark, about, path)
