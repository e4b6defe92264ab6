"""Networks: gradients against differences, epochs against a plain numpy run, partitions, early stop, storage and search."""

import numpy as np
import pytest

from demur.operators import mlp, search
from demur.operators.mlp import MLP
from demur.operators.pool import Pool
from demur.sources.runs import Registry

FEATURES = ["a", "b b"]


def frame(spark, n, n_classes, seed, parts=1):
    """Rings around the origin, which no linear member can tell apart."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.digitize((x**2).sum(axis=1), [1.0, 3.0][: n_classes - 1])
    rows = [(i, float(a), float(b) * 50 + 7, int(k)) for i, ((a, b), k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, `b b` double, y int").repartition(parts)


@pytest.mark.parametrize("activation", mlp.ACTIVATIONS)
@pytest.mark.parametrize("n_labels", [2, 4])
def test_gradient_equals_differences(activation, n_labels):
    rng = np.random.default_rng(1)
    sizes = [3, 5, 4, 1 if n_labels == 2 else n_labels]
    w = mlp.first_weights(sizes, activation, 3)
    x, y = rng.normal(size=(11, 3)), rng.integers(0, n_labels, 11)
    _, gradient = mlp.loss_and_gradient(w, sizes, x, y, n_labels, activation, 0.3)
    for i in range(len(w)):
        ends = []
        for h in (1e-6, -1e-6):
            v = w.copy()
            v[i] += h
            ends.append(mlp.loss_and_gradient(v, sizes, x, y, n_labels, activation, 0.3)[0])
        assert abs((ends[0] - ends[1]) / 2e-6 - gradient[i]) < 1e-6


def plain_run(x, y, member, epochs, n_labels):
    """The same mini-batches with one hidden layer, its gradients written out by hand."""
    sizes = [x.shape[1], member.hidden[0], 1 if n_labels == 2 else n_labels]
    (a, b, c), at = sizes, (sizes[0] + 1) * sizes[1]
    w = mlp.first_weights(sizes, member.activation, member.seed)
    first, second, speed, t, losses = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), 0, []
    for epoch in range(epochs):
        order = np.random.default_rng([member.seed, epoch, 0, 0]).permutation(len(x))
        total = 0.0
        for lo in range(0, len(x), member.batch):
            own = order[lo : lo + member.batch]
            n = len(own)
            u, v = w[:at].reshape(a + 1, b), w[at:].reshape(b + 1, c)
            inner = np.hstack([x[own], np.ones((n, 1))]) @ u
            h = np.tanh(inner) if member.activation == "tanh" else np.where(inner > 0, inner, 0)
            z = np.hstack([h, np.ones((n, 1))]) @ v
            p = 1 / (1 + np.exp(-z)) if n_labels == 2 else np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            target = y[own][:, None] if n_labels == 2 else np.eye(n_labels)[y[own]]
            each = -(target * np.log(p) + (1 - target) * np.log(1 - p)) if n_labels == 2 else -target * np.log(p)
            total += each.sum() + member.alpha / 2 * ((u[:-1] ** 2).sum() + (v[:-1] ** 2).sum())
            dz = (p - target) / n
            dh = dz @ v[:-1].T * (1 - h * h if member.activation == "tanh" else inner > 0)
            gu = np.vstack([x[own].T @ dh + member.alpha / n * u[:-1], dh.sum(axis=0)])
            gv = np.vstack([h.T @ dz + member.alpha / n * v[:-1], dz.sum(axis=0)])
            g, t = np.concatenate([gu.ravel(), gv.ravel()]), t + 1
            if member.solver == "sgd":
                speed = 0.9 * speed - member.eta0 * g
                w = w + 0.9 * speed - member.eta0 * g
            else:
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                w = w - member.eta0 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
        losses.append(total / len(x))
    return w, losses


@pytest.mark.parametrize("solver,activation,n_labels", [("adam", "relu", 3), ("sgd", "tanh", 2)])
def test_epochs_equal_a_numpy_run(spark, monkeypatch, solver, activation, n_labels):
    monkeypatch.setattr(mlp, "settle", lambda df, name: df)  # one partition keeps its order
    df = frame(spark, 130, n_labels, 2).sortWithinPartitions("row_id")
    member = MLP(FEATURES, [6], activation, solver, 0.01, eta0=0.02, max_iter=3, batch=40).fit(df)
    x = np.array([[r["a"], r["b b"]] for r in df.collect()])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w, losses = plain_run(x, np.array([r["y"] for r in df.collect()]), member, 3, n_labels)
    assert np.allclose(member.weights, w, atol=1e-9) and np.allclose(member.losses, losses)


def test_states_are_summed_by_a_tree_of_tasks(spark, monkeypatch):
    df = frame(spark, 400, 3, 4, parts=5)
    member = MLP(FEATURES, [4], max_iter=2).fit(df)
    rows = df.selectExpr("array(a, `b b`) as x", "y as yi", "false as held").repartition(5, "x")
    start = np.zeros(3 * len(member.weights) + 1)
    start[: len(member.weights)] = member.weights
    flat = member._epoch(rows, start, 0.01, 0)
    monkeypatch.setattr(mlp, "FAN_IN", 2)
    tree = member._epoch(rows, start, 0.01, 0)
    assert flat[0] == tree[0] == 400 and np.allclose(flat[1], tree[1]) and np.allclose(flat[4], tree[4])


@pytest.mark.parametrize("settings", [{"eta0": 0.01}, {"solver": "sgd", "activation": "tanh", "schedule": "adaptive", "eta0": 0.1}])
def test_rings_over_several_tasks_with_early_stop(spark, monkeypatch, settings):
    monkeypatch.setattr(mlp, "TASK_ROWS", 400)
    df, other = frame(spark, 1200, 3, 5, parts=3), frame(spark, 400, 3, 6)
    member = MLP(FEATURES, [24], max_iter=60, early_stop=True, patience=20, **settings).fit(df)
    found = [(r["y"], r["p"]) for r in member.add_probability(other, "p").collect()]
    assert np.mean([int(np.argmax(p)) == y for y, p in found]) > 0.85
    assert all(abs(sum(p) - 1) < 1e-9 for _, p in found) and member.losses[-1] < member.losses[0]


def test_odd_rows_and_settings(spark):
    df = frame(spark, 60, 2, 7)
    odd = spark.createDataFrame([(100, None, 1.0, 1), (101, float("nan"), 1.0, 0), (102, 1.0, 1.0, None)], df.schema)
    member = MLP(FEATURES, [3], max_iter=3).fit(df.unionByName(odd))
    assert all(np.isfinite(member.weights)) and member.labels == [0, 1]
    p = {r["row_id"]: r["p"] for r in member.add_probability(odd, "p").collect()}
    assert p[100] is None and p[101] is None and len(p[102]) == 2
    with pytest.raises(ValueError, match="no row"):
        MLP(FEATURES).fit(df.limit(0))
    for bad in ({"activation": "sine"}, {"solver": "lbfgs"}, {"schedule": "none"}, {"hidden": [0]}):
        with pytest.raises(ValueError):
            MLP(FEATURES, **bad)


def test_storage_and_search_over_both_solvers(spark, tmp_path, monkeypatch):
    df = frame(spark, 150, 2, 8)
    pool = Pool({"net": MLP(FEATURES, [5, 3], max_iter=4)}).fit(df)
    scored = pool.predict_proba(df).select("row_id", "probas").orderBy("row_id").collect()
    registry = Registry(spark, str(tmp_path / "runs"))
    registry.append("e", "net", {}, {}, pool["net"])
    again = Pool(registry.load_members("e", ["net"]))
    assert again.predict_proba(df).select("row_id", "probas").orderBy("row_id").collect() == scored
    ranges, short = search.SPACES["MLP"].ranges, search.SPACES["MLP"].make
    assert set(ranges) == {"hidden_layer_sizes", "activation", "solver", "alpha", "learning_rate", "learning_rate_init"}

    def brief(features, d):
        member = short(features, d)
        assert member.early_stop and member.patience == 20 and member.max_iter == 10_000
        member.max_iter = 2
        return member

    monkeypatch.setitem(search.SPACES, "MLP", search.SPACES["MLP"]._replace(make=brief))
    best, ranked = search.search(df, FEATURES, "MLP", trials=2, folds=2)
    assert len(ranked) == 2 and best in [d for d, _ in ranked] and all(0 <= s <= 1 for _, s in ranked)
