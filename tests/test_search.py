"""Scores of shared searches against members that are fitted one by one, and the claim of a run."""

import threading
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.operators import learners, search, trees
from demur.operators.bayes import GaussianNB
from demur.operators.learners import draw_params
from demur.operators.metrics import average_mode, metrics_from_confusion, positive_label
from demur.operators.prep import Scaler
from demur.operators.split import fold_assign
from demur.plans import study
from demur.session import settle
from demur.sources.runs import Registry

FEATURES = ["a", "b b"]


def made(spark, n, n_classes, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)).round(1)
    y = np.digitize(x[:, 0] + 0.7 * rng.normal(size=n), [0.0, 0.9][: n_classes - 1])
    rows = [(i, float(u), float(v), int(k)) for i, ((u, v), k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, `b b` double, y int").repartition(3)


def one_by_one(df, name, found, labels, folds, seed, scaled):
    """Every draw fitted on the rest of every fold by itself."""
    rows = settle(fold_assign(df, seed, "y", folds))
    if scaled:
        rows = Scaler.fit(rows, FEATURES).apply(rows)
    counts = search.member_predictions(rows, lambda i: search.SPACES[name].make(FEATURES, found[i][0]), list(range(len(found))), folds)
    return search.mean_scores(counts, labels, len(found), folds)


@pytest.mark.parametrize("name,trials", [("Decision_Tree", 4), ("KNN", 4)])
def test_shared_searches_score_like_single_fits(spark, name, trials):
    df = made(spark, 90, 3, 1)
    best, ranked = search.search(df, FEATURES, name, trials, seed=3, folds=3)
    want = one_by_one(df, name, ranked, [0, 1, 2], 3, 3, search.SPACES[name].scaled)
    assert [s for _, s in ranked] == pytest.approx(want)
    assert best == max(ranked, key=lambda t: t[1])[0] and len(ranked) == trials


def test_forests_share_their_jobs(spark, monkeypatch):
    monkeypatch.setitem(search.SPACES["Random_Forest"].ranges, "n_estimators", (2, 4, "int"))
    monkeypatch.setattr(search, "TREES_AT_ONCE", 9)
    monkeypatch.setattr(trees, "SENT_NODES", 300)
    df = made(spark, 80, 2, 2)
    _, ranked = search.search(df, FEATURES, "Random_Forest", 3, seed=5, folds=2)
    assert [s for _, s in ranked] == pytest.approx(one_by_one(df, "Random_Forest", ranked, [0, 1], 2, 5, False))


def test_mean_scores(spark):
    rng = np.random.default_rng(4)
    for labels in ([0, 1], ["x", "y", "z"]):
        counts = {(d, f, labels[a], labels[b]): int(n) for d in range(2) for f in range(3) for a in range(len(labels)) for b in range(len(labels)) if (n := rng.integers(0, 5))}
        rows = [(*k, n) for k, n in counts.items()]
        kind = "int" if labels[0] == 0 else "string"
        table = spark.createDataFrame(rows, f"draw int, fold int, y {kind}, pred {kind}, n long")
        found = metrics_from_confusion(table, ["draw", "fold"], average_mode(labels), positive_label(labels)).groupBy("draw").agg(F.avg("f1").alias("m"))
        want = [r["m"] for r in found.orderBy("draw").collect()]
        assert search.mean_scores(rows, labels, 2, 3) == pytest.approx(want)


def test_every_space_makes_members(spark):
    assert set(search.SPACES) == set(learners.POOL_NAMES)
    for name, space in search.SPACES.items():
        for d in learners.draw_params(space.ranges, 25, 7):
            space.make(FEATURES, d)
            for k, rule in space.ranges.items():
                assert d[k] in rule if isinstance(rule, list) else rule[0] <= d[k] <= rule[1]


def test_generic_search_and_stored_trees(spark, tmp_path, monkeypatch):
    df = made(spark, 60, 2, 6)
    monkeypatch.setitem(search.SPACES["XGBoost"].ranges, "n_estimators", (2, 3, "int"))
    best, ranked = search.search(df, FEATURES, "XGBoost", 2, seed=1, folds=2)
    assert len(ranked) == 2 and best in [d for d, _ in ranked]
    registry = Registry(spark, str(tmp_path / "runs"))
    make = search.searched(df, FEATURES, "Decision_Tree", 2, seed=1)
    member, loaded = study.load_or_fit(registry, "e", "Decision_Tree", make, df, df)
    again, found = study.load_or_fit(registry, "e", "Decision_Tree", make, df, df)
    assert not loaded and found and again.how == member.how
    score = lambda m: [r["p"] for r in m.add_probability(df, "p").orderBy("row_id").collect()]
    assert score(again) == score(member)


def test_two_sessions_make_one_run(spark, tmp_path):
    df = made(spark, 60, 2, 8)
    fits, out = [], []

    def make():
        fits.append(1)
        return GaussianNB(FEATURES), {"kind": "nb"}

    def work():
        registry = Registry(spark, str(tmp_path / "runs"))
        out.append(study.load_or_fit(registry, "e", "NB", make, df, df)[1])

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(100)
    assert len(fits) == 1 and sorted(out) == [False, True, True]
    assert Registry(spark, str(tmp_path / "runs")).runs.count() == 1


def test_a_failed_fit_gives_its_claim_back(spark, tmp_path):
    df = made(spark, 30, 2, 9)
    registry = Registry(spark, str(tmp_path / "runs"))

    def broken():
        raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        study.load_or_fit(registry, "e", "NB", broken, df, df)
    assert not study.load_or_fit(registry, "e", "NB", lambda: (GaussianNB(FEATURES), {}), df, df)[1]


SELECTOR_SPACE = {"k": (3, 25, "log_int"), "kp": (3, 25, "log_int"), "trees": (10, 500, "log_int"), "depth": (5, 30, "log_int"), "min_leaf": (1, 30, "int")}


def test_selector_draws_share_the_executors(spark, monkeypatch):
    """Two draws are fitted at the same time; the scores stay in the order of the draws."""
    meet = threading.Barrier(2, timeout=60)

    class Meeting:
        def __init__(self, labels, k, kp, meta=None):
            self.k = k

        def described(self, queries):
            return queries

        def fit(self, refs, described):
            meet.wait()
            return self

        def predict(self, queries, described):
            return queries.select("y", F.when(F.col("row_id") % self.k == 0, F.col("y")).otherwise(1 - F.col("y")).alias("pred"))

    monkeypatch.setattr(study, "CompetenceSelector", Meeting)
    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), F.array(F.lit(0.0)).alias("vec"), F.array(F.array(F.lit(0.5))).alias("probas"))
    best, ranked = study.des_search(SimpleNamespace(labels=[0, 1]), rows, rows, trials=2, seed=1)
    assert [d for d, _ in ranked] == draw_params(SELECTOR_SPACE, 2, 1)
    for d, score in ranked:
        right = [i % d["k"] == 0 for i in range(40)]
        f1 = [2 * sum(r for r, i in zip(right, range(40)) if i % 2 == c) / (20 + sum((i % 2 == c) == r for r, i in zip(right, range(40)))) for c in (0, 1)]
        assert abs(score - sum(f1) / 2) < 1e-9
    assert best in [d for d, _ in ranked]
