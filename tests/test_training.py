"""Members, search, registry, studies, and published curves."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demur.operators import learners
from demur.operators import metrics as me
from demur.operators import neighbors as nb
from demur.operators.bayes import QDA, GaussianNB
from demur.operators.des import CompetenceSelector, forest
from demur.operators.pool import Pool
from demur.plans import datasets, study
from demur.sources.runs import Registry, experiment_name, load_pool

# Published accuracies by rejection rate 0, 0.05, ... 0.95, and their area.
PUBLISHED = [
    0.8552108194112967, 0.8702023726448012, 0.8874484384207425, 0.9021993448759944, 0.9161418627775937,
    0.9310588651228566, 0.9441287878787878, 0.9547215990210075, 0.9631020768890853, 0.9701132803085081,
    0.9779899230973217, 0.981143193871538, 0.9870732515744116, 0.9916666666666667, 0.9946973044631021,
    0.9968186638388123, 0.9966865473823724, 0.9973498233215548, 0.9986754966887417, 1.0,
]
PUBLISHED_AREA = 0.9094411454274774
# Published accuracies by rate 0, 0.1, ... 0.9 at the thresholds 0, 0.25, 0.5, 0.75, and the area.
BY_THRESHOLD = [
    [0.8159639352956776, 0.8529567753911429, 0.8590559533280298, 0.8590559533280298],
    [0.8451679434295816, 0.8856806128461991, 0.88877430760165, 0.88877430760165],
    [0.8773616175008286, 0.9153132250580046, 0.917467683128936, 0.917467683128936],
    [0.9174242424242425, 0.94375, 0.9448863636363637, 0.9448863636363637],
    [0.9513919575784358, 0.9628811312417145, 0.9628811312417145, 0.9628811312417145],
    [0.9756032882524529, 0.9779899230973217, 0.9779899230973217, 0.9779899230973217],
    [0.9864103413987405, 0.9870732515744116, 0.9870732515744116, 0.9870732515744116],
    [0.9946973044631021] * 4,
    [0.9966865473823724] * 4,
    [0.9986754966887417] * 4,
]
BY_THRESHOLD_AREA = 0.8560148891098388


def test_published_area(spark):
    df = spark.createDataFrame([("avg", i * 0.05, a) for i, a in enumerate(PUBLISHED)], "method string, rate double, accuracy double")
    assert me.au_arc(df, ["method"]).first()["au_arc"] == pytest.approx(PUBLISHED_AREA, abs=1e-9)


def test_published_area_over_thresholds(spark):
    rows = [("avg", i * 0.1, t * 0.25, a) for i, accs in enumerate(BY_THRESHOLD) for t, a in enumerate(accs)]
    df = spark.createDataFrame(rows, "method string, rate double, threshold double, accuracy double")
    assert me.au_arc(df, ["method"], threshold="threshold").first()["au_arc"] == pytest.approx(BY_THRESHOLD_AREA, abs=1e-9)


@pytest.fixture(scope="module")
def points(spark):
    data = datasets.prepare_shape(spark, "varied", 5, 900)
    return data


def accuracy(member, rows):
    scored = member.add_probability(rows, "p")
    bad = scored.where("abs(aggregate(p, 0D, (s, x) -> s + x) - 1) > 1e-6").count()
    assert bad == 0
    labels = F.array(*[F.lit(v) for v in member.labels])
    pred = F.element_at(labels, F.expr("cast(array_position(p, array_max(p)) as int)"))
    return scored.select(F.avg((pred == F.col("y")).cast("double"))).first()[0]


XY = ["x0", "x1"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: learners.fit_tree(XY, 5),
        lambda: learners.fit_logistic(XY, 10.0),
        lambda: learners.fit_sgd(XY, "l1", 1e-4),
        lambda: learners.fit_linear_svm(XY, 1.0, 20),
        lambda: learners.fit_mlp(XY, (8,), 60),
        lambda: learners.fit_forest(XY, 10, 6),
        lambda: learners.fit_boosted(XY, 8),
        lambda: learners.fit_adaboost(XY, 12),
        lambda: nb.KNN(XY, 7, "distance"),
        lambda: GaussianNB(XY),
        lambda: QDA(XY),
    ],
    ids=["tree", "logistic", "sgd", "svm", "mlp", "forest", "boosted", "adaboost", "knn", "nb", "qda"],
)
def test_members_learn_three_clusters(points, make):
    member = make().fit(points.train())
    assert accuracy(member, points.part("G")) > 0.9


def test_pool_fits_only_what_is_missing(points):
    ready = GaussianNB(["x0"]).fit(points.train())
    before = list(ready.prior)
    pool = Pool({"a": ready, "b": GaussianNB(XY)}).fit(points.part("G"))
    assert ready.prior == before and pool["b"].labels == [0, 1, 2] and len(pool) == 2
    assert pool.subset(drop=["a"]).names == ["b"] and pool.first(1).names == ["a"]
    with pytest.raises(ValueError):
        _ = Pool({"a": ready, "c": GaussianNB(XY)}).labels


def test_draws_are_repeatable_and_inside():
    space = learners.SPACES["Random_Forest"]
    one, two = learners.draw_params(space, 20, 3), learners.draw_params(space, 20, 3)
    assert one == two
    assert all(50 <= d["numTrees"] <= 500 and 1 <= d["minInstancesPerNode"] <= 30 and d["impurity"] in ("gini", "entropy") for d in one)


def test_search_finds_the_deeper_tree(points):
    from pyspark.ml.classification import DecisionTreeClassifier

    best, ranked = learners.search_params(
        points.train(), XY, lambda n: DecisionTreeClassifier(seed=1), {"maxDepth": [0, 4]}, trials=4, seed=1, folds=3
    )
    assert {d["maxDepth"] for d, _ in ranked} == {0, 4} and best == {"maxDepth": 4}


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "runs"))
    with pytest.raises(ValueError, match="experiment"):
        registry.lookup("a", "tree")
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 5, 1)
    registry.append("a", "tree", {"depth": 3}, {"test_accuracy": 0.5, "test_auroc": None}, started_at=new)
    registry.append("a", "tree", {"depth": 2}, {"test_accuracy": 0.9}, started_at=old)
    run = registry.lookup("a", "tree")
    assert run["params"] == {"depth": "3"} and run["metrics"] == {"test_accuracy": 0.5}
    with pytest.raises(ValueError, match="run"):
        registry.lookup("a", "forest")
    with pytest.raises(ValueError, match="as many"):
        registry.load_pool(["a", "b"], ["tree"])
    assert list(registry.load_pool("a", ["tree"])) == ["tree"]
    requests = spark.createDataFrame([("a", "tree"), ("a", "svm")], "experiment string, run_name string")
    found, missing = load_pool(registry.runs, requests)
    assert [r["run_name"] for r in found.collect()] == ["tree"] and [r["run_name"] for r in missing.collect()] == ["svm"]
    assert experiment_name("Magic-gamma Set_1", "v6", 7) == "magicgammaset1_v6_7"


def test_train_register_and_load_again(spark, tmp_path):
    data = datasets.prepare_shape(spark, "twomoons", 2, 600)
    registry = Registry(spark, str(tmp_path / "runs"))
    made = []

    def tree():
        made.append(1)
        return learners.fit_tree(XY, 4), {"depth": 4}

    def selector(pool, refs):
        return CompetenceSelector(pool.labels, k=5, kp=3, meta=None).fit(refs)

    members = {"Decision_Tree": tree, "Logistic_Regression": lambda: (learners.fit_logistic(XY), {"C": 1.0})}
    _, chosen = study.train_and_register(registry, "moons_v6_2", data, members, selector)
    pool, _ = study.train_and_register(registry, "moons_v6_2", data, members)
    assert made == [1] and pool.names == list(members) and chosen is not None
    runs = {r["run_name"]: r["metrics"] for r in registry.runs.collect()}
    assert set(runs) == {"Decision_Tree", "Logistic_Regression", "Selector"}
    assert runs["Decision_Tree"]["test_accuracy"] > 0.8 and 0.8 < runs["Decision_Tree"]["test_auroc"] <= 1
    study.registry_migrate(registry, "moons_v6_2", "moons_v7_2", ["Decision_Tree"], data.train(), data.part("G"))
    assert registry.lookup("moons_v7_2", "Decision_Tree")["params"] == {"depth": "4", "labels": "0,1"}


MEMBERS = {
    "tree": lambda: learners.fit_tree(XY, 3),
    "sgd": lambda: learners.fit_sgd(XY, max_iter=5),
    "logistic": lambda: learners.fit_logistic(XY, max_iter=5),
    "knn": lambda: nb.KNN(XY, 3, "distance"),
    "svm": lambda: learners.fit_linear_svm(XY, max_iter=5),
    "mlp": lambda: learners.fit_mlp(XY, (4,), 5),
    "forest": lambda: learners.fit_forest(XY, 3, 3),
    "boosted": lambda: learners.fit_boosted(XY, 2, 2),
    "adaboost": lambda: learners.fit_adaboost(XY, 3),
    "bayes": lambda: GaussianNB(XY),
    "qda": lambda: QDA(XY),
}


def test_every_member_is_stored_and_read_back(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "abc"[i % 3], rng.gauss(i % 3, 1), rng.gauss(-(i % 3), 1)) for i in range(90)]
    df = spark.createDataFrame(rows, ["row_id", "y", *XY])
    pool = Pool({n: make() for n, make in MEMBERS.items()}).fit(df)
    registry = Registry(spark, str(tmp_path / "runs"))
    for n in pool.names:
        registry.append("e", n, {}, {}, pool[n])
    again = Pool(registry.load_members("e", pool.names))
    assert again.labels == ["a", "b", "c"] and again.names == pool.names
    want = {r["row_id"]: r["probas"] for r in pool.predict_proba(df).collect()}
    got = {r["row_id"]: r["probas"] for r in again.predict_proba(df).collect()}
    assert want.keys() == got.keys() and len(got) == 90
    for k in want:
        for a, b in zip(want[k], got[k]):
            assert a == pytest.approx(b, abs=1e-12)


def test_row_without_neighbour_stays(spark):
    one = spark.createDataFrame([(1, 0, 0.5, 0.5)], ["row_id", "y", *XY])
    got = nb.KNN(XY, 1).fit(one).add_probability(one, "p", exclude_self=True).select("row_id", "p").collect()
    assert [tuple(r) for r in got] == [(1, None)]


def test_boosted_member_with_text_labels_is_found_on_the_second_call(spark, tmp_path):
    rows = [(i, "no" if i % 2 else "yes", float(i % 2), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, ["row_id", "y", *XY])
    registry = Registry(spark, str(tmp_path / "runs"))
    turns = [
        study.load_or_fit(registry, "e", "Gradient_Boosting", lambda: (learners.fit_boosted(XY, 2, 2), {}), df, df) for _ in (1, 2)
    ]
    assert [loaded for _, loaded in turns] == [False, True]
    assert turns[1][0].labels == ["no", "yes"]
    assert registry.lookup("e", "Gradient_Boosting")["metrics"]["test_f1_score"] == 1.0


@pytest.mark.parametrize("meta", [None, "naive_bayes", "forest"])
def test_selector_is_stored_and_read_back(spark, tmp_path, meta):
    rng = random.Random(5)
    meta = forest(3, 2) if meta == "forest" else meta
    rows = []
    for i in range(60):
        p, q = rng.random(), rng.random()
        rows.append((i, i % 2, [rng.random(), rng.random()], [[p, 1 - p], [q, 1 - q]]))
    refs = spark.createDataFrame(rows, "row_id bigint, y int, vec array<double>, probas array<array<double>>")
    chosen = CompetenceSelector([0, 1], k=5, kp=3, meta=meta).fit(refs)
    registry = Registry(spark, str(tmp_path / "runs"))
    registry.append("e", "Selector", {}, {}, chosen)
    again = registry.load_member("e", "Selector")
    assert (again.k, again.kp, again.labels) == (5, 3, [0, 1])
    want = {r["row_id"]: r["competences"] for r in chosen.competence(refs).collect()}
    got = {r["row_id"]: r["competences"] for r in again.competence(refs).collect()}
    assert want == got and len(got) == 60


def test_study_counts_its_rows(spark):
    rng = random.Random(0)
    rows = [(i, i % 2, float(i % 2) + rng.random(), rng.choice(["a", "b", None]), None if i % 7 == 0 else rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, y int, x double, c string, z double")

    def library(features):
        return {"naive_bayes": GaussianNB(features), "tree": learners.fit_tree(features, 3), "logreg": learners.fit_logistic(features)}

    out = study.study_run(df, "toy", library, [2, 3, 9]).collect()
    assert len(out) == 3 + 2 * 7
    assert {r["ensemble_size"] for r in out} == {1, 2, 3}
    assert all(r["accuracy"] > 0.9 for r in out)


def test_default_pool_weights(spark):
    data = datasets.prepare_shape(spark, "blobs", 1, 600)
    pool, aside = study.default_pool(data.rows, XY, members=3, seed=1)
    assert len(pool) == 3 and aside.count() == 300
    assert accuracy(pool["bag_0"], data.rows) > 0.9


def test_discriminant_with_dependent_features(spark):
    import numpy as np

    from demur.operators.bayes import QDA

    rng = np.random.default_rng(5)
    a, b, k = rng.normal(size=300), rng.normal(size=300), rng.integers(0, 2, 300)
    a, b = a + k, b * (1 + k)
    rows = [(i, float(u), float(v), float(2 * u - v), 3.0, int(c)) for i, (u, v, c) in enumerate(zip(a, b, k))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y int")
    score = lambda f: [r["p"][1] for r in QDA(f).fit(df).add_probability(df, "p").orderBy("row_id").collect()]
    # dependent and constant features add nothing
    assert np.allclose(score(["a", "b", "c", "d"]), score(["a", "b"]), atol=1e-6)
    density = []
    for c in (0, 1):
        x = np.stack([a, b])[:, k == c]
        cov, z = np.cov(x), np.stack([a, b]) - x.mean(axis=1)[:, None]
        density.append(np.log((k == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("in,ij,jn->n", z, np.linalg.inv(cov), z))
    assert np.allclose(score(["a", "b"]), 1 / (1 + np.exp(density[0] - density[1])))
