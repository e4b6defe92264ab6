"""Dynamic selection on a hand-made neighbourhood and its settings."""

import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from demur.operators import des

NEAR = "near array<struct<rank:int,hits:array<double>,confs:array<double>,ref_y:int,dist:double>>"


def near(spark, *items):
    rows = [(i + 1, list(map(float, hits)), [0.5] * len(hits), y, 0.1 * i) for i, (hits, y) in enumerate(items)]
    return spark.createDataFrame([(rows,)], NEAR)


def test_local_accuracy(spark):
    df = near(spark, ((1, 0), 0), ((1, 1), 1), ((0, 1), 1), ((1, 0), 0))
    assert df.select(des.local_accuracy()).first()[0] == [0.75, 0.5]


@pytest.mark.parametrize(
    "items,want",
    [
        ((((1, 1), 0), ((1, 0), 1)), [True, False]),
        ((((1, 0), 0), ((1, 0), 0)), [True, True]),  # one class: nothing to tell apart
        ((((1, 0), 0), ((0, 1), 1)), [True, True]),  # no model would stay
    ],
)
def test_frienemy_mask(spark, items, want):
    assert near(spark, *items).select(des.frienemy_mask()).first()[0] == want


def test_hardness(spark):
    df = near(spark, ((1,), 0), ((1,), 0), ((1,), 2), ((1,), 1))
    assert df.select(des.hardness("near", 3)).first()[0] == 0.5
    assert df.select(des.hardness("near", 3, safe_k=2)).first()[0] == 0.0
    assert df.select(des.neighbor_majority("near", 3)).first()[0] == 0


def test_consensus_filter(spark):
    rows = [(0, [[0.9, 0.1], [0.8, 0.2]]), (1, [[0.9, 0.1], [0.2, 0.8]])]
    df = spark.createDataFrame(rows, "row_id bigint, probas array<array<double>>")
    assert [r["row_id"] for r in des.consensus_filter(df, 1.0).collect()] == [1]


@pytest.mark.parametrize(
    "bad,error",
    [
        ({"hc": 0.4}, ValueError),
        ({"hc": "1"}, ValueError),
        ({"kp": 0}, ValueError),
        ({"kp": None}, ValueError),
        ({"kp": 2.0}, TypeError),
        ({"k": 0}, ValueError),
        ({"mode": "best"}, ValueError),
        ({"voting": "loud"}, ValueError),
        ({"safe_k": 9}, ValueError),
        ({"meta": object()}, ValueError),
    ],
)
def test_settings_are_checked(spark, bad, error):
    with pytest.raises(error):
        des.CompetenceSelector([0, 1], **bad)


def test_meta_classifier_must_give_probabilities(spark):
    with pytest.raises(ValueError):
        des.CompetenceSelector([0, 1], meta=LinearSVC())


def scored(spark, n=60):
    rows = []
    for i in range(n):
        y = (i // 3) % 2
        right = [0.2, 0.8] if y else [0.8, 0.2]
        wrong = right[::-1]
        # the first model is right for even ids, the second for odd ones
        rows.append((i, y, [float(i % 2), i / n], [right, wrong] if i % 2 == 0 else [wrong, right]))
    return spark.createDataFrame(rows, "row_id bigint, y int, vec array<double>, probas array<array<double>>")


@pytest.mark.parametrize("voting", ["soft", "hard"])
def test_each_side_trusts_its_model(spark, voting):
    df = scored(spark)
    out = des.CompetenceSelector([0, 1], k=5, kp=3, meta=None, voting=voting).fit(df).predict(df)
    assert out.where("pred = y").count() == 60


@pytest.mark.parametrize("mode", ["weighting", "hybrid"])
def test_weighted_modes(spark, mode):
    df = scored(spark)
    out = des.CompetenceSelector([0, 1], k=5, kp=3, meta=None, mode=mode, rate=0.5).fit(df).predict(df)
    assert out.where("pred is null").count() == 30
    assert out.where("pred is not null and pred <> y").count() == 0


def test_meta_classifier_learns_the_sides(spark):
    df = scored(spark)
    selector = des.CompetenceSelector([0, 1], k=5, kp=3, meta=des.forest(10, 4)).fit(df)
    out = selector.set_params(rate=0.1, method="min").predict(df)
    assert out.where("pred is null").count() == 6
    assert out.where("pred = y").count() >= 50


def test_too_few_references(spark):
    with pytest.raises(ValueError):
        des.CompetenceSelector([0, 1], k=7, meta=None).fit(scored(spark, 6))


def test_neighbours_keep_their_order(spark):
    df = scored(spark)
    rows = des.CompetenceSelector([0, 1], k=4, kp=2, meta=None).fit(df).near(df)
    ranks = rows.select(F.transform("near", lambda n: n["rank"]).alias("r")).distinct().collect()
    assert [r["r"] for r in ranks] == [[1, 2, 3, 4]]


def test_equal_class_neighbourhoods(spark):
    df = scored(spark)
    selector = des.CompetenceSelector([0, 1], k=6, kp=2, meta=None, equal_class=True).fit(df)
    rows = selector.near(df).select(F.expr("size(filter(near, n -> n.ref_y = 0))").alias("a"), F.size("near").alias("n"))
    assert [(r["a"], r["n"]) for r in rows.distinct().collect()] == [(3, 6)]


def test_setting_errors_are_those_of_the_selector(spark):
    from demur.operators.des import CompetenceSelector, setting_errors

    cases = [(hc, kp, k) for hc in (None, float("nan"), 0.4, 0.5, 1.0) for kp in (None, 0, 1, 5) for k in (0, 1, 7)]
    found = setting_errors(spark.createDataFrame(cases, "hc double, kp int, k int")).collect()
    for r in found:
        try:
            CompetenceSelector([0, 1], k=r["k"], kp=r["kp"], hc=r["hc"])
            assert r["error"] is None, r
        except (ValueError, TypeError) as e:
            assert r["error"] is not None and str(e).startswith(r["error"]), (r, e)


@pytest.mark.parametrize("meta", [None, "naive_bayes"])
def test_neighbours_of_a_wider_selector_serve_a_narrower_one(spark, meta):
    df = scored(spark, 60)
    wide = des.CompetenceSelector([0, 1], k=9, kp=8, meta=None).fit(df).described(df)
    found = []
    for described in (None, wide):
        selector = des.CompetenceSelector([0, 1], k=5, kp=3, meta=meta).fit(df, described)
        rows = selector.competence(df, described).select("row_id", "near", "competences").orderBy("row_id").collect()
        pred = selector.predict(df, described).select("row_id", "pred").orderBy("row_id").collect()
        found.append((rows, pred))
    assert [(r["row_id"], [n["rank"] for n in r["near"]]) for r in found[0][0]] == [(r["row_id"], [n["rank"] for n in r["near"]]) for r in found[1][0]]
    for a, b in zip(found[0][0], found[1][0]):
        assert a["near"] == b["near"] and a["competences"] == pytest.approx(b["competences"], abs=1e-12)
    assert found[0][1] == found[1][1]
