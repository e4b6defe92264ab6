"""Boosting over stumps: the cuts of MLlib's stumps, one pass by round, several tasks, samples."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler

from demur.operators import learners, stumps
from demur.sources.members import load_member, save_member

FEATURES = ["a", "b"]


def frame(spark, n, seed=3):
    """Three classes that overlap, one feature of few values and copies of rows."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    a, b = rng.normal(y % 2, 1.5), np.round(rng.normal(y, 2))
    rows = [(i, float(a[i // 2]), float(b[i // 2]), int(y[i // 2])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, y int")


def by_mllib(df, rounds):
    """The same rounds with MLlib's stumps and weights in numpy."""
    spark, out = df.sparkSession, []
    data = df.orderBy("row_id").collect()
    w = np.ones(len(data))
    for _ in range(rounds):
        rows = spark.createDataFrame([(r["a"], r["b"], float(r["y"]), float(v)) for r, v in zip(data, w)], "a double, b double, label double, w double")
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        stump = learners.stump_of(DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=42).fit(rows))
        missed = np.array([(stump.left if r[FEATURES[stump.feature]] <= stump.cut else stump.right) != r["y"] for r in data])
        err = w[missed].sum() / w.sum()
        alpha = math.log((1 - err) / err) + math.log(2)
        out.append((alpha, stump))
        w = np.where(missed, w * math.exp(alpha), w)
        w /= w.mean()
    return out


def test_rounds_equal_those_with_mllib_stumps(spark, monkeypatch, tmp_path):
    df = frame(spark, 300)
    want = by_mllib(df, 3)
    monkeypatch.setattr(stumps, "TASK_ROWS", 100)
    member = learners.AdaBoost(FEATURES, 3, cut_every=2).fit(df)
    assert [s[0] for _, s in member.stumps] == [s[0] for _, s in want]
    for (alpha, stump), (a, s) in zip(member.stumps, want):
        assert alpha == pytest.approx(a) and stump.cut == pytest.approx(s.cut) and stump[2:] == s[2:]
    save_member(spark, member, str(tmp_path / "m"))
    again = load_member(spark, str(tmp_path / "m"))
    assert again.stumps == member.stumps and again.add_probability(df, "p").count() == 300


def test_a_round_is_one_job(spark):
    """With MLlib's stumps a round took several passes over all rows."""
    df, counts = frame(spark, 200), []
    for rounds in (2, 4):
        spark.sparkContext.setJobGroup(f"boost-{rounds}", "")
        try:
            assert len(learners.fit_adaboost(FEATURES, rounds).fit(df).stumps) == rounds
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost-{rounds}")))
    assert counts[1] - counts[0] <= 2


def test_sample_of_a_larger_table_gives_close_cuts(spark, monkeypatch):
    df = frame(spark, 3000)
    whole = learners.AdaBoost(FEATURES, 1).fit(df).stumps[0]
    monkeypatch.setattr(stumps, "SAMPLE", 1000)
    some = learners.AdaBoost(FEATURES, 1).fit(df).stumps[0]
    assert abs(some[0] - whole[0]) < 0.1 and some[1].feature == whole[1].feature


def test_odd_rows(spark):
    df = frame(spark, 20)
    one = spark.createDataFrame([(i, 1.0, 2.0, i % 2) for i in range(6)], df.schema)
    with pytest.raises(ValueError, match="chance"):
        learners.fit_adaboost(FEATURES, 2).fit(one)
    apart = spark.createDataFrame([(i, float(i), 0.0, i // 3) for i in range(6)], df.schema)
    assert learners.fit_adaboost(FEATURES, 5).fit(apart).stumps == [(1.0, stumps.Stump(0, 2.5, 0, 1))]
    for bad in ((100, None, 1.0, 1), (101, float("nan"), 1.0, 0), (102, 1.0, 1.0, None)):
        with pytest.raises(Exception, match="null|NaN|handleInvalid"):
            learners.fit_adaboost(FEATURES, 2).fit(df.unionByName(spark.createDataFrame([bad], df.schema)))
