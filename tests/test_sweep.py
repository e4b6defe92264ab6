"""The one-pass sweep against a loop, and the properties of rejection."""

import math
import random

import pytest
from pyspark.sql import functions as F

from demur.functions.scores import METHODS
from demur.operators import metrics as me
from demur.operators import reject as rj
from demur.operators import sweep as sw
from demur.sources.config import STUDY_SCHEMA

RATES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def tensor(n=240, models=3, classes=3, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        probas = []
        for _ in range(models):
            raw = [rng.choice([0.2, 0.5, 1.0, rng.random()]) + 0.01 for _ in range(classes)]
            probas.append([x / sum(raw) for x in raw])
        rows.append((i, rng.randrange(classes), probas))
    return rows


@pytest.fixture(scope="module")
def decided(spark):
    df = spark.createDataFrame(tensor(), "row_id bigint, y int, probas array<array<double>>")
    return rj.pool_decision(df, [0, 1, 2]).persist()


def by_hand(pairs):
    labels = sorted({v for p in pairs for v in p})
    ps, rs, fs = [], [], []
    for c in labels:
        tp = sum(y == p == c for y, p in pairs)
        pp, yy = sum(p == c for _, p in pairs), sum(y == c for y, _ in pairs)
        ps.append(tp / pp if pp else 0.0)
        rs.append(tp / yy if yy else 0.0)
        fs.append(2 * tp / (pp + yy) if pp + yy else 0.0)
    n = len(labels)
    return [sum(y == p for y, p in pairs) / len(pairs), sum(ps) / n, sum(rs) / n, sum(fs) / n]


def test_sweep_equals_a_loop(spark, decided):
    curve = {(r["method"], r["rate"]): r for r in sw.sweep_rates(decided, [0, 1, 2], RATES[1:]).collect()}
    rows = decided.select("row_id", "y", "pred_label", "uncertainty").collect()
    fns = {"avg": lambda u: sum(u) / len(u), "median": lambda u: sorted(u)[1], "min": min, "max": max}
    for m in METHODS:
        ranked = sorted(rows, key=lambda r: (-round(fns[m](r["uncertainty"]), 9), r["row_id"]))
        for rate in RATES:
            kept = ranked[math.floor(rate * len(ranked)) :]
            if not kept:
                assert (m, rate) not in curve
                continue
            got = curve[(m, rate)]
            want = by_hand([(r["y"], r["pred_label"]) for r in kept])
            assert [got[c] for c in ("accuracy", "precision", "recall", "f1")] == pytest.approx(want)


def test_rejected_rows_grow_with_the_rate(spark, decided):
    first = sw.first_reject_rate(decided, [0.0, 0.2, 0.4]).groupBy("method", "rate").count().collect()
    counts = {(r["method"], r["rate"]): r["count"] for r in first}
    assert all(counts[(m, 0.2)] == 48 and counts[(m, 0.4)] == 48 and counts[(m, 1.0)] == 144 for m in METHODS)


def test_history_keeps_rate_one_out_of_the_curve(spark, decided):
    curve, history = sw.sweep_history(decided, [0, 1, 2], [0.5])
    assert {r["rate"] for r in curve.collect()} == {0.5}
    assert {r["rate"] for r in history.collect()} == {0.5, 1.0}


def test_rates_are_checked():
    assert sw.complete_rates([0.5]) == [0.0, 0.5]
    for bad in ([-0.1], [1.1]):
        with pytest.raises(ValueError):
            sw.complete_rates(bad)


def test_label_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "y int, pred int")
    got = me.metrics_from_confusion(me.confusion(df)).first()
    assert got["precision"] == pytest.approx((1 + 0.5 + 0) / 3)
    assert got["recall"] == pytest.approx((1 + 1 + 0) / 3)


def test_binary_by_the_whole_y(spark):
    df = spark.createDataFrame([(0, 0), (1, None), (1, 0)], "y int, pred int")
    got = me.metric_auto(df).first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_alert(spark):
    df = spark.range(4).select(F.col("id").alias("row_id"), F.lit(True).alias("rejected"))
    assert rj.reject_alert(df).first()["status"] == "all rejected"
    assert rj.reject_alert(df.withColumn("rejected", F.lit(False))).first()["status"] == "none rejected"


def test_area_of_a_small_curve(spark):
    df = spark.createDataFrame([("m", 0.0, 0.8), ("m", 0.5, 0.9), ("m", 0.9, 1.0)], "method string, rate double, accuracy double")
    assert me.au_arc(df, ["method"]).first()["au_arc"] == pytest.approx(0.805)


def test_area_with_thresholds(spark):
    rows = [("m", r, t, a) for r, t, a in ((0.0, 0.0, 0.7), (0.0, 0.5, 0.9), (0.5, 0.0, 0.9), (0.5, 0.5, 0.9))]
    df = spark.createDataFrame(rows, "method string, rate double, threshold double, accuracy double")
    assert me.au_arc(df, ["method"], threshold="threshold").first()["au_arc"] == pytest.approx(0.425)


def test_auroc_needs_two_labels(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (2, 0.3)], "y int, score double")
    assert me.metric_auroc(df).first()["auroc"] is None
    two = spark.createDataFrame([(0, 0.1), (1, 0.4), (1, 0.1), (0, 0.1)], "y int, score double")
    assert me.metric_auroc(two).first()["auroc"] == pytest.approx(0.75)


def test_sweep_never_shuffles_rows(spark, decided):
    curve = sw.sweep_rates(decided, [0, 1, 2], RATES)
    plan = curve._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_study_document(spark, tmp_path):
    path = tmp_path / "study.json"
    path.write_text('{"seed": 1, "ensemble_sizes": [3, 5], "datasets": [{"path": "a.csv", "target": "t"}]}')
    from demur.sources.config import read_study, study_grid

    rows = study_grid(read_study(spark, str(path))).collect()
    assert [(r["dataset"], r["ensemble_size"]) for r in rows] == [("unnamed", 3), ("unnamed", 5)]
    assert STUDY_SCHEMA["seed"].dataType.typeName() == "long"
