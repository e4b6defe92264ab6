"""Hand-made score tensors."""

import pytest
from pyspark.sql import functions as F

from demur.functions import fusion as fu
from demur.functions.scores import model_uncertainty, normalise_rate, row_score, select_competent, select_models

PLAIN = [[0.7, 0.3], [0.6, 0.4], [0.2, 0.8]]


def one(spark, probas, **columns):
    return spark.createDataFrame([(probas,)], "probas array<array<double>>").withColumns(
        {k: F.lit(v) for k, v in columns.items()}
    )


def decided(spark, probas):
    df = one(spark, probas).withColumn("preds", fu.model_labels())
    n = len(probas[0])
    return df.select(*[fu.decide(fu.fuse(r, n)).alias(r) for r in fu.RULES]).first().asDict()


def test_plain_tensor(spark):
    assert decided(spark, PLAIN) == {
        "majority_voting": 0,
        "sum_rule": 0,
        "product_rule": 1,
        "max_rule": 1,
        "min_rule": 1,
        "median_rule": 0,
        "borda_count": 0,
    }


def test_one_model_decides_alone(spark):
    assert set(decided(spark, [[0.2, 0.5, 0.3]]).values()) == {1}


def test_borda_ties_go_by_class_index(spark):
    df = one(spark, [[0.5, 0.25, 0.25], [0.25, 0.5, 0.25]])
    assert df.select(fu.fuse_borda()).first()[0] == [2.0, 2.0, 2.0]
    assert df.select(fu.decide(fu.fuse_borda())).first()[0] == 0


def test_vote_tie_goes_to_the_smallest_label(spark):
    df = spark.createDataFrame([([2, 0, 2, 0],)], "preds array<int>")
    assert df.select(fu.decide(fu.fuse_majority("preds", 3))).first()[0] == 0


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [1, 2, 0]])
def test_model_order_does_not_matter(spark, order):
    assert decided(spark, [PLAIN[i] for i in order]) == decided(spark, PLAIN)


def test_equal_models_are_all_selected(spark):
    df = one(spark, [[0.9, 0.1]] * 3).withColumn("uncertainty", model_uncertainty())
    row = df.select(select_models().alias("s"), *[row_score("uncertainty", m).alias(m) for m in ("avg", "median", "min", "max")]).first()
    assert row["s"] == [True] * 3
    assert all(abs(row[m] - 0.1) < 1e-12 for m in ("avg", "median", "min", "max"))


def test_selection_by_the_mean(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.6],)], "uncertainty array<double>")
    assert df.select(select_models()).first()[0] == [True, True, False]
    df = spark.createDataFrame([([0.1, 0.1, 0.1],)], "competences array<double>")
    assert df.select(select_competent()).first()[0] == [True] * 3


def test_masked_mean_and_shares(spark):
    df = one(spark, PLAIN).withColumn("selected", F.array(F.lit(True), F.lit(False), F.lit(True)))
    df = df.withColumn("preds", fu.model_labels()).withColumn("w", F.array(F.lit(1.0), F.lit(5.0), F.lit(3.0)))
    row = df.select(
        fu.fuse_masked_mean("probas", "selected").alias("mean"),
        fu.fuse_hard_share("preds", 2, "selected").alias("share"),
        fu.fuse_weighted("probas", "w").alias("all"),
        fu.fuse_weighted("probas", "w", "selected").alias("some"),
        fu.fuse_weighted_votes("preds", "w", 2).alias("votes"),
    ).first()
    assert row["mean"] == pytest.approx([0.45, 0.55])
    assert row["share"] == [0.5, 0.5]
    assert row["all"] == pytest.approx([4.3 / 9, 4.7 / 9])
    assert row["some"] == pytest.approx([1.3 / 4, 2.7 / 4])
    assert row["votes"] == pytest.approx([6 / 9, 3 / 9])


def test_names_are_checked():
    with pytest.raises(ValueError):
        fu.fuse("mode_rule", 2)
    with pytest.raises(ValueError):
        row_score("uncertainty", "best")
    row_score("competences", "best", strict=False)
    assert normalise_rate(25) == 0.25 and normalise_rate(0.25) == 0.25
