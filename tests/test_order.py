"""Order statistics, cuts and ranks against plain sorting, on tied and skewed data too."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demur.operators import order
from demur.operators import prep
from demur.operators.metrics import metric_auroc
from demur.operators.reject import reject_predict, reject_top_rate
from demur.session import small_table


def table(spark, values, kind="bigint"):
    return spark.createDataFrame([("a", v) for v in values], f"g string, v {kind}")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-(2**60), 2**60), min_size=1, max_size=60), data=st.data())
def test_order_statistics_of_integers(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    found = order.order_statistics(table(spark, values), {"a": [k]})[("a", k)]
    want = sorted(values)[k - 1]
    assert found == (want, sum(v < want for v in values), values.count(want))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e300, 1e300), min_size=1, max_size=60), data=st.data())
def test_order_statistics_of_doubles(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    found = order.order_statistics(table(spark, values, "double"), {"a": [k]})[("a", k)]
    assert found.value == sorted(values)[k - 1]


def test_narrowing_without_the_direct_step(spark, monkeypatch):
    monkeypatch.setattr(order, "DIRECT_ROWS", 0)
    monkeypatch.setattr(order, "CELLS_PER_PASS", 16)
    rng = random.Random(3)
    values = [0] * 300 + [rng.randrange(10**15) for _ in range(600)]
    ks = [1, 299, 300, 301, 450, 900]
    found = order.order_statistics(table(spark, values), {"a": ks})
    assert [found[("a", k)].value for k in ks] == [sorted(values)[k - 1] for k in ks]


def test_many_values_of_any_spread(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(order, "small_table", lambda *a: passes.append(1) or small_table(*a))
    n = 240_000
    ids = spark.range(n).select(F.lit("a").alias("g"), F.xxhash64("id").alias("v"))
    assert n > order.DIRECT_ROWS
    wanted = sorted(r["v"] for r in ids.collect())
    found = order.order_statistics(ids, {"a": [1, 1000, n // 2, n]})
    assert [found["a", k].value for k in (1, 1000, n // 2, n)] == [wanted[k - 1] for k in (1, 1000, n // 2, n)]
    assert len(passes) <= 5
    passes.clear()
    # exponents from the smallest to the largest, both signs, zeros and infinities
    spread = "case when id % 50 = 0 then 0D when id % 9999 = 1 then double('inf') when id % 9998 = 1 then double('-inf') else if(id % 2 = 0, 1, -1) * exp(id / 240000D * 1400 - 700) end"
    rows = spark.range(n).select(F.lit("a").alias("g"), F.expr(spread).alias("v"))
    wanted = sorted(r["v"] for r in rows.collect())
    ks = [1, 30, n // 3, n // 2, n // 2 + 10_000, n - 5, n]
    found = order.order_statistics(rows, {"a": ks})
    assert [found["a", k].value for k in ks] == [wanted[k - 1] for k in ks]
    assert len(passes) <= 5


def test_long_ends_and_nan(spark, monkeypatch):
    monkeypatch.setattr(order, "DIRECT_ROWS", 0)
    low, high = -(2**63), 2**63 - 1
    values = [low, low, low + 1, -1, 0, 5, high - 2, high - 1, high]
    found = order.order_statistics(table(spark, values), {"a": list(range(1, 10))})
    assert [found["a", k].value for k in range(1, 10)] == values
    doubles = [-1.0, -0.0, 0.0, 5e-324, 1e308, float("inf"), float("nan"), float("nan")]
    found = order.order_statistics(table(spark, doubles, "double"), {"a": [1, 2, 4, 5, 6, 8]})
    assert [found["a", k].value for k in (1, 2, 4, 5, 6)] == [-1.0, 0.0, 5e-324, 1e308, float("inf")]
    assert found["a", 8].value != found["a", 8].value and found["a", 8].below == 6


def test_rejection_among_many_ties(spark):
    n = 240_000
    df = spark.range(n).select(F.xxhash64("id").alias("row_id"), F.lit(0.5).alias("s"))
    out = reject_top_rate(df, F.col("s"), 0.25)
    got = sorted(r["row_id"] for r in out.where("rejected").collect())
    assert got == sorted(r["row_id"] for r in df.collect())[: n // 4]


@pytest.mark.parametrize("rate,n,k", [(0, 8, 0), (1, 8, 8), (0.25, 8, 2), (0.29, 100, 28), (0.5, 9, 4)])
def test_reject_counts(spark, rate, n, k):
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") / 100).alias("s"))
    rejected = reject_top_rate(df, F.col("s"), rate).where("rejected")
    assert sorted(r["row_id"] for r in rejected.collect()) == list(range(n - k, n))


def test_percent_rates(spark):
    df = spark.createDataFrame([(i, 0, [[0.5 + i / 20, 0.5 - i / 20]]) for i in range(8)], "row_id bigint, y int, probas array<array<double>>")
    out = reject_predict(df, [0, 1], 25)
    assert sorted(r["row_id"] for r in out.where("rejected").collect()) == [0, 1]
    with pytest.raises(ValueError):
        reject_predict(df, [0, 1], 25, "best")


def test_ties_reject_the_smaller_ids(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 900, 0.4).otherwise(0.1).alias("s"))
    for rate in (0.1, 0.333, 0.9, 0.95):
        k = int(rate * 1000)
        got = sorted(r["row_id"] for r in reject_top_rate(df, F.col("s"), rate).where("rejected").collect())
        assert got == list(range(k))


def test_exact_rank_with_hot_groups(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else rng.choice(["x", "y"]), rng.choice([1, 1, 1, rng.randrange(50)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id bigint, g string, v bigint").repartition(8)
    got = {r["row_id"]: r["rank"] for r in order.exact_rank(df, ["v", "row_id"], group="g").collect()}
    want = {}
    for g in ("hot", "x", "y"):
        for place, (i, _, _) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            want[i] = place
    assert got == want


def test_rank_shuffles_by_range_only(spark):
    df = spark.range(50_000).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("v"))
    plan = order.exact_rank(df, ["v", "row_id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("Physical Plan")[1]


def test_exact_medians(spark):
    rng = random.Random(1)
    xs = [rng.choice([None, rng.random(), 0.5]) for _ in range(401)]
    ys = [float(i) for i in range(401)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    kept = sorted(x for x in xs if x is not None)
    n = len(kept)
    want = (kept[(n - 1) // 2] + kept[n // 2]) / 2
    assert prep.exact_medians(df, ["x", "y"]) == {"x": want, "y": 200.0}


def plain_auroc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


def test_auroc_of_skewed_null_and_nan_scores(spark):
    rng = random.Random(8)
    auroc = lambda rows: metric_auroc(spark.createDataFrame(rows, "y int, score double")).first()[0]
    rows = [(rng.randrange(2), rng.choice([rng.random(), 0.25, rng.random() ** 9])) for _ in range(500)]
    assert auroc(rows) == pytest.approx(plain_auroc(rows))
    far = [*rows, (1, 1e9), (0, -1e300)]
    assert auroc(far) == pytest.approx(plain_auroc(far))
    assert auroc([(1, 0.9), (0, 0.1), (1, None), (0, None), (1, None), (None, 0.5)]) == 1.0
    assert auroc([(1, None), (0, None)]) is None and auroc([(1, 0.5), (1, 0.6)]) is None
    assert auroc([(1, float("nan")), (0, 0.7), (0, float("inf"))]) == 1.0


def test_auroc_ranges_are_even_with_an_outlier(spark, monkeypatch):
    from demur.operators import metrics

    seen = []
    monkeypatch.setattr(metrics, "cut_lineage", lambda df: seen.append(df) or df)
    rows = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") == 7, 1e9).otherwise(F.rand(3)).alias("score"))
    assert 0.45 < metric_auroc(rows).first()[0] < 0.55
    sizes = [r["count"] for r in seen[0].groupBy("b").count().collect()]
    assert max(sizes) < 2 * 20_000 / len(sizes) and len(sizes) > 1
