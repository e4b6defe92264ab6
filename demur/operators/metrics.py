"""Metrics from counts by (true, predicted): one map-side combined aggregate, then tiny tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from demur.session import cut_lineage, small_table

# Distinct labels a classifier may have; the driver holds one entry for each.
MAX_LABELS = 10_000


def label_set(df: DataFrame, y: str = "y") -> list:
    """Distinct labels in order; their number is checked."""
    rows = df.select(y).where(F.col(y).isNotNull()).distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"{y} has more than {MAX_LABELS} distinct labels")
    return sorted(r[0] for r in rows)


def confusion(df: DataFrame, by: list[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts of accepted rows (pred not null) by (keys, y, pred)."""
    return (
        df.where(F.col(pred).isNotNull())
        .groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def metrics_from_confusion(
    counts: DataFrame, by: list[str] = (), average: str = "macro", positive: object = 1
) -> DataFrame:
    """Accuracy, precision, recall and F1 of each key; undefined ratios are 0.

    ``macro`` averages over the labels seen in y or pred of the key; ``binary`` takes ``positive`` only.
    """
    hit = F.col("y") == F.col("pred")
    sides = F.when(
        hit, F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))
    ).otherwise(
        F.array(
            F.struct(F.col("y").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.col("n").alias("fn")),
            F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("bigint").alias("fn")),
        )
    )
    per_label = (
        counts.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.c").alias("c"))
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))
        .withColumn("p", F.expr("if(tp + fp = 0, 0D, tp / (tp + fp))"))
        .withColumn("r", F.expr("if(tp + fn = 0, 0D, tp / (tp + fn))"))
        .withColumn("f", F.expr("if(2 * tp + fp + fn = 0, 0D, 2 * tp / (2 * tp + fp + fn))"))
    )
    if average == "binary":
        def pick(c):
            return F.coalesce(F.max(F.when(F.col("c") == positive, F.col(c))), F.lit(0.0))
    else:
        def pick(c):
            return F.avg(c)
    # every accepted row is in one (c = y) record as tp or fn
    return per_label.groupBy(*by).agg(
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"),
        pick("p").alias("precision"),
        pick("r").alias("recall"),
        pick("f").alias("f1"),
    )


def average_mode(labels: list) -> str:
    """Binary metrics for at most two labels in the whole y, else macro."""
    return "binary" if len(labels) <= 2 else "macro"


def positive_label(labels: list):
    """The higher of two labels; else 1."""
    return labels[1] if len(labels) == 2 else 1


def metric_auto(df: DataFrame, by: list[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Metrics with the average chosen from the whole y, rejected rows included."""
    labels = label_set(df, y)
    return metrics_from_confusion(confusion(df, by, y, pred), by, average_mode(labels), positive_label(labels))


def metric_auroc(df: DataFrame, y: str = "y", score: str = "score", positive: int = 1) -> DataFrame:
    """Area under the ROC curve of a binary label; NULL unless both labels occur and are two.

    Mann-Whitney with ties counted half, over the rows that have a score and a label; NaN is the highest
    score. Rows shrink to distinct scores first. Those are dealt to sampled ranges of about equal size,
    however they are spread; the running count of negatives is local to a range plus the total of those below.
    """
    spark = df.sparkSession
    df = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    labels = label_set(df, y)
    if len(labels) != 2 or positive not in labels:
        return small_table(spark, {"auroc": [None]}, pa.schema([("auroc", pa.float64())]))
    by_score = (
        df.select((F.col(y) == positive).cast("int").alias("pos"), (F.col(score) + 0.0).alias("s"))
        .groupBy("s")
        .agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("q"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed, so that ranges and totals belong to one layout
    ranged = cut_lineage(by_score.repartitionByRange(parts, "s").withColumn("b", F.spark_partition_id()))
    totals = sorted((r["b"], r["q"]) for r in ranged.groupBy("b").agg(F.sum("q").alias("q")).collect())
    starts, seen = [], 0
    for _, q in totals:
        starts.append(seen)
        seen += q
    offsets = small_table(
        spark,
        {"b": [b for b, _ in totals], "start": starts},
        pa.schema([("b", pa.int32()), ("start", pa.int64())]),
    )
    inside = W.partitionBy("b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("lower", F.coalesce(F.sum("q").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "b")
        .select("p", "q", (F.col("p") * (F.col("start") + F.col("lower") + F.col("q") / 2.0)).alias("u"))
        .agg((F.sum("u") / (F.sum("p").cast("double") * F.sum("q"))).alias("auroc"))
    )


def au_arc(
    curve: DataFrame,
    by: list[str],
    rate: str = "rate",
    accuracy: str = "accuracy",
    threshold: str | None = None,
) -> DataFrame:
    """Area under accuracy by rejection rate: trapezoids over the observed rates.

    With a threshold column the accuracy is first averaged over the thresholds of each rate.
    """
    points = curve
    if threshold:
        points = curve.groupBy(*by, rate).agg(F.avg(accuracy).alias(accuracy))
    w = W.partitionBy(*by).orderBy(rate)
    steps = points.withColumn("_r", F.lag(rate).over(w)).withColumn("_a", F.lag(accuracy).over(w))
    area = (F.col(rate) - F.col("_r")) * (F.col(accuracy) + F.col("_a")) / 2
    return steps.groupBy(*by).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("au_arc"))


def study_summary(results: DataFrame, margins: bool = False) -> DataFrame:
    """Mean and sample deviation of accuracy and macro F1 by (method, ensemble_size), best first.

    ``margins`` adds the totals over methods and sizes (cube).
    """
    keys = ["method", "ensemble_size"]
    grouped = results.cube(*keys) if margins else results.groupBy(*keys)
    return grouped.agg(
        F.avg("accuracy").alias("accuracy_mean"),
        F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("accuracy_std"),
        F.avg("f1_macro").alias("f1_macro_mean"),
        F.coalesce(F.stddev_samp("f1_macro"), F.lit(0.0)).alias("f1_macro_std"),
        F.count("accuracy").alias("n_runs"),
    ).orderBy(F.desc("accuracy_mean"), F.desc("f1_macro_mean"), *keys)


def top_result(summary: DataFrame) -> DataFrame:
    """The best row of a summary; its order has a limit, so only one row per task is kept."""
    return summary.orderBy(
        F.desc("accuracy_mean"), F.desc("f1_macro_mean"), "method", "ensemble_size"
    ).limit(1)

