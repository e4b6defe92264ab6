"""Classification views over the given tables: ``row_id``, ``y`` and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demur.operators.bayes import GaussianNB
from demur.operators.metrics import label_set
from demur.operators.pool import Pool
from demur.operators.prep import Scaler, impute_median
from demur.operators.split import split_four_way
from demur.session import settle

SEED = 42
ORDER_FEATURES = ["o_totalprice", "n_lines", "sum_qty", "avg_discount", "avg_tax", "max_price"]
EVENT_FEATURES = ["value", "hour", "k", "user_mod"]
VECTOR_BLOCKS = 8
VECTOR_BLOCK_SIZE = 8
VECTOR_FEATURES = [f"e{i}" for i in range(VECTOR_BLOCKS * VECTOR_BLOCK_SIZE)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes; orders without lines have nulls."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("sum_qty"),
            F.avg("l_discount").alias("avg_discount"),
            F.avg("l_tax").alias("avg_tax"),
            F.max("l_extendedprice").alias("max_price"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.expr("array_position(array('F', 'O', 'P'), o_orderstatus) - 1").cast("int").alias("y"),
        "o_totalprice",
    )
    return orders.join(lines, F.col("row_id") == F.col("l_orderkey"), "left").drop("l_orderkey")


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five classes by sorted event type."""
    events = table(spark, sf_dir, "events")
    types = label_set(events, "event_type")
    code = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("event_type")) - 1
    return events.select(
        F.col("event_id").alias("row_id"),
        code.cast("int").alias("y"),
        "value",
        F.hour("ts").cast("double").alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("user_id") % 10).cast("double").alias("user_mod"),
    )


def vectors_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten classes, 64 numbers; ``vec`` keeps them as one array."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"), vec.alias("vec"))
        .select("row_id", "y", "vec", *[F.col("vec")[i].alias(f) for i, f in enumerate(VECTOR_FEATURES)])
    )


def docs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes with categorical columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return (
        table(spark, sf_dir, "labels")
        .select("doc_id", F.col("quality").alias("y"))
        .join(docs, "doc_id")
        .withColumnRenamed("doc_id", "row_id")
    )


def sentinel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``?`` in place of one language."""
    return docs_view(spark, sf_dir).withColumn(
        "lang", F.when(F.col("lang") == "de", F.lit(" ? ")).otherwise(F.col("lang"))
    )


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing-like text built from the parts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(
        F.array(
            *[
                F.lit(v)
                for v in (
                    "Entire rental unit",
                    "Private room in home",
                    "Shared room in condo",
                    "Room in hotel",
                    "Casa particular",
                    "Private room",
                    "Entire loft",
                    "Entire serviced apartment",
                )
            ]
        ),
        (key % 8 + 1).cast("int"),
    )
    baths = F.element_at(
        F.array(
            F.concat(size.cast("string"), F.lit(" baths")),
            F.concat(size.cast("string"), F.lit(".5 shared baths")),
            F.lit("Half-bath"),
            F.lit("Shared half-bath"),
            F.lit("1 bath"),
            F.lit("1 private bath"),
        ),
        (key % 6 + 1).cast("int"),
    )
    return table(spark, sf_dir, "part").select(
        key.alias("row_id"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("price"),
        F.concat(size.cast("string"), F.lit("%")).alias("rate"),
        baths.alias("bathrooms_text"),
        kind.alias("property_type"),
    )


def split_prepared(df: DataFrame, features: list[str], seed: int = SEED) -> DataFrame:
    """Four-way split, then median and scale fitted on T and applied to all parts."""
    parts = split_four_way(df, seed)
    train = parts.where("split = 'T'")
    medians = impute_median(train, features)
    scaler = Scaler.fit(medians.apply(train), features)
    return scaler.apply(medians.apply(parts))


def orders_pool() -> Pool:
    return Pool({f"nb_{i}": GaussianNB(ORDER_FEATURES[2 * i : 2 * i + 2]) for i in range(3)})


def events_pool() -> Pool:
    return Pool({f"nb_{f}": GaussianNB([f]) for f in EVENT_FEATURES})


def vectors_pool() -> Pool:
    n = VECTOR_BLOCK_SIZE
    return Pool({f"nb_{b}": GaussianNB(VECTOR_FEATURES[b * n : b * n + n]) for b in range(VECTOR_BLOCKS)})


def scored_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Pool]:
    """All orders scored by three members fitted on T."""
    # the join is paid once: medians, scale, members and scores all read the written view
    rows = split_prepared(settle(orders_view(spark, sf_dir), "orders-view"), ORDER_FEATURES)
    pool = orders_pool().fit(rows.where("split = 'T'"))
    return pool.predict_proba(rows).select("row_id", "y", "split", "probas"), pool


def scored_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Pool]:
    rows = split_four_way(settle(events_view(spark, sf_dir), "events-view"), SEED)
    pool = events_pool().fit(rows.where("split = 'T'"))
    return pool.predict_proba(rows).select("row_id", "y", "split", "probas"), pool


def scored_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Pool]:
    rows = split_four_way(settle(vectors_view(spark, sf_dir), "vectors-view"), SEED)
    pool = vectors_pool().fit(rows.where("split = 'T'"))
    return pool.predict_proba(rows).select("row_id", "y", "split", "vec", "probas"), pool
