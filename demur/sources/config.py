"""Study settings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STUDY_SCHEMA = T.StructType(
    [
        T.StructField("seed", T.LongType()),
        T.StructField("test_size", T.DoubleType()),
        T.StructField("results_path", T.StringType()),
        T.StructField("reject_rates", T.ArrayType(T.DoubleType())),
        T.StructField("ensemble_sizes", T.ArrayType(T.IntegerType())),
        T.StructField(
            "datasets",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("path", T.StringType()),
                        T.StructField("target", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """One row by study document."""
    return spark.read.schema(STUDY_SCHEMA).json(path, multiLine=True)


def study_grid(study: DataFrame) -> DataFrame:
    """One row by (dataset, ensemble size) with the settings of the study."""
    return (
        study.withColumn("d", F.explode("datasets"))
        .withColumn("ensemble_size", F.explode("ensemble_sizes"))
        .select(
            F.coalesce("d.name", F.lit("unnamed")).alias("dataset"),
            "d.path",
            "d.target",
            "ensemble_size",
            "seed",
            "test_size",
            "reject_rates",
            "results_path",
        )
    )
