"""Queries of this subpackage and their SQL; the repository's entry module adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demur.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: several passes read it, none computes it anew."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    Scratch.note(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Collects the folders that ``stored`` writes inside its block, to delete them later.

    A result reads them until it is written itself, so the owner calls ``clear`` only after that.
    """

    _open: list[Scratch] = []

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)

    @staticmethod
    def note(path: str) -> None:
        if Scratch._open:
            Scratch._open[-1].paths.append(path)

    def clear(self, spark: SparkSession) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)
