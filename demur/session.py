"""Session helpers: the shared folder, lineage cuts and small driver-made tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Upper bound for anything the driver builds itself and broadcasts (rows).
SMALL_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="demur-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table that several passes read to the shared folder and reads it back.

    Unlike a cache it stays columnar and prunable, and no pass recomputes it when an executor is lost.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # a table out of few files would stay in few tasks, however many passes follow
    if 0 < len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, columns: dict, schema: pa.Schema) -> DataFrame:
    """A driver-made table of checked size, planned as a local relation."""
    n = len(next(iter(columns.values()))) if columns else 0
    if n > SMALL_ROWS:
        raise ValueError(f"{n} rows are too many for a driver-made table")
    return spark.createDataFrame(pa.table(columns, schema=schema))


def quoted(name: str) -> str:
    """Column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def str_lit(value: str) -> str:
    """String as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def num_lit(value: float) -> str:
    """Double as an SQL literal that keeps every bit."""
    return f"double('{value!r}')" if value < 0 else f"{value!r}D"
