"""Delimited text readers and result sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demur.functions.text import missing_to_null
from demur.session import quoted

# Delimiters tried for a file of unknown format.
DELIMITERS = (",", ";", "\t", "|", " ")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Text with a header. A schema saves the inference pass; ``NA`` and empty fields are NULL."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "NA")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def scan_delimited(spark: SparkSession, path: str, sep: str, schema: T.StructType | None = None) -> DataFrame:
    return scan_csv(spark, path, schema, sep)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the first line."""
    first = spark.read.text(path).head(1)
    if not first:
        raise ValueError(f"{path} is empty")
    return max(DELIMITERS, key=first[0][0].count)


def scan_sniffed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return scan_csv(spark, path, schema, sniff_delimiter(spark, path))


def scan_headerless(
    spark: SparkSession, path: str, sep: str = ",", kind: str = "double", names: list[str] | None = None
) -> DataFrame:
    """No header: given names, or ``f0, f1, ...`` with the last column ``y``.

    The first line gives the width; a line with more or fewer fields is an error and loses none silently.
    """
    if names is None:
        first = spark.read.text(path).head(1)
        if not first:
            raise ValueError(f"{path} is empty")
        width = len(first[0][0].strip().split(sep))
        names = [f"f{i}" for i in range(width - 1)] + ["y"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.option("sep", sep).option("mode", "FAILFAST").schema(schema).csv(path)
    return cast_all(rows, kind) if kind != "string" else rows


def scan_header_offset(spark: SparkSession, path: str, names: list[str], skipped: int = 1, sep: str = ",") -> DataFrame:
    """The header stands below ``skipped`` other lines at the top of each file.

    Lines are skipped by their place: a task meets a file's lines in order, and the split that starts at
    byte 0 holds the file's top (header included, so a split must not be shorter than that). Equal lines
    further down are data. A header with other names and a row of another width are errors; empty lines
    are left out.
    """
    lines = spark.read.text(path).select(
        "value",
        F.xxhash64("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") == 0).alias("first"),
    )

    def below_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, 0
        for batch in batches:
            file, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            keep = np.ones(batch.num_rows, bool)
            cuts = np.flatnonzero(np.append(True, file[1:] != file[:-1])) if len(file) else []
            for start, end in zip(cuts, [*cuts[1:], len(file)]):
                if file[start] != current:
                    current, seen = file[start], 0
                if first[start]:
                    top = min(end - start, max(0, skipped + 1 - seen))
                    keep[start : start + top] = False
                    if top and seen + top == skipped + 1:
                        found = next(csv.reader([batch.column(0)[start + top - 1].as_py()], delimiter=sep), [])
                        if [c.strip() for c in found] != [c.strip() for c in names]:
                            raise ValueError(f"a header of {path} has other names: {found}")
                seen += end - start
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["value"])

    schema = ", ".join(f"{quoted(n)} string" for n in names)
    rows = lines.mapInArrow(below_header, "value string").where("trim(value) <> ''")
    return rows.select(F.from_csv("value", F.lit(schema), {"sep": sep, "mode": "FAILFAST"}).alias("r")).select("r.*")


def cast_all(df: DataFrame, kind: str, columns: list[str] | None = None) -> DataFrame:
    """Text -> numbers: tokens for a missing value become NULL, as does text that is no number."""
    columns = columns or df.columns
    return df.withColumns({c: missing_to_null(F.col(f"`{c}`")).try_cast(kind) for c in columns})


def sink_results(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] = ()) -> str:
    """Writes a result table; missing parent folders are made."""
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}")
    return path


def append_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of several results under one set of columns."""
    if not frames:
        raise ValueError("no results to append")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
