"""Rows of numbers as blocks of bytes, for fits that pass over them many times.

A pass over such a table hands whole blocks to Python; no row is converted again. A large table has as many files
of equal size as there are cores, so that a pass is one even wave of tasks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from demur.session import scratch_path

# Rows that a reader gets at a time, and bytes of features that a block may hold: a batch of 10,000 blocks stays below 40 MB.
CHUNK_ROWS, BLOCK_BYTES = 10_000, 4_000

BLOCKS = "x binary, yi binary, extra binary"

# tasks get the kernels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _columns(batch: pa.RecordBatch, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, class indices and the third column of a batch of rows."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(dtype)


def _bytes(column: pa.Array, dtype: str) -> np.ndarray:
    """All values of a column of blocks, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0]) // np.dtype(dtype).itemsize
    return np.frombuffer(column.buffers()[2] or b"", dtype, size, int(offsets[0]))


def to_blocks(x: np.ndarray, y: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
    """Blocks of a few rows each; their number of rows divides that of a chunk."""
    room = max(1, BLOCK_BYTES // (8 * x.shape[1])) if x.shape[1] else 1
    step = next(n for n in (100, 50, 20, 10, 5, 2, 1) if n <= room)
    parts = [
        pa.array([a[i : i + step].tobytes() for i in range(0, len(x), step)], pa.binary())
        for a in (x.astype(np.float64, copy=False), y.astype(np.int32, copy=False), extra)
    ]
    return pa.RecordBatch.from_arrays(parts, names=["x", "yi", "extra"])


def chunks(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, class indices and the third column by chunk, out of blocks or of plain rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if not pa.types.is_binary(batch.schema.field(0).type):
            yield _columns(batch, dtype)
            continue
        y, extra = _bytes(batch.column(1), "int32"), _bytes(batch.column(2), dtype)
        x = _bytes(batch.column(0), "float64").reshape(len(y), -1)
        for i in range(0, len(y), CHUNK_ROWS):
            yield x[i : i + CHUNK_ROWS], y[i : i + CHUNK_ROWS], extra[i : i + CHUNK_ROWS]


def written(blocks: DataFrame, name: str) -> DataFrame:
    path = scratch_path(blocks.sparkSession, name)
    blocks.write.parquet(path)
    return blocks.sparkSession.read.schema(BLOCKS).parquet(path)


def packed(rows: DataFrame, dtype: str, n: int, task_rows: int, name: str) -> DataFrame:
    """Blocks of ``x array<double>, yi int`` and a third column of the type; one file keeps the order of one partition."""
    tasks, cores = max(1, math.ceil(n / task_rows)), rows.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, extra in chunks(batches, dtype):
            yield to_blocks(x, y, extra)

    rows = rows.coalesce(tasks) if tasks <= cores else rows.repartition(cores)
    return written(rows.mapInArrow(run, BLOCKS), name)
