"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (dense layers and attention). Pieces are
taken in descending order and each goes to the cheapest open sequence with room for it; a new sequence
opens only if none has. Documents longer than a sequence first give full sequences; what is left of
them is packed like the short ones.

Only a row by piece is shuffled (no ids): the checksums are taken where the text is encoded. Pieces are
packed in groups of about ``group_rows`` by a hash of the document, so tasks stay bounded however many
documents there are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.bpe import load
from demur.llm.registry import query, table
from demur.llm.textbytes import column_slices

CAPACITY = 2048
CLOSING_ID = 1
# costs by token and by squared token: at 2,048 tokens attention weighs as much as the rest
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_ROWS = 8192


class OpenSequences:
    """Sequences by free room; finds the cheapest with at least a given room in log steps."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.width)]
        self.best = [(float("inf"), -1)] * (2 * self.width)

    def _refresh(self, room: int) -> None:
        i = room + self.width
        self.best[i] = self.heaps[room][0] if self.heaps[room] else (float("inf"), -1)
        while i > 1:
            i //= 2
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._refresh(room)

    def take(self, room: int) -> tuple[int, float, int] | None:
        """Room, cost and number of the cheapest sequence with ``room`` free tokens, taken out."""
        low, high = room + self.width, 2 * self.width
        found, at = (float("inf"), -1), 0
        while low < high:
            for i in ([low] if low & 1 else []) + ([high - 1] if high & 1 else []):
                if self.best[i] < found:
                    found, at = self.best[i], i
            low, high = (low + 1) // 2, high // 2
        if found[1] < 0:
            return None
        while at < self.width:
            at = 2 * at if self.best[2 * at] == found else 2 * at + 1
        heapq.heappop(self.heaps[at - self.width])
        self._refresh(at - self.width)
        return at - self.width, *found


def assign(
    lengths: np.ndarray, capacity: int, linear: float, quadratic: float
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; the pieces come in descending order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    seqs, opened = OpenSequences(capacity), 0
    for i, n in enumerate(lengths.tolist()):
        room, cost, number = seqs.take(n) or (capacity, 0.0, opened)
        opened += number == opened
        sequence[i], offset[i] = number, capacity - room
        if room > n:
            seqs.put(room - n, cost + linear * n + quadratic * n * n, number)
    return sequence, offset


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: every document in pieces of at most ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for s in column_slices(batch, "t"):
                ids, limits = bpe.encoded(s, closing_id)
                raw = memoryview(ids.astype("<u4")).cast("B")
                size = np.diff(limits)
                parts = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = part * capacity
                length = np.minimum(size[row] - start, capacity)
                at = (limits[row] + start).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, len(size)).take(pa.array(row)),
                        pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row]),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
    linear: float = LINEAR, quadratic: float = QUADRATIC, group_rows: int = GROUP_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row by piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost``.

    A null or empty text is a document of its closing id alone. Every row is packed for itself, so
    repeated ids and equal texts give pieces of their own; ties in length go to the smaller id, start
    and checksum. An empty table gives no row. Other columns of the input are not carried.
    """
    groups = max(1, -(-docs.count() // group_rows))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        number, offset = assign(pdf["length"].to_numpy(), capacity, linear, quadratic)
        n = pdf["length"].astype("float64")
        pdf["sequence_id"] = pdf["g"].astype("int64") * (1 << 32) + number
        pdf["offset"] = offset
        pdf["cost"] = linear * n + quadratic * n * n
        return pdf.drop(columns="g")

    pieces = token_pieces(docs, path, capacity, closing_id, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        pieces.withColumn("g", F.expr(f"pmod(xxhash64(doc_id, doc_tokens, ids_crc32), {groups})"))
        .groupBy("g")
        .applyInPandas(
            fill,
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long,"
            " sequence_id long, offset long, cost double",
        )
    )


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
