"""Token counts: a prefix dynamic programme holds the exact count of every prefix.

The table of a piece gives its tokens at each byte (``bpe.Bpe.prefix_tokens``), and a text's count at a
piece's end is the sum so far. Lengths, limits and cuts are read from it; no text is encoded for a second
question. The tables are learnt once by worker for each distinct piece, so the cost is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.bpe import Bpe, load
from demur.llm.registry import query, table
from demur.llm.textbytes import Slice, column_slices


def fitting_bytes(bpe: Bpe, s: Slice, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the bytes of its longest start whose tokens stay within ``limit``.

    The start ends at a character, in or before the piece at which the running count passes the limit.
    """
    start, _, _, counts, limits = bpe.counted(s)
    total = np.concatenate([[0], np.cumsum(counts)])
    n_tokens = np.diff(total[limits])
    fit = np.diff(s.ends)
    for row in np.flatnonzero(n_tokens > limit):
        first, last = limits[row], limits[row + 1]
        k = int(np.searchsorted(total[first : last + 1], total[first] + limit, "right")) - 1 + first
        here = max(first, k - 2)
        stop = start[k + 1] if k + 1 < last else s.ends[row + 1]
        raw = s.data[start[here] : stop].tobytes()
        within = bpe.prefix_counts(raw) + (total[here] - total[first]) <= limit
        data = np.frombuffer(raw + b"a", np.uint8)
        at = np.flatnonzero(within & ((data & 0xC0) != 0x80))
        fit[row] = start[here] + (at[-1] if len(at) else 0) - s.ends[row]
    return n_tokens, fit


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_bytes`` for every row.

    A null or empty text has no token and no byte. Rows are independent: repeated ids, equal texts and
    any other columns of the input (which are not carried) change nothing. ``fit_bytes`` is the length of
    the longest start, at a character, that has at most ``limit`` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for s in column_slices(batch, "t"):
                n_tokens, fit = fitting_bytes(bpe, s, limit)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, len(n_tokens)),
                        pa.array(np.diff(s.ends)),
                        pa.array(n_tokens),
                        pa.array(n_tokens > limit),
                        pa.array(fit),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long"
    )


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, counts``: entry i is the token count of the text's first i bytes (entry 0 is 0).

    With it, any limit or cut is a lookup: see ``tokens_at`` and ``cut_at``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for s in column_slices(batch, "t"):
                n = len(s.ends) - 1
                rows = [bpe.prefix_counts(s.data[s.ends[i] : s.ends[i + 1]].tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, n), pa.array(rows, pa.list_(pa.int32()))],
                    names=["doc_id", "counts"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, counts array<int>"
    )


def tokens_at(counts: str, n_bytes: str) -> F.Column:
    """Tokens of the first ``n_bytes`` bytes; null beyond the text's end."""
    return F.expr(f"try_element_at({counts}, cast({n_bytes} + 1 as int))")


def cut_at(counts: str, limit: int) -> F.Column:
    """Bytes of the longest prefix with at most ``limit`` tokens."""
    return F.expr(f"array_max(filter(sequence(0, size({counts}) - 1), i -> {counts}[i] <= {int(limit)}))")


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
