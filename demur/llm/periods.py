"""Periodic runs of words, found by matching blocks of a text inside the windows next to them.

A run of period q that is long enough holds a block of a few fixed sizes (8, 12, 16, 24, ... words, at every
quarter of its size) that is no shorter than q and is followed, inside the run, by a copy q words later. For such
a block no copy stands nearer, so the copies in the window behind it are a progression with difference q.

All texts of a slice are one sequence with a mark of its own behind each text. Its suffix array is refined from one
block size to the next, only where suffixes still agree; the suffixes that start with a block are an interval
of it. A wavelet matrix over the array finds the next position of an interval (range successor). The
distance is the candidate period, and the stretch around the block that keeps it is the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.registry import query, table
from demur.llm.textbytes import Slice, column_slices, running_hash, span_hash, words

MIN_LENGTH, MIN_EXPONENT = 24, 3


class Blocks(NamedTuple):
    """Blocks that stand more than once: place, interval of the suffix array, size, and the size before that."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    smaller: np.ndarray


def first_size(min_length: int) -> int:
    """Largest power of two whose blocks every run of ``min_length`` and a period up to it must hold."""
    size = 1
    while 4 * size + max(1, size // 2) - 1 <= min_length:
        size *= 2
    return size


def next_size(size: int) -> int:
    """1, 2, 3, 4, 6, 8, 12, 16, ...: half as much again or a third more, in turn."""
    return size + 1 if size < 3 else size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3


def repeated_blocks(symbols: np.ndarray, first: int, longest: int) -> tuple[np.ndarray, Blocks]:
    """The suffix array, in order as far as blocks of up to ``longest`` symbols tell, and the repeated blocks.

    The last symbol stands nowhere else.
    """
    n = len(symbols)
    array = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[array[1:]] != symbols[array[:-1]]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)
    rank[array] = np.repeat(begin, count)
    act = array[np.repeat(count, count) > 1]
    size, known, out = 1, 0, []
    while len(act):
        if size >= first:
            group = rank[act]
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            many = np.diff(np.append(start, len(act)))
            here = np.flatnonzero(act % max(1, size // 4) == 0)
            low = group[here]
            high = low + np.repeat(many, many)[here]
            out.append((act[here], low, high, np.full(len(here), size), np.full(len(here), known)))
            known = size
        longer = 2 * size if size < first else next_size(size)
        if longer > longest:
            break
        # every suffix here agrees with another one on ``size`` symbols, so it has that many before the last one
        group, more = rank[act], rank[act + longer - size]
        order = np.argsort(group * n + more, kind="stable")
        act, group, more = act[order], group[order], more[order]
        old = np.ones(len(act), bool)
        old[1:] = group[1:] != group[:-1]
        new = old.copy()
        new[1:] |= more[1:] != more[:-1]
        index = np.arange(len(act))
        in_group = index - np.maximum.accumulate(np.where(old, index, 0))
        array[group + in_group] = act
        rank[act] = group + np.maximum.accumulate(np.where(new, index, 0)) - (index - in_group)
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(act)))
        act = act[np.repeat(many, many) > 1]
        size = longer
    none = np.zeros(0, np.int64)
    return array, Blocks(*(np.concatenate(c) for c in zip(*out))) if out else Blocks(none, none, none, none, none)


class Wavelet:
    """Wavelet matrix over whole numbers: one row of bits by binary digit, numbers dealt by digit, zeros first."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros = []
        for k in reversed(range(self.bits)):
            zero = (values >> k & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value of each range that is ``least`` or more, -1 if there is none."""
        smaller, left, right = np.zeros(len(low), np.int64), low, high
        for level, zeros in enumerate(self.zeros):
            k = self.bits - 1 - level
            one = (least >> k & 1).astype(bool)
            a, b = zeros[left], zeros[right]
            smaller += np.where(one, b - a, 0)
            left, right = np.where(one, left - a + zeros[-1], a), np.where(one, right - b + zeros[-1], b)
        smaller = np.where(least >> self.bits > 0, high - low, smaller)
        found = smaller < high - low
        nth, left, right, out = np.where(found, smaller, 0), low, high, np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[left], zeros[right]
            one = nth >= b - a
            nth = np.where(one, nth - (b - a), nth)
            out |= one.astype(np.int64) << (self.bits - 1 - level)
            left, right = np.where(one, left - a + zeros[-1], a), np.where(one, right - b + zeros[-1], b)
        return np.where(found, out, -1)


def agreement(running: np.ndarray, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Symbols up to ``most`` that agree from ``at`` and from ``at + shift`` on (or before both): halving by hashes."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        x = at - mid if back else at
        same = span_hash(running, x, x + mid) == span_hash(running, x + shift, x + shift + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _each(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range behind the other."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def runs_of(symbols: np.ndarray, longest: int, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of the sequence; ``longest``: length of its longest text."""
    array, blocks = repeated_blocks(symbols, first_size(min_length), max(longest // 2, 1))
    none = np.zeros(0, np.int64)
    if not len(blocks.at):
        return none, none, none
    # only the intervals of repeated blocks go into the wavelet matrix
    edge = np.bincount(blocks.low, minlength=len(array) + 1) - np.bincount(blocks.high, minlength=len(array) + 1)
    held = np.cumsum(edge)[:-1] > 0
    place = np.concatenate([[0], np.cumsum(held)])
    after = Wavelet(array[held]).successor(place[blocks.low], place[blocks.high], blocks.at + 1)
    period = after - blocks.at
    ok = (after >= 0) & (period <= blocks.size) & (period > blocks.smaller)
    at, size, period = blocks.at[ok], blocks.size[ok], period[ok]
    order = np.lexsort((at, period))
    at, size, period = at[order], size[order], period[order]
    # blocks of one period that overlap by that much lie in one run
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] > at[:-1] + size[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    period = period[first]
    running = running_hash(symbols)
    start = at[first] - agreement(running, at[first], period, at[first], back=True)
    end = at[last] + period + agreement(running, at[last], period, len(symbols) - at[last] - period, back=False)
    keep = end - start >= np.maximum(min_length, min_exponent * period)
    found = np.unique(np.stack([start[keep], period[keep], end[keep]], axis=1), axis=0)
    start, period, end = found.T
    x = _each(start, end - start - period)
    if not (symbols[x] == symbols[x + np.repeat(period, end - start - period)]).all():
        raise ArithmeticError("two spans of words have one hash")
    return start, end, period


def text_runs(s: Slice, min_length: int, min_exponent: int) -> tuple:
    """Words of all texts of a slice (start, end, text), and the runs: text, first word, length, period."""
    start, end, row = words(s)
    code, _ = pd.factorize(span_hash(running_hash(s.data), start, end))
    n_texts = len(s.ends) - 1
    n_words = np.bincount(row, minlength=n_texts)
    symbols = np.empty(len(code) + n_texts, np.int64)
    symbols[np.arange(len(code)) + row] = code
    marks = np.cumsum(n_words) + np.arange(n_texts)
    symbols[marks] = len(code) + np.arange(n_texts)
    x, y, period = runs_of(symbols, int(n_words.max()), min_length, min_exponent)
    text = np.searchsorted(marks, x)
    return (start, end, row), (text, x - (marks - n_words)[text], y - x, period)


def joined_words(s: Slice, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> pa.Array:
    """Each text's words with one blank between them."""
    more = np.ones(len(start), np.int64)
    if len(row):
        more[np.append(row[1:] != row[:-1], True)] = 0
    size = end - start + more
    out = np.append(s.data, np.uint8(32))[np.minimum(_each(start, size), len(s.data))] if len(start) else np.zeros(0, np.uint8)
    at = np.cumsum(size)
    out[(at - 1)[more > 0]] = 32
    ends = np.zeros(len(s.ends), np.int64)
    np.add.at(ends, row + 1, size)
    ends = np.cumsum(ends)
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``.

    Words are the parts between white space, numbered from 0. A run is a longest stretch with smallest period
    q of at least ``min_length`` and ``min_exponent`` (3 or more) times q words; ``runs`` holds start, length
    and period, by start and period. ``collapsed`` are the words, with one blank between them, without those
    that a run holds behind its first q. A null or empty text has no word. Rows are independent: repeated
    ids and rows and other columns of the input (which are not carried) change nothing; an empty table gives no row.
    """
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs need an exponent of 3 and a length of 2 at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in column_slices(batch, "t"):
                n = len(s.ends) - 1
                (start, end, row), (text, first, length, period) = text_runs(s, min_length, min_exponent)
                n_words = np.bincount(row, minlength=n)
                base = np.cumsum(n_words) - n_words
                edge = np.bincount(base[text] + first + period, minlength=len(row) + 1)
                edge -= np.bincount(base[text] + first + length, minlength=len(row) + 1)
                kept = np.cumsum(edge)[:-1] == 0
                collapsed = joined_words(s, start[kept], end[kept], row[kept])
                order = np.lexsort((period, first, text))
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
                fields = [pa.array(v[order]) for v in (first, length, period)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, n),
                        pa.array(n_words),
                        pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(RUN))),
                        collapsed.cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where one text in ten repeats a part of itself from a word on that the CRC-32 of its id names.

    Texts without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    part = docs.select("doc_id", "text", h.alias("h"), F.expr("crc32(cast(doc_id as string)) div 10").alias("g"))
    split = part.withColumn("w", F.expr(r"if(h % 10 = 0, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0), null)"))
    split = split.withColumn("a", F.expr("cast(if(size(w) > 0, g % size(w), 0) as int)"))
    split = split.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    made = "array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')"
    return split.select("doc_id", F.expr(f"if(size(w) > 0, {made}, text)").alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = collapse_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # runs come by start and period, so the first of equal ratios stays
    longest = """aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
                           (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))"""
    lines = r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    found = found.withColumn("m", F.expr(longest))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "m.start",
        "m.length",
        "m.period",
        F.expr("(1000 * m.length) div m.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
