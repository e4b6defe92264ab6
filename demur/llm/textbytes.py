"""Texts of an Arrow batch as one byte buffer, in slices of bounded size, and hashes of its spans.

The helpers work on whole arrays, so the Python cost is by slice and not by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at a time; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
# white space between words: blank, tab, line feed, vertical tab, form feed, carriage return
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Slice(NamedTuple):
    """``data``: bytes; text i holds ``data[ends[i]:ends[i + 1]]`` and is row ``first + i`` of its batch."""

    first: int
    data: np.ndarray
    ends: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A batch's texts in slices of about ``limit`` bytes; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Slice(first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def column_slices(batch: pa.RecordBatch, name: str) -> Iterator[Slice]:
    return slices(batch.column(batch.schema.get_field_index(name)))


_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, BASE)]))
        undo = U64(pow(int(BASE), -1, 1 << 64))
        _inverse = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, undo)]))
    return _powers, _inverse


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def running_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any span."""
    powers, _ = _power_tables(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, the same wherever the span stands."""
    _, inverse = _power_tables(len(running))
    return mixed((running[end] - running[start]) * inverse[start] + (end - start).astype(U64))


def words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than white space) and the text of each."""
    if not len(s.data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~BLANK[s.data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    cuts = s.ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(s.data))]
    head[cuts] = inside[cuts]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | head[1:]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(s.ends, start, "right") - 1


def runs(s: Slice, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes that ``inside`` marks, and the text of each."""
    if not len(s.data):
        none = np.zeros(0, np.int64)
        return none, none, none
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    cuts = s.ends[1:-1]
    cuts = cuts[cuts < len(s.data)]
    head[cuts] = inside[cuts]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | head[1:]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(s.ends, start, "right") - 1


# fixed values: bytes A-Z become a-z, all others stay
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(s: Slice) -> Slice:
    """The slice with A-Z in lower case."""
    return s._replace(data=LOWER[s.data])
