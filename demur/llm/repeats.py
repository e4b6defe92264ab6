"""Removal of byte strings of 100 that stand earlier in the corpus.

Work is dealt out by content, so no task sees the corpus. Every 100-byte string has an anchor, the
leftmost of its 32-byte strings with the smallest hash; equal strings have equal anchors at the same
place. Neighbouring strings that share an anchor are a segment.

1. Segments are hashed where the text is read; equal ones of a slice keep the first. Shuffled by anchor,
   equal segments keep the first, and anchors with one content are done: nothing of them repeats.
2. The first segments of the other anchors are cut into short strips whose strings all contain a core of
   85 bytes. Strips with a core of their own are done, too.
3. Strips that share a core are turned into shard Burrows-Wheeler transforms, which are merged; intervals
   with a common prefix of 100 bytes are the equal strings, and all but the first of each are removed.
   Cores with very many strips are cut on into single strings and settled by aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.bwt import repeated
from demur.llm.registry import query, stored, table
from demur.llm.textbytes import Slice, column_slices, mixed, running_hash, span_hash

U64 = np.uint64
LENGTH, ANCHOR = 100, 32
SPAN = LENGTH - ANCHOR + 1
# places of strings relative to their anchor that share a strip
STRIP = 16
# strings of a text that are worked on at a time
CHUNK = 1 << 21
PLACE = U64((1 << 24) - 1)
# strips of a core up to which they are merged as shards; bytes of strips merged together; shards
CORE_STRIPS, BATCH_BYTES, SHARDS = 2048, 1 << 19, 4


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, m = 1, v
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(s: Slice) -> dict[str, np.ndarray]:
    """Segments of all texts of a slice: text, first string, number of strings, anchor, content, anchor's place."""
    out: dict[str, list] = {k: [] for k in ("row", "start", "n", "a", "c", "at")}
    n = len(s.data)
    for x in range(0, max(0, n - LENGTH + 1), CHUNK):
        data = s.data[x : x + CHUNK + LENGTH - 1]
        running = running_hash(data)
        p = np.arange(len(data) - ANCHOR + 1)
        h = span_hash(running, p, p + ANCHOR)
        at = (sliding_min((h & ~PLACE) | p.astype(U64), SPAN) & PLACE).astype(np.int64)
        q = np.arange(len(at))
        row = np.searchsorted(s.ends, q + x, "right") - 1
        ok = q + x + LENGTH <= s.ends[row + 1]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = ok.copy()
        stop[:-1] &= ~ok[1:] | new[1:]
        last = np.flatnonzero(stop)
        place = at[first]
        content = span_hash(running, first, last + LENGTH)
        for k, v in (
            ("row", row[first]),
            ("start", first + x - s.ends[row[first]]),
            ("n", last - first + 1),
            ("a", h[place]),
            ("c", mixed(content * U64(5) + (place - first).astype(U64))),
            ("at", place - first),
        ):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, U64 if k in "ac" else np.int64) for k, v in out.items()}


def joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that follow each other in a document, put together."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(start + n, first) if len(first) else start
    return doc[first], start[first], end - start[first]


COLUMNS = ["kind", "a", "c", "doc", "start", "n", "at"]
SCHEMA = "kind int, a long, c long, doc long, start long, n long, at long"


def _batch(kind: int, a, c, doc, start, n, at) -> pa.RecordBatch:
    ints = [np.asarray(v).view(np.int64) for v in (a, c, doc, start, n, at)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ints[2]), kind, np.int32)), *map(pa.array, ints)], names=COLUMNS)


def _removed(doc, start, n) -> pa.RecordBatch:
    doc, start, n = joined(doc, start, n)
    zero = np.zeros(len(doc), np.int64)
    return _batch(0, zero, zero, doc, start, n, zero)


def read_segments(docs: DataFrame) -> DataFrame:
    """Kind 1: the first of equal segments of a slice; kind 0: strings that are removed already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shift = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for s in column_slices(batch, "t"):
                g = segments(s)
                doc, start = ids[s.first + g["row"]], g["start"] + shift[s.first + g["row"]]
                order = np.lexsort((start, doc, g["c"], g["a"]))
                a, c = g["a"][order], g["c"][order]
                again = np.zeros(len(a), bool)
                again[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
                keep, drop = order[~again], order[again]
                yield _batch(1, g["a"][keep], g["c"][keep], doc[keep], start[keep], g["n"][keep], g["at"][keep])
                if len(drop):
                    yield _removed(doc[drop], start[drop], g["n"][drop])

    return docs.mapInArrow(run, SCHEMA)


def settle_segments(found: DataFrame) -> DataFrame:
    """Kind 0: later copies of equal segments; kind 2: first ones of anchors that have several contents.

    The rows of an anchor pass by in order and only the last few are remembered, so an anchor that very
    many documents share costs its task time but no memory.
    """
    rows = found.where("kind = 1").select(*COLUMNS).repartition("a").sortWithinPartitions("a", "c", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the last first-segment so far, which waits for its anchor's next content
        held_out = True
        last = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack([batch.column(k).to_numpy() for k in range(1, 7)], axis=1)
            same_a, same = np.zeros(len(v), bool), np.zeros(len(v), bool)
            same_a[1:] = v[1:, 0] == v[:-1, 0]
            same[1:] = same_a[1:] & (v[1:, 1] == v[:-1, 1])
            same_a[0] = last[0] is not None and v[0, 0] == last[0]
            same[0] = same_a[0] and v[0, 1] == last[1]
            last = (v[-1, 0], v[-1, 1])
            if same.any():
                d = v[same]
                yield _removed(d[:, 2], d[:, 3], d[:, 4])
            f = v[~same]
            if not len(f):
                continue
            if held is not None:
                f = np.concatenate([held[None, :], f])
            pair = f[1:, 0] == f[:-1, 0]
            several = np.zeros(len(f), bool)
            several[1:] |= pair
            several[:-1] |= pair
            out = several.copy()
            if held is not None and held_out:
                out[0] = False
            held, held_out = f[-1], bool(several[-1])
            if out.any():
                d = f[out]
                yield _batch(2, *(d[:, k].copy() for k in range(6)))

    return rows.mapInArrow(run, SCHEMA)


def strips(texts: DataFrame, several: DataFrame) -> DataFrame:
    """``core, doc, start, n, b``: strips of the segments of kind 2, with their bytes."""
    wanted = several.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "at", "a")).alias("want"))
    rows = texts.join(wanted, texts["id"] == wanted["doc"]).select("id", "t", "shift", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shift = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            wants = batch.column(3)
            for s in column_slices(batch, "t"):
                part = wants.slice(s.first, len(s.ends) - 1)
                flat = part.flatten()
                row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                start, n, at, a = (flat.field(k).to_numpy() for k in range(4))
                start = start - shift[s.first + row]
                size = s.ends[row + 1] - s.ends[row]
                ok = (start >= 0) & (start + n + LENGTH - 1 <= size)  # else another part of the document has them
                row, start, n, at, a = row[ok], start[ok], n[ok], at[ok], a[ok]
                begin = s.ends[row] + start
                anchor = begin + at
                # strings of a segment stand at - 0, at - 1, ... bytes before the anchor; strips are ranges of that
                low, high = (at - n + 1) // STRIP, at // STRIP
                many = high - low + 1
                k = np.repeat(np.arange(len(row)), many)
                r = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
                first = np.maximum(begin[k], anchor[k] - STRIP * r - STRIP + 1)
                last = np.minimum(begin[k] + n[k] - 1, anchor[k] - STRIP * r)
                core_from = anchor[k] - STRIP * r
                running = running_hash(s.data)
                core = span_hash(running, core_from, core_from - STRIP + 1 + LENGTH)
                core = mixed(core ^ mixed(a[k].view(U64) + r.astype(U64)))
                raw = s.data.tobytes()
                b = [raw[x : y + LENGTH] for x, y in zip(first.tolist(), last.tolist())]
                doc = ids[s.first + row[k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core.view(np.int64)),
                        pa.array(doc),
                        pa.array(first - s.ends[row[k]] + shift[s.first + row[k]]),
                        pa.array(last - first + 1),
                        pa.array(b, pa.binary()),
                    ],
                    names=["core", "doc", "start", "n", "b"],
                )

    return rows.mapInArrow(run, "core long, doc long, start long, n long, b binary")


def merged(rows: DataFrame) -> DataFrame:
    """Strings removed among strips that share a core, by merging the strips' shards."""
    rows = rows.repartition("core").sortWithinPartitions("core", "b", "doc", "start")

    def settle(core, doc, start, n, b) -> Iterator[pa.RecordBatch]:
        """Whole groups of equal cores."""
        again = np.zeros(len(core), bool)
        again[1:] = (core[1:] == core[:-1]) & np.fromiter((x == y for x, y in zip(b[1:], b[:-1])), bool, len(b) - 1)
        out = [(doc[again], start[again], n[again])]
        first = np.flatnonzero(~again)
        pair = core[first][1:] == core[first][:-1]
        several = np.zeros(len(first), bool)
        several[1:] |= pair
        several[:-1] |= pair
        first = first[several]
        at = 0
        while at < len(first):
            # strips of whole cores, about a batch at a time
            total, stop = 0, at
            while stop < len(first) and (total < BATCH_BYTES or core[first[stop]] == core[first[stop - 1]]):
                total += len(b[first[stop]])
                stop += 1
            own = first[at:stop]
            blocks = [[b[i] for i in part] for part in np.array_split(own, SHARDS)]
            interval, string, offset = repeated(blocks, LENGTH)
            d, p = doc[own[string]], start[own[string]] + offset
            order = np.lexsort((p, d, interval))
            interval, d, p = interval[order], d[order], p[order]
            later = np.zeros(len(d), bool)
            later[1:] = interval[1:] == interval[:-1]
            out.append((d[later], p[later], np.ones(int(later.sum()), np.int64)))
            at = stop
        yield _removed(*(np.concatenate(x) for x in zip(*out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(x.num_rows for x in waiting) < 4096:
                continue
            t = pa.Table.from_batches(waiting)
            core = t.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1]))
            if cut:
                yield from settle(*_columns(t.slice(0, cut)))
                waiting = t.slice(cut).to_batches()
        if waiting:
            yield from settle(*_columns(pa.Table.from_batches(waiting)))

    return rows.select("core", "doc", "start", "n", "b").mapInArrow(run, SCHEMA)


def _columns(t: pa.Table) -> list:
    return [t.column(k).to_numpy() for k in ("core", "doc", "start", "n")] + [t.column("b").to_pylist()]


def single_strings(rows: DataFrame) -> DataFrame:
    """Strings removed among strips of very common cores: all but the first of each string, by aggregates."""
    each = rows.select("doc", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"), "start", "b").select(
        "doc",
        (F.col("start") + F.col("k")).alias("start"),
        F.expr(f"substring(b, cast(k as int) + 1, {LENGTH})").alias("b"),
    )
    keyed = each.select("doc", "start", F.sha2("b", 256).alias("h"))
    first = keyed.groupBy("h").agg(F.min(F.struct("doc", "start")).alias("first"))
    return keyed.join(first, "h").where("struct(doc, start) > first").select("doc", "start", F.lit(1).cast("bigint").alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` for every row of the input.

    Every byte goes that is covered by a 100-byte string (of the text's UTF-8) that also starts earlier:
    under a smaller id, or under the same id at an earlier place. Strings do not cross texts. Rows that
    share id and text are one text; other rows of one id are parts of one document in the order of their
    texts' hashes. A null text is empty. ``kept_text`` is null where the cut leaves no valid UTF-8. Ids are
    whole numbers; a row without an id keeps its text; other columns are not carried.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    sizes = texts.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if sizes.limit(1).count():
        parts = texts.join(sizes, "id").select("id", F.xxhash64("t").alias("h"), F.octet_length("t").cast("bigint").alias("size")).distinct()
        parts = parts.withColumn("shift", F.expr("coalesce(sum(size) over (partition by id order by h rows between unbounded preceding and 1 preceding), 0L)"))
        parts = stored(parts.select(F.col("id").alias("i"), "h", "shift"), "parts")
        texts = texts.join(parts, (texts["id"] == parts["i"]) & (F.xxhash64("t") == parts["h"]), "left").select("id", "t", F.coalesce("shift", F.lit(0)).cast("bigint").alias("shift"))
        known = texts.where("id is not null").dropDuplicates(["id", "shift"])
    else:
        texts = texts.withColumn("shift", F.lit(0).cast("bigint"))
        known = texts.where("id is not null")
    long = known.where(F.octet_length("t") >= LENGTH)
    found = stored(read_segments(long), "segments")
    settled = stored(settle_segments(found), "settled")
    strip = stored(strips(long, settled.where("kind = 2")), "strips")
    cores = strip.groupBy("core").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = strip.join(cores, "core")
    merge = merged(shared.where(f"size <= {CORE_STRIPS}").drop("size"))
    single = single_strings(shared.where(f"size > {CORE_STRIPS}").drop("size"))
    removed = (
        found.where("kind = 0").select("doc", "start", "n")
        .unionByName(settled.where("kind = 0").select("doc", "start", "n"))
        .unionByName(merge.select("doc", "start", "n"))
        .unionByName(single)
    )
    ranges = stored(removed.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "ranges")
    rows = texts.join(ranges, texts["id"] == ranges["doc"], "left").select("id", "t", "shift", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift = batch.column(2).to_numpy()
            for s in column_slices(batch, "t"):
                n_text = len(s.ends) - 1
                part = batch.column(3).slice(s.first, n_text)
                n_removed, n_spans, sha, kept = [], [], [], []
                for i in range(n_text):
                    data = s.data[s.ends[i] : s.ends[i + 1]]
                    ranges = part[i].values
                    if ranges is not None and len(ranges) and len(data) >= LENGTH:
                        start = ranges.field(0).to_numpy() - shift[s.first + i]
                        end = start + ranges.field(1).to_numpy() + LENGTH - 1
                        own = (start >= 0) & (end <= len(data))
                        edge = np.bincount(start[own], minlength=len(data) + 1) - np.bincount(end[own], minlength=len(data) + 1)
                        gone = np.cumsum(edge)[:-1] > 0
                        n_removed.append(int(gone.sum()))
                        n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                        data = data[~gone]
                    else:
                        n_removed.append(0)
                        n_spans.append(0)
                    raw = data.tobytes()
                    sha.append(hashlib.sha256(raw).hexdigest())
                    try:
                        kept.append(raw.decode())
                    except UnicodeDecodeError:
                        kept.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, n_text),
                        pa.array(np.diff(s.ends)),
                        pa.array(n_removed, pa.int64()),
                        pa.array(n_spans, pa.int64()),
                        pa.array(sha, pa.string()),
                        pa.array(kept, pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
