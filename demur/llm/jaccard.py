"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Texts with one set are one class and are compared once. Classes
that agree on a band of MinHash values are candidates; their sketches (a byte by value) are compared a
few values at a time, and a pair is dropped as soon as the posterior probability that it reaches the
threshold is below ``TOLERANCE``. What is left is connected, and inside each connected set all pairs are
verified by their exact sets, so a link that chance hid from the bands is found there too.

Pairs are never rows. Buckets and sets are cut into blocks; a group of rows holds two blocks, compares
them with arrays and returns a few rows by member: links counted, and a spanning tree of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.components import components
from demur.llm.registry import query, stored, table
from demur.llm.textbytes import Slice, column_slices, mixed, running_hash, span_hash, words

U64 = np.uint64
WORDS = 5
# the similarity as a fraction: links have 10 * shared >= 8 * united
NUMERATOR, DENOMINATOR = 8, 10
# bands of four values: a pair at the threshold misses all 32 with probability 5e-8
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
TOLERANCE = 1e-6
STEPS = (16, 32, 64, 128)
# classes in a block of a bucket, and of a connected set
BUCKET_BLOCK, SET_BLOCK = 1024, 256
# pairs that are compared at a time
PAIRS_AT_ONCE = 1 << 18

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * U64(2) + U64(1)
WORD_FACTORS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * U64(2) + U64(1)


def shingles(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and their limits by text.

    A text of one to four words has one shingle of all its words; a text without words has none.
    """
    start, end, row = words(s)
    n_text = len(s.ends) - 1
    h = span_hash(running_hash(s.data), start, end)
    count = np.bincount(row, minlength=n_text)
    first = np.concatenate([[0], np.cumsum(count)])
    wide = np.zeros(len(h), U64)
    size = np.minimum(count, WORDS)
    left = first[1:][row] - np.arange(len(h))
    keep = left >= size[row]
    for k in range(WORDS):
        at = np.flatnonzero(keep & (k < size[row]))
        wide[at] += h[at + k] * WORD_FACTORS[k]
    wide, row = mixed(wide[keep]), row[keep]
    order = np.lexsort((wide, row))
    wide, row = wide[order], row[order]
    new = np.ones(len(wide), bool)
    new[1:] = (wide[1:] != wide[:-1]) | (row[1:] != row[:-1])
    wide, row = wide[new], row[new]
    return wide, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_text))])


def set_keys(wide: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """64-bit key of each set (0 for none)."""
    n = np.diff(limits)
    key = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if len(full):
        a = np.add.reduceat(mixed(wide + U64(1)), limits[full])
        b = np.bitwise_xor.reduceat(mixed(wide * U64(3) + U64(7)), limits[full])
        key[full] = mixed(a ^ mixed(b + n[full].astype(U64)))
    return key


def min_values(wide: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """MinHash values of each set that is not empty."""
    full = np.flatnonzero(np.diff(limits))
    out = np.zeros((len(full), VALUES), np.uint32)
    if len(full):
        for k in range(VALUES):
            out[:, k] = np.minimum.reduceat((wide * FACTORS[k]) >> U64(32), limits[full]).astype(np.uint32)
    return out


def _bands(mins: np.ndarray) -> np.ndarray:
    """One key for each band's values, other keys for other bands."""
    key = np.zeros((len(mins), BANDS), U64)
    for k in range(ROWS):
        key = mixed(key * U64(31) + mins[:, k::ROWS].astype(U64) + np.arange(BANDS, dtype=U64))
    return key.view(np.int64)


def _binary(rows: np.ndarray, width: int) -> pa.Array:
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(-1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, c, n, bands, sketch`` of every row of ``doc_id, text_key, t``.

    ``c`` is the set's key, then come its size, band keys and MinHash bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in column_slices(batch, "t"):
                wide, limits = shingles(s)
                n = np.diff(limits)
                mins = np.zeros((len(n), VALUES), np.uint32)
                mins[n > 0] = min_values(wide, limits)
                bands = _bands(mins)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, len(n)),
                        batch.column(1).slice(s.first, len(n)),
                        pa.array(set_keys(wide, limits).view(np.int64)),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, bands.reshape(-1)),
                        _binary((mins & 0xFF).astype(np.uint8), VALUES),
                    ],
                    names=["doc_id", "text_key", "c", "n", "bands", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, c long, n long, bands array<long>, sketch binary")


def fewest_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of compared values, the fewest matches with which a pair may still reach the threshold.

    The similarity has a uniform prior; sketches of one byte agree by chance once in 256 times.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    hit = grid + (1 - grid) / 256
    out = {}
    for n in STEPS:
        for m in range(n + 1):
            like = m * np.log(hit) + (n - m) * np.log1p(-hit)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() >= tolerance * like.sum():
                out[n] = m
                break
    return out


def surviving(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, fewest: dict[int, int]) -> np.ndarray:
    """Numbers of the pairs (a, b) that no step drops."""
    at, done, hits = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n in STEPS:
        hits = hits + (sketch[a[at], done:n] == sketch[b[at], done:n]).sum(axis=1)
        keep = hits >= fewest[n]
        at, hits, done = at[keep], hits[keep], n
    return at


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row connected to each of n rows by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def block_pairs(rows: DataFrame, key: str, member: str, size: str, block: int) -> DataFrame:
    """Rows of ``key`` in blocks of about ``block``, each row once for every block that its own meets."""
    return (
        rows.withColumn("blocks", F.expr(f"cast(ceil({size} / {block}) as bigint)"))
        .withColumn("own", F.expr(f"pmod(xxhash64({member}), blocks)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumn("lo", F.expr("least(own, other)"))
        .withColumn("hi", F.expr("greatest(own, other)"))
        .drop("blocks", "other", "size")
    )


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], at_least: int) -> Iterator[pa.Table]:
    """Tables of whole groups (equal ``names``, which the rows are sorted by), of some rows together."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n < at_least:
            continue
        t = pa.Table.from_batches(waiting)
        key = [t.column(c).to_numpy() for c in names]
        same = np.logical_and.reduce([k == k[-1] for k in key])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
            waiting, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(waiting)


def _starts(t: pa.Table, names: list[str]) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    for c in names:
        k = t.column(c).to_numpy()
        new[1:] &= k[1:] == k[:-1]
    new[1:] = ~new[1:]
    new[0] = True
    return np.append(np.flatnonzero(new), t.num_rows)


def _pairs(starts: np.ndarray, side: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare, group by group, some at a time.

    Within one block every pair once; between two blocks every pair of a row here and a row there.
    """
    out_a, out_b, n = [], [], 0
    for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if lo[x] == hi[x]:
            rows = np.arange(x, y)
            todo = ((np.repeat(rows[i : i + 128], y - x), np.tile(rows, len(rows[i : i + 128]))) for i in range(0, y - x, 128))
            todo = ((a[a < b], b[a < b]) for a, b in todo)
        else:
            left, right = np.arange(x, y)[side[x:y] == lo[x]], np.arange(x, y)[side[x:y] != lo[x]]
            todo = ((np.repeat(left[i : i + 128], len(right)), np.tile(right, len(left[i : i + 128]))) for i in range(0, len(left), 128))
        for a, b in todo:
            out_a.append(a)
            out_b.append(b)
            n += len(a)
            if n >= PAIRS_AT_ONCE:
                yield np.concatenate(out_a), np.concatenate(out_b)
                out_a, out_b, n = [], [], 0
    if n:
        yield np.concatenate(out_a), np.concatenate(out_b)


def candidate_edges(classes: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest, by task, of the pairs of classes that survive the comparison of sketches."""
    bands = classes.select("c", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(bands.join(shared, "band"), "bands")
    sketches = classes.select("c", "sketch")
    rows = members.join(sketches, "c")
    rows = block_pairs(rows, "band", "c", "size", BUCKET_BLOCK).repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "c")
    fewest = fewest_matches(NUMERATOR / DENOMINATOR)
    names = ["band", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, names, 4096):
            c = t.column("c").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
            distinct, node = np.unique(c, return_inverse=True)
            root = np.arange(len(distinct))
            lo, hi, own = (t.column(k).to_numpy() for k in ("lo", "hi", "own"))
            for a, b in _pairs(_starts(t, names), own, lo, hi):
                # pairs that earlier ones have connected add nothing
                new = root[node[a]] != root[node[b]]
                a, b = a[new], b[new]
                at = surviving(sketch, a, b, fewest)
                if len(at):
                    x, y = root[node[a[at]]], root[node[b[at]]]
                    root = smallest_linked(len(distinct), x, y)[root]
            far = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(distinct[far]), pa.array(distinct[root[far]])], names=["a", "b"])

    return rows.select("band", "lo", "hi", "own", "c", "sketch").mapInArrow(run, "a long, b long")


def exact_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``root, size, c, weight, items`` for each class of ``chosen`` (``c, place, root, size, weight``).

    A class is read from the rows at its ``place``: an id of it, or a text's key if its rows have no id.
    """
    # one kind of join at every size: a broadcast would grow with the near duplicates
    texts = docs.withColumn("place", F.coalesce("doc_id", "text_key")).join(chosen.hint("merge"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(batch.schema.get_field_index("c")).to_numpy()
            for s in column_slices(batch, "t"):
                wide, limits = shingles(s)
                key = set_keys(wide, limits).view(np.int64)
                # an id may stand on several texts: only the class's own counts
                own = np.flatnonzero(key == c[s.first : s.first + len(key)])
                items = [wide[limits[i] : limits[i + 1]].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(k)).take(pa.array(s.first + own)) for k in ("root", "size", "c", "weight")]
                    + [pa.array(items, pa.binary())],
                    names=["root", "size", "c", "weight", "items"],
                )

    sets = texts.select("root", "size", "c", "weight", "t").mapInArrow(run, "root long, size long, c long, weight long, items binary")
    return sets.groupBy("c").agg(*(F.first(k).alias(k) for k in ("root", "size", "weight", "items")))


def shared_counts(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of shingles that each set of ``left`` shares with each of ``right``."""
    used = np.union1d(left, right)
    flat = np.concatenate([items[i] for i in used])
    row = np.repeat(np.arange(len(used)), [len(items[i]) for i in used])
    _, item, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    column = np.cumsum(often) - 1
    keep = often[item]
    item, row = column[item[keep]], row[keep]
    order = np.argsort(item, kind="stable")
    item, row = item[order], row[order]
    x, y = np.searchsorted(used, left), np.searchsorted(used, right)
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(often.sum()), 4096):
        i, j = np.searchsorted(item, [a, a + 4096])
        part = np.zeros((len(used), 4096), np.float32)
        part[row[i:j], item[i:j] - a] = 1
        out += part[x] @ part[y].T
    return np.rint(out).astype(np.int64)


def verified(sets: DataFrame) -> DataFrame:
    """``c, links, near``: by block, how many rows each class is linked to, and the smallest class connected."""
    rows = block_pairs(sets, "root", "c", "size", SET_BLOCK).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "c")
    names = ["root", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, names, 1):
            starts = _starts(t, names)
            c, weight, lo, hi, own = (t.column(k).to_numpy() for k in ("c", "weight", "lo", "hi", "own"))
            items = [np.frombuffer(b, U64) for b in t.column("items").to_pylist()]
            size = np.array([len(i) for i in items])
            links, near = np.zeros(len(c), np.int64), np.arange(len(c))
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                rows = np.arange(x, y)
                one = lo[x] == hi[x]
                left = rows if one else rows[own[x:y] == lo[x]]
                right = rows if one else rows[own[x:y] != lo[x]]
                if not len(left) or not len(right):
                    continue
                shared = shared_counts(items, left, right)
                united = size[left][:, None] + size[right][None, :] - shared
                linked = DENOMINATOR * shared >= NUMERATOR * united
                if one:
                    np.fill_diagonal(linked, False)
                links[left] += linked @ weight[right]
                if not one:
                    links[right] += weight[left] @ linked
                a, b = np.nonzero(linked)
                near[x:y] = x + smallest_linked(y - x, left[a] - x, right[b] - x)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(links), pa.array(c[near])], names=["c", "links", "near"])

    return rows.select("root", "lo", "hi", "own", "c", "weight", "items").mapInArrow(run, "c long, links long, near long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, n_shingles, set_id, text_key, group_key`` for every row of the input.

    ``n_links``: other rows whose similarity with the row is 0.8 or more, rows of equal sets included.
    ``class_id``: smallest id among the rows that links connect with the row, the row itself included.
    ``set_id``: smallest id among the rows with exactly the row's set. Words are runs of other characters
    than white space, taken as they are. Texts of one to four words are one shingle. Null texts and texts
    without words have no shingle: each such row is a class of its own without links. Ids are whole numbers
    and may repeat or be null: rows are linked by their texts, and ``class_id`` and ``set_id`` are null only where
    no such row has an id. ``text_key`` is the text's hash and tells rows of one id apart; ``group_key`` is the same for
    all connected rows, null for rows without shingles. Other columns are not carried.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("t"))
    signed = stored(signatures(texts), "signatures")
    classes = stored(
        signed.where("n > 0")
        .groupBy("c")
        .agg(F.min("doc_id").alias("doc_id"), F.expr("coalesce(min(doc_id), min(text_key))").alias("place"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    found = components(candidate_edges(classes))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    chosen = found.withColumnRenamed("node", "c").join(sizes, "root").join(classes.select("c", "place", "weight"), "c")
    checked = stored(verified(exact_sets(texts, stored(chosen, "chosen"))), "checked")
    groups = components(checked.select(F.col("c").alias("a"), F.col("near").alias("b")))
    links = checked.groupBy("c").agg(F.sum("links").alias("links"))
    known = (
        classes.select("c", "doc_id", "weight", "n")
        .join(links, "c", "left")
        .join(groups.withColumnRenamed("node", "c"), "c", "left")
        .withColumn("root", F.coalesce("root", "c"))
    )
    lowest = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = known.join(lowest, "root").select(
        "c", "class_id", F.expr("coalesce(links, 0L) + weight - 1 as n_links"), F.col("doc_id").alias("set_id"), F.col("root").alias("group_key")
    )
    full = signed.where("n > 0").select("doc_id", "text_key", "c", F.col("n").alias("n_shingles")).join(known, "c")
    none = signed.where("n = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.expr("0L as n_links"), F.expr("0L as n_shingles"), F.col("doc_id").alias("set_id"),
        "text_key", F.expr("cast(null as bigint) as group_key"),
    )
    return full.select(*none.columns).unionByName(none)


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "group_key")


assert math.gcd(ROWS, VALUES) == ROWS and STEPS[-1] == VALUES
