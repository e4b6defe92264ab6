"""Benchmark decontamination by winnowing: texts and test items are compared by a few fingerprints each.

A fingerprint is the hash of ``GRAM`` words that is the smallest (leftmost if equal) of ``WIDE`` neighbouring
ones. Two texts that share GRAM + WIDE - 1 words in a row share a fingerprint inside them, so no shared window
of that length is lost. Fingerprints carry the words around them (as hashes); where those of a text and of an
item are joined, the agreement is extended to both sides and counts if it fills a window. Items that are
shorter than a window are fingerprinted whole.

Few texts share anything with a benchmark, so a bitmap of the items' fingerprints drops most of the texts'
ones before they are shuffled. Its size follows the benchmark up to a fixed bound; beyond that it lets more
through, never less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demur.llm.registry import query, stored, table
from demur.llm.textbytes import Slice, column_slices, lowered, mixed, running_hash, runs, span_hash

U64 = np.uint64
GRAM, WIDE = 5, 6
WINDOW = GRAM + WIDE - 1
# words on each side of a gram that a window around it can hold, and all words of a fingerprint
AROUND = WINDOW - GRAM
CONTEXT = GRAM + 2 * AROUND
# the bitmap has 2**16 bits at least and 2**27 (16 MB) at most
FEW_BITS, MANY_BITS = 16, 27
# stands for the words before and behind a text; the two sides never agree there
OUTSIDE_TEXT, OUTSIDE_ITEM = 0, 1
# fixed values: words are digits, letters a-z and everything beyond ASCII
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def hashed_words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the slice in lower case, and the first word of each text (one entry more at the end)."""
    s = lowered(s)
    start, end, row = runs(s, WORD[s.data])
    return span_hash(running_hash(s.data), start, end), np.searchsorted(row, np.arange(len(s.ends)))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, U64)
    for k in range(size):
        out = out * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)


def winnowed(h: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and gram hash of the fingerprints of all texts that fill a window."""
    g = gram_hashes(h, GRAM)
    at = _inside(limits, WINDOW)
    best, pick = g[at], at.copy()
    for k in range(1, WIDE):
        less = g[at + k] < best
        best[less] = g[at + k][less]
        pick[less] = at[less] + k
    pick = np.unique(pick)
    return pick, g[pick]


def _inside(limits: np.ndarray, size: int) -> np.ndarray:
    """Words from which ``size`` words lie in one text."""
    n = np.maximum(np.diff(limits) - size + 1, 0)
    return np.arange(int(n.sum())) + np.repeat(limits[:-1] - np.cumsum(n) + n, n)


def contexts(h: np.ndarray, limits: np.ndarray, at: np.ndarray, size: int, outside: int) -> np.ndarray:
    """The words of each fingerprint: those around the gram, or a short item's own ones."""
    if size < WINDOW:
        out = np.zeros((len(at), CONTEXT), U64)
        out[:, :size] = h[at[:, None] + np.arange(size)]
        return out
    row = np.searchsorted(limits, at, "right") - 1
    place = at[:, None] + np.arange(-AROUND, GRAM + AROUND)
    ok = (place >= limits[row][:, None]) & (place < limits[row + 1][:, None])
    return np.where(ok, h[np.clip(place, 0, len(h) - 1)], U64(outside))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values of one size."""
    width = rows.shape[1] * 8
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(values: pa.Array) -> np.ndarray:
    n = len(values)
    ends = np.frombuffer(values.buffers()[1], np.int32, n + 1, values.offset * 4)
    return np.frombuffer(values.buffers()[2], U64, n * CONTEXT, int(ends[0])).reshape(n, CONTEXT)


def item_prints(bench: DataFrame) -> DataFrame:
    """``item, content, size, gram, context`` of each fingerprint of ``bench`` (``item, t``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in column_slices(batch, "t"):
                h, limits = hashed_words(s)
                n_words = np.diff(limits)
                content = span_hash(running_hash(h), limits[:-1], limits[1:])
                for size in [WINDOW, *sorted(set(n_words[(n_words > 0) & (n_words < WINDOW)].tolist()))]:
                    at, gram = winnowed(h, limits) if size == WINDOW else (limits[:-1][n_words == size], None)
                    gram = gram_hashes(h, size)[at] if gram is None else gram
                    row = np.searchsorted(limits, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(s.first + row)),
                            pa.array(content[row].view(np.int64)),
                            pa.array(np.full(len(at), size, np.int32)),
                            pa.array(gram.view(np.int64)),
                            _binary(contexts(h, limits, at, size, OUTSIDE_ITEM)),
                        ],
                        names=["item", "content", "size", "gram", "context"],
                    )

    return bench.mapInArrow(run, "item string, content long, size int, gram long, context binary")


def bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of all values of ``gram`` modulo the number of bits; the aggregate makes blocks of 4 KB."""
    n = grams.count()
    bits = min(MANY_BITS, max(FEW_BITS, int(16 * n).bit_length()))
    place = F.expr(f"(gram & {(1 << bits) - 1}) + 1")
    rows = grams.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in rows.collect():  # at most 2**27 / 2**15 rows
        out[(r["block"] - 1) * 4096 : r["block"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out[: (1 << bits) // 8]


def text_prints(docs: DataFrame, sizes: list[int], seen: np.ndarray, id_type: str) -> DataFrame:
    """A row ``size`` 0 with ``n_words`` for each text, and its fingerprints that ``seen`` may hold, with all places.

    Equal words around equal grams of one text are one row, so a text that repeats itself stays small.
    """
    mask = U64(len(seen) * 8 - 1)
    names = ["rid", "id", "n_words", "size", "gram", "context", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for s in column_slices(batch, "t"):
                h, limits = hashed_words(s)
                n = len(s.ends) - 1
                none = pa.nulls(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, n),
                        batch.column(1).slice(s.first, n),
                        pa.array(np.diff(limits)),
                        pa.array(np.zeros(n, np.int32)),
                        none.cast(pa.int64()),
                        none.cast(pa.binary()),
                        none.cast(pa.list_(pa.int64())),
                    ],
                    names=names,
                )
                for size in sizes:
                    if size == WINDOW:
                        at, gram = winnowed(h, limits)
                    else:
                        at = _inside(limits, size)
                        gram = gram_hashes(h, size)[at]
                    place = gram & mask
                    hit = np.flatnonzero(seen[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8) & 1)
                    if not len(hit):
                        continue
                    at, gram = at[hit], gram[hit]
                    row = np.searchsorted(limits, at, "right") - 1
                    context = contexts(h, limits, at, size, OUTSIDE_TEXT)
                    order = np.lexsort((at, *context.T, gram, row))
                    at, gram, row, context = at[order], gram[order], row[order], context[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]).any(axis=1)
                    first = np.flatnonzero(new)
                    many = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rid[s.first + row[first]]),
                            batch.column(1).take(pa.array(s.first + row[first])),
                            pa.nulls(many, pa.int64()),
                            pa.array(np.full(many, size, np.int32)),
                            pa.array(gram[first].view(np.int64)),
                            _binary(context[first]),
                            pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at - limits[row])),
                        ],
                        names=names,
                    )

    return docs.mapInArrow(run, f"rid long, id {id_type}, n_words long, size int, gram long, context binary, places array<long>")


def extended(pairs: DataFrame) -> DataFrame:
    """``rid, cid, start, stop``: words of texts inside windows that an item's fingerprint shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).to_numpy()
            same = _numbers(batch.column(4)) == _numbers(batch.column(5))
            # agreeing words next to the gram on both sides
            left = np.cumprod(same[:, AROUND - 1 :: -1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, AROUND + GRAM :], axis=1).sum(axis=1)
            ok = same[:, AROUND : AROUND + GRAM].all(axis=1) & (left + right + GRAM >= WINDOW)
            short = size < WINDOW
            left[short], right[short] = 0, size[short] - GRAM
            ok[short] = same[short].all(axis=1)
            keep = np.flatnonzero(ok)
            places = batch.column(3).take(pa.array(keep))
            k = keep[np.repeat(np.arange(len(keep)), np.diff(places.offsets.to_numpy()))]
            at = places.flatten().to_numpy()
            start, stop = at - left[k], at + GRAM + right[k]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (start[1:] > stop[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(k))[: len(first)] - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(k[first])), batch.column(1).take(pa.array(k[first])), pa.array(start[first]), pa.array(stop[last])],
                names=["rid", "cid", "start", "stop"],
            )

    return pairs.select("rid", "cid", "size", "places", "context", "item_context").mapInArrow(
        run, "rid long, cid long, start long, stop long"
    )


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` for every row of ``docs``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A window is ``WINDOW``
    words of an item in a row, or all words of a shorter item. ``n_hit`` words of the text lie in ``spans`` (start
    and stop, in words), the places where windows occur; ``items`` are the items they belong to, as sorted
    strings. Null and empty texts have no word, items without words hit nothing. Rows are judged one by
    one, also repeated ones; rows of one item id are one item; an item without id marks words but is not
    listed. Other columns are not carried. An empty table on either side gives rows without hits, or none.
    """
    spark = docs.sparkSession
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("t"))
    prints = stored(item_prints(items), "item-prints")
    # equal fingerprints of many items are looked up once
    cores = stored(prints.select("size", "gram", "context").distinct().withColumn("cid", F.monotonically_increasing_id()), "cores")
    owners = prints.where("item is not null").select("size", "gram", "context", "content").distinct().join(cores, ["size", "gram", "context"]).select("cid", "content")
    names = prints.where("item is not null").select("content", "item").distinct()
    sizes = sorted(r["size"] for r in cores.select("size").distinct().collect())  # at most WINDOW rows

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    # written once, so a text keeps its row number whatever executor is lost
    found = stored(text_prints(rows, sizes, bitmap(cores), id_type), "text-prints")
    marked = found.where("size > 0").select("rid", "size", "gram", "context", "places")
    pairs = marked.join(cores.withColumnRenamed("context", "item_context"), ["size", "gram"])
    hits = stored(extended(pairs), "hits")

    in_text = Window.partitionBy("rid").orderBy("start", "stop")
    before = F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        hits.select("rid", "start", "stop").distinct()
        .withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .groupBy("rid").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )
    listed = (
        hits.select("rid", "cid").distinct().join(owners, "cid").select("rid", "content").distinct()
        .join(names, "content").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return (
        found.where("size = 0").select("rid", F.col("id").alias("doc_id"), "n_words")
        .join(spans, "rid", "left").join(listed, "rid", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")).alias("spans"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        )
    )


def _sql_words(text: str) -> str:
    small = "abcdefghijklmnopqrstuvwxyz"
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{small.upper()}', '{small}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words("text")} AS w FROM benchmark),
parts AS (SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM parts),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k),
hits AS MATERIALIZED (SELECT rid, i, k, item FROM (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM places) JOIN windows USING (k, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid)
"""


@query("op13_benchmark_decontamination", SQL)
def op13_benchmark_decontamination(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
