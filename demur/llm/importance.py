"""Quality by importance resampling: how much likelier a text is under good texts than under all.

Words and pairs of words are hashed into ``BUCKETS`` classes. One pass counts them over all documents
(the raw model) and over labelled good ones (the target model); the logarithm of the ratio of both,
summed over a text, is its weight. Gumbel noise on the weights turns the best k into a sample without
replacement in proportion to the weights. The k-th key is found by counting, not by sorting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.llm.registry import query, stored, table
from demur.llm.textbytes import Slice, column_slices, mixed, running_hash, span_hash, words
from demur.operators.order import order_statistics
from demur.session import num_lit

BUCKETS = 10_000
# labelled good documents that the target model is fitted on, at most (those with the smallest hash)
TARGET_ROWS = 20_000
SEED = 29
U64 = np.uint64


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every pair of neighbouring words."""
    start, end, row = words(s)
    h = span_hash(running_hash(s.data), start, end)
    pair = np.flatnonzero(row[1:] == row[:-1])
    both = mixed(h[pair] * U64(0x9E3779B97F4A7C15) + h[pair + 1])
    return (np.concatenate([h, both]) % U64(BUCKETS)).astype(np.int64), np.concatenate([row, row[pair]])


def count_features(docs: DataFrame, targets: np.ndarray) -> DataFrame:
    """``bucket, n_raw, n_target`` over all documents (``doc_id, t``); each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            good = np.isin(ids, targets) & ~np.asarray(batch.column(0).is_null())
            for s in column_slices(batch, "t"):
                bucket, row = features(s)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[s.first + row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "n_raw", "n_target"]
        )

    counted = docs.mapInArrow(run, "bucket long, n_raw long, n_target long")
    return counted.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def fit_ratio(docs: DataFrame, targets: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket, both with one count more in each bucket."""
    n_raw, n_target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    counts = count_features(docs, targets).toArrow()
    at = counts.column("bucket").to_numpy()
    n_raw[at], n_target[at] = counts.column("n_raw").to_numpy(), counts.column("n_target").to_numpy()
    return np.log((n_target + 1) / (n_target.sum() + BUCKETS)) - np.log((n_raw + 1) / (n_raw.sum() + BUCKETS))


def log_weights(docs: DataFrame, ratio: np.ndarray, id_type: str) -> DataFrame:
    """``doc_id, n_features, log_weight`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in column_slices(batch, "t"):
                bucket, row = features(s)
                n = len(s.ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, n),
                        pa.array(np.bincount(row, minlength=n)),
                        # without any word numpy counts in whole numbers
                        pa.array(np.bincount(row, weights=ratio[bucket], minlength=n).astype(np.float64)),
                    ],
                    names=["doc_id", "n_features", "log_weight"],
                )

    return docs.mapInArrow(run, f"doc_id {id_type}, n_features long, log_weight double")


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    seed: int = SEED,
    target_rows: int = TARGET_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, log_weight, key, kept`` for every row.

    ``labels``: ``doc_id, quality``; the target model takes rows of quality 1, at most ``target_rows`` of
    them. ``share`` of all rows is kept, by default the share of quality 1 among the labels (all rows
    without labels). Ids are whole numbers. Null and empty texts have weight 0. Equal keys at the cut go to
    smaller ids; rows that share id and text are kept or left together. An empty table gives no row.
    """
    positive = labels.where("quality = 1 and doc_id is not null")
    counts = labels.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    share = share if share is not None else (counts["good"] / counts["n"] if counts["n"] else 1.0)
    sample = positive.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    targets = np.sort(sample.toArrow().column(0).to_numpy()) if counts["good"] else np.zeros(0, np.int64)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    scored = log_weights(texts, fit_ratio(texts, targets), "bigint")
    # uniform numbers inside (0, 1) from the id
    u = f"((xxhash64({seed}, doc_id) >> 11) + 4503599627370496 + 0.5D) / 9007199254740992D"
    scored = stored(scored.withColumn("key", F.expr(f"log_weight - ln(-ln({u}))")), "importance")
    n = scored.count()
    k = min(n, round(share * n))
    if k == n or k == 0:
        return scored.withColumn("kept", F.lit(k > 0))
    ranked = scored.select(F.lit("all").alias("g"), F.expr("-key").alias("v"), "doc_id")
    cut = order_statistics(ranked, {"all": [k]})["all", k]
    kept = f"key > {num_lit(-cut.value)}"
    if cut.below + cut.equal == k:
        kept = f"key >= {num_lit(-cut.value)}"
    else:
        ties = ranked.where(f"v = {num_lit(cut.value)}").select("g", F.col("doc_id").alias("v"))
        last = order_statistics(ties, {"all": [k - cut.below]})["all", k - cut.below]
        kept += f" or (key = {num_lit(-cut.value)} and doc_id <= {last.value})"
    return scored.withColumn("kept", F.expr(f"coalesce({kept}, false)"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
