"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote.

Quality rules drop bad texts, one document of each near-duplicate group stays, personal data is masked,
sources are mixed to target weights, and what is left is packed into training sequences. All stages but
the last return the columns of ``documents``. What a stage keeps in the shared folder while it works is
deleted when the next stage begins, since by then its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demur.llm import jaccard, mixing, packing, pii, quality
from demur.llm.registry import Scratch, stored, table

# share of the tokens that the mixture takes; every document at most once
MIXED_SHARE = 0.9


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    carried = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    judged = quality.quality(carried, keep=("row",)).where("kept")
    return judged.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (then the smallest text hash) of each group; rows without words stay.

    Rows are told apart by id and text, not by id alone; of rows that share both, one stays.
    """
    groups = jaccard.near_duplicates(docs).select("doc_id", "text_key", "group_key")
    rows = stored(groups.groupBy("group_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key", "n")
    first = rows.where("group_key is not null").groupBy("group_key").agg(F.min(order).alias("m"))
    kept = first.select(F.col("m.doc_id").alias("_id"), F.col("m.text_key").alias("_key"), (F.col("m.n") > 1).alias("_more"))
    kept = kept.unionByName(rows.where("group_key is null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(False).alias("_more")))
    kept = stored(kept, "kept")
    keyed = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    same = keyed["doc_id"].cast("bigint").eqNullSafe(kept["_id"]) & (keyed["_text"] == kept["_key"])
    out = keyed.join(kept.hint("merge"), same)
    if kept.where("_more").limit(1).count():
        out = out.where("not _more").unionByName(out.where("_more").dropDuplicates(["_id", "_key"]))
    return out.select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked, and their new length."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture."""
    return mixing.mixed_documents(
        docs, budget_share=MIXED_SHARE, max_epochs=1, weights={"lang": mixing.LANGUAGE_WEIGHTS}
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


_scratch = Scratch()


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.clear(spark)
        with _scratch:
            return work(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _stage(keep_good)),
    ("n-gram Jaccard join", _stage(keep_one_of_near_duplicates)),
    ("PII", _stage(mask_personal_data)),
    ("mixing sources to target weights", _stage(mix_sources)),
    ("packing", _stage(pack_sequences)),
]
# near duplicates, EM and tokens have no SQL; tests hold the stages against plain computations
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
