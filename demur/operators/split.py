"""Seeded splits, folds and oversampling by hash order.

The order of rows is that of ``md5('<seed>-<row_id>')``, so every split is repeatable on any cluster.
Cuts are exact order statistics of that hash: a class that holds most of the rows is never sorted in
one task, and only ``fold_assign`` needs a rank for every row.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from demur.operators.order import exact_rank, ordered_cuts
from demur.session import small_table

# The four parts, a quarter each.
PARTS = ("T", "T_lambda", "DSEL", "G")
# Copies of one row that one task makes without a shuffle.
COPIES_PER_BLOCK = 10_000


def hash_order(seed: int, row_id: str = "row_id") -> Column:
    """60-bit position of a row in the shuffled order."""
    return F.expr(f"cast(conv(substr(md5(concat('{seed}-', {row_id})), 1, 15), 16, 10) as bigint)")


def split_four_way(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """Adds ``split``: quarters of the hash space. Row-local."""
    bucket = F.expr(
        f"pmod(cast(conv(substr(md5(concat('{seed}-', {row_id})), 1, 8), 16, 10) as bigint), 10000) div 2500"
    )
    return df.withColumn("split", F.element_at(F.array(*[F.lit(p) for p in PARTS]), bucket.cast("int") + 1))


def _group(y: str | None) -> Column:
    """Class as text; rows without a class form one of their own."""
    return F.lit("all") if y is None else F.coalesce(F.col(y).cast("string"), F.lit("no class"))


def _class_cuts(df: DataFrame, y: str | None, seed: int, counts) -> DataFrame:
    """Adds ``_h`` and, by class, the cut columns ``_k{i}``/``_id{i}`` for ``counts(n) -> list of k``."""
    spark = df.sparkSession
    rows = df.withColumn("_h", hash_order(seed)).withColumn("_g", _group(y))
    # the passes of the search read a narrow copy, which is released at once
    narrow = rows.select(F.col("_g").alias("g"), F.col("_h").alias("key"), "row_id")
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes, cuts = ordered_cuts(narrow, counts)
    finally:
        narrow.unpersist()
    if not sizes:  # an empty table: cuts that take no row
        none = range(len(counts("", 1)))
        return rows.withColumns({f"_{c}{i}": F.lit(-1).cast("bigint") for i in none for c in ("k", "id")})
    columns: dict[str, list] = {"_g": list(sizes)}
    fields = [("_g", pa.string())]
    width = max(len(counts(g, n)) for g, n in sizes.items())
    for i in range(width):
        picked = [cuts[(g, counts(g, n)[i])] for g, n in sizes.items()]
        columns[f"_k{i}"] = [-1 if c.key is None else c.key for c in picked]
        columns[f"_id{i}"] = [2**63 - 1 if c.row_id is None else c.row_id for c in picked]
        fields += [(f"_k{i}", pa.int64()), (f"_id{i}", pa.int64())]
    if y is None:
        return rows.withColumns({c: F.lit(v[0]).cast("bigint") for c, v in columns.items() if c != "_g"})
    cut_table = small_table(spark, columns, pa.schema(fields))
    return rows.join(F.broadcast(cut_table), "_g")


def _first(i: int) -> str:
    """The row lies among the first k of cut i; hashes are not negative, so -1 takes none."""
    return f"(_h < _k{i} or (_h = _k{i} and row_id <= _id{i}))"


def split_random(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Adds ``is_test``: the first ``ceil(n * fraction)`` rows of the shuffled order."""
    rows = _class_cuts(df, None, seed, lambda g, n: [math.ceil(n * fraction)])
    return rows.withColumn("is_test", F.expr(_first(0))).drop("_g", "_h", "_k0", "_id0")


def split_stratified(df: DataFrame, fraction: float, seed: int, y: str = "y") -> DataFrame:
    """Adds ``is_test``: the first ``floor(count * fraction)`` rows of every class."""
    rows = _class_cuts(df, y, seed, lambda g, n: [math.floor(n * fraction)])
    return rows.withColumn("is_test", F.expr(_first(0))).drop("_g", "_h", "_k0", "_id0")


def split_stratified_four_way(df: DataFrame, seed: int, y: str = "y") -> DataFrame:
    """Adds ``split``: quarters of every class."""
    rows = _class_cuts(df, y, seed, lambda g, n: [math.floor(n * q / 4) for q in (1, 2, 3)])
    split = F.expr(
        f"case when {_first(0)} then '{PARTS[0]}' when {_first(1)} then '{PARTS[1]}'"
        f" when {_first(2)} then '{PARTS[2]}' else '{PARTS[3]}' end"
    )
    drop = ["_g", "_h"] + [f"_{c}{i}" for i in range(3) for c in ("k", "id")]
    return rows.withColumn("split", split).drop(*drop)


def sample_stratified(df: DataFrame, fraction: float, seed: int, y: str = "y") -> DataFrame:
    """Keeps ``floor(count * fraction)`` rows of every class."""
    return split_stratified(df, fraction, seed, y).where("is_test").drop("is_test")


def oversample(df: DataFrame, seed: int, y: str = "y") -> DataFrame:
    """Repeats the rows of the smaller classes up to the count of the largest; adds ``copy`` from 1.

    With c rows in a class and m in the largest, every row comes ``m div c`` times and the first
    ``m mod c`` of the hash order once more.
    """
    sizes = {r["g"]: r["count"] for r in df.groupBy(_group(y).alias("g")).count().collect()}
    top = max(sizes.values(), default=0)
    rows = _class_cuts(df, y, seed, lambda g, n: [top % n])
    whole = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(top // n))])
    times = whole[F.col("_g")] + F.expr(f"cast({_first(0)} as int)")
    rows = rows.withColumn("_times", times).drop("_g", "_h", "_k0", "_id0")
    # copies are made in blocks; many copies of few rows are spread over the tasks first
    rows = rows.withColumn("_block", F.explode(F.expr(f"sequence(0, (_times - 1) div {COPIES_PER_BLOCK})")))
    if sizes and top // min(sizes.values()) > COPIES_PER_BLOCK:
        rows = rows.repartition("row_id", "_block")
    copies = f"sequence(_block * {COPIES_PER_BLOCK} + 1, least(_times, (_block + 1) * {COPIES_PER_BLOCK}))"
    rows = rows.withColumn("copy", F.explode(F.expr(copies))).drop("_times", "_block")
    return rows.withColumn("copy", F.col("copy").cast("int"))


def fold_count(n: int) -> int:
    """10 folds for more than 500 rows, else 5."""
    return 10 if n > 500 else 5


def fold_assign(df: DataFrame, seed: int, y: str = "y", folds: int | None = None) -> DataFrame:
    """Adds ``fold`` 0..k-1, dealt within every class in hash order."""
    k = folds or fold_count(df.count())
    ranked = exact_rank(df.withColumn("_h", hash_order(seed)), ["_h", "row_id"], group=y, name="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_h", "_rank")
