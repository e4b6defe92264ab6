"""Descriptions of tables and columns."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.session import quoted, settle, small_table

# tasks get the kernels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, most frequent first; nulls are left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentage of all rows; nulls count in the divisor only."""
    total = df.count()
    return value_counts(df, column).withColumn("percent", F.col("n") * 100.0 / F.lit(total))


def distinct_count(df: DataFrame, columns: list[str]) -> DataFrame:
    return _cells(df, columns).groupBy("column_name").agg(F.count("v").alias("n_distinct"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, NULL among them if it occurs."""
    return df.select(F.col(column).alias("value")).distinct()


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by (column, value as text): one pass for all columns, combined before the shuffle."""
    kinds = dict(df.dtypes)
    # 0.0 and -0.0 are one value
    value = {c: F.col(quoted(c)) + F.lit(0).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(quoted(c)) for c in columns}
    parts = [F.struct(F.lit(c).alias("column_name"), value[c].cast("string").alias("v")) for c in columns]
    return (
        df.select(F.explode(F.array(*parts)).alias("e"))
        .groupBy("e.column_name", "e.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def table_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """By column: type, distinct values, nulls and rows."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    type_map = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return (
        _cells(df, columns)
        .groupBy("column_name")
        .agg(
            F.count("v").alias("n_distinct"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
            F.sum("n").alias("n_rows"),
        )
        .withColumn("data_type", type_map[F.col("column_name")])
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bin counts between minimum and maximum; the last bin is closed, empty bins are kept."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).cast("int"))
    counts = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = small_table(
        df.sparkSession,
        {"bin": list(range(bins)), "low": [lo + i * width for i in range(bins)]},
        pa.schema([("bin", pa.int32()), ("low", pa.float64())]),
    )
    return edges.join(counts, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n"))


def all_true(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(column), F.lit(True)).alias("all_true"))


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


# --- Kendall tau-b -------------------------------------------------------------------------
# A column of no more values has a code for each; others are cut into ranges of about RANGE_ROWS rows.
FEW_VALUES, RANGE_ROWS, LEAST_CUTS = 256, 50_000, 128
# Cells of all pairs that the driver adds up, and keys that a task holds before it counts them.
GRID_CELLS, HELD_KEYS = 4_000_000, 1_000_000


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of doubles as rows of a matrix; -0.0 becomes 0.0."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) + 0.0


def _codes(v: np.ndarray, cuts: np.ndarray, few: bool) -> np.ndarray:
    """Number of a value, from 1; or of its range: odd for the cuts themselves, even for what lies between them."""
    at = np.searchsorted(cuts, v, "left")
    return at + 1 if few else 2 * at + (cuts[np.minimum(at, len(cuts) - 1)] == v)


def _tied_pairs(counts: np.ndarray) -> int:
    return int((counts.astype(np.int64) * (counts.astype(np.int64) - 1) // 2).sum())


def _concordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x and y both smaller in the same row: in the order of y, bit by bit of the ranks of x."""
    values, rank = np.unique(x, return_inverse=True)
    # equal y stand by falling x, so they make no pair
    rank = rank[np.lexsort((-rank, y))]
    total, place = 0, np.arange(len(rank))
    for bit in range((len(values) - 1).bit_length() - 1, -1, -1):
        # rows of one group share the higher bits and keep the order of y
        first = np.flatnonzero(np.diff(rank >> (bit + 1), prepend=-1))
        size = np.diff(first, append=len(rank))
        one = (rank >> bit) & 1
        zeros = np.cumsum(1 - one)
        start = np.repeat(first, size)
        before = zeros - (1 - one) - np.repeat((zeros - (1 - one))[first], size)
        total += int((before * one).sum())
        inside = np.repeat(np.add.reduceat(1 - one, first), size)
        to = start + np.where(one == 1, inside + place - start - before, before)
        moved = np.empty_like(rank)
        moved[to] = rank
        rank = moved
    return total


def _equal_rows(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs of rows with equal x and equal y."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
    return _tied_pairs(np.diff(new, append=len(x)))


def _known_values(clean: DataFrame, width: int, few: int) -> tuple[int, list[np.ndarray | None]]:
    """Rows, and the values of each column in order; none where there are more than ``few``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, [np.zeros(0)] * width
        for batch in batches:
            n += batch.num_rows
            for c, v in enumerate(_values(batch)):
                if len(seen[c]) <= few:
                    seen[c] = np.unique(np.concatenate([seen[c], v]))[: few + 1]
        counts = [n] + [0] * (width - 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(counts, pa.int64()), pa.array(seen, pa.list_(pa.float64()))], names=["c", "n", "v"])

    found = clean.mapInArrow(run, "c int, n bigint, v array<double>")
    values = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))), 1, few + 1)
    n, out = 0, [np.zeros(0)] * width
    for r in found.groupBy("c").agg(F.sum("n").alias("n"), values.alias("v")).collect():
        n += r["n"]
        out[r["c"]] = np.array(r["v"], dtype=float) if len(r["v"]) <= few else None
    return n, out


def _grid(clean: DataFrame, cuts: list[np.ndarray], few: list[bool], sides: list[tuple[int, int]]) -> DataFrame:
    """``p, i, j, w``: rows by pair of columns and codes of both; tasks count before the shuffle."""
    most = 2 * max(len(c) for c in cuts) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, n = [], 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            more, how_often = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            out = np.zeros(len(both), np.int64)
            np.add.at(out, at, np.concatenate([times, how_often]))
            return both, out

        for batch in batches:
            codes = [_codes(v, c, f) for v, c, f in zip(_values(batch), cuts, few)]
            for p, (a, b) in enumerate(sides):
                held.append((p * most + codes[a]) * most + codes[b])
                n += batch.num_rows
            if n > HELD_KEYS:
                keys, times = counted()
                held, n = [], 0
        if held:
            keys, times = counted()
        p, i, j = keys // (most * most), keys // most % most, keys % most
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(times)], names=["p", "i", "j", "w"])

    return clean.mapInArrow(run, "p int, i int, j int, w bigint").groupBy("p", "i", "j").agg(F.sum("w").alias("w"))


def _inside(clean: DataFrame, cuts: list[np.ndarray], few: list[bool], pairs: list[tuple[int, int]]) -> dict[tuple[str, int], int]:
    """Sums over the ranges of all columns: ``("ties", column)``, ``("both", pair)`` and ``("up", pair)``.

    A pair of rows in one range of the first column is counted there. In a range of the second column only those
    count that lie in different ranges of the first.
    """
    width = len(cuts)
    names = [f"v{c}" for c in range(width)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _values(batch)
            for c in range(width):
                if few[c] or not batch.num_rows:
                    continue
                code = _codes(v[c], cuts[c], False)
                own = np.flatnonzero(code % 2 == 0)
                head = [pa.array(np.full(len(own), c, np.int32)), pa.array(code[own].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(x[own]) for x in v]], names=["c", "r", *names])

    def count(table: pa.Table) -> pa.Table:
        c = table.column("c")[0].as_py()
        v = [table.column(k).to_numpy() for k in names]
        out = [("ties", c, _tied_pairs(np.unique(v[c], return_counts=True)[1]))]
        for p, (a, b) in enumerate(pairs):
            if a == c:
                out += [("up", p, _concordant(v[a], v[b])), ("both", p, _equal_rows(v[a], v[b]))]
            elif b == c:
                x = _codes(v[a], cuts[a], few[a])
                alone = np.ones(len(x), bool) if few[a] else x % 2 == 1
                out += [("up", p, _concordant(x, v[b])), ("both", p, _equal_rows(x[alone], v[b][alone]))]
        return pa.table([pa.array(x) for x in zip(*out)], names=["what", "k", "n"])

    columns = ", ".join(f"{k} double" for k in names)
    found = clean.mapInArrow(deal, f"c int, r int, {columns}").groupBy("c", "r").applyInArrow(count, "what string, k bigint, n bigint")
    return {(r["what"], r["k"]): r["n"] for r in found.groupBy("what", "k").agg(F.sum("n").alias("n")).collect()}


def kendall_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Kendall tau-b of all column pairs; rows with a null in any of the columns are removed.

    Concordant pairs are counted without making pairs. Each column has codes that keep its order: one by value, or
    of ranges between quantiles, where a value that many rows share is a range of its own. Pairs of rows whose codes
    differ in both columns follow from the counts by two codes, a table of bounded size. The rows of a range meet in
    one task, which counts the pairs within it.
    """
    spark = df.sparkSession
    schema = pa.schema([("col_a", pa.string()), ("col_b", pa.string()), ("n", pa.int64()), ("tau_b", pa.float64())])
    clean = df.na.drop("any", subset=columns).select(*[F.col(quoted(c)).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = list(itertools.combinations(range(len(columns)), 2))
    most = max(8, math.isqrt(GRID_CELLS // max(1, len(pairs))) // 2)
    n, cuts = _known_values(clean, len(columns), min(FEW_VALUES, 2 * most))
    if not n or not pairs:
        return small_table(spark, {k: [] for k in schema.names}, schema)
    few = [c is not None for c in cuts]
    wide = [f"v{i}" for i, f in enumerate(few) if not f]
    if wide:
        k = min(most, max(LEAST_CUTS, n // RANGE_ROWS))
        found = clean.agg(*[F.percentile_approx(v, [q / k for q in range(1, k)], 10 * k).alias(v) for v in wide]).first()
        cuts = [np.unique(np.array(found[f"v{i}"])) + 0.0 if c is None else c for i, c in enumerate(cuts)]
    sizes = [len(c) + 1 if f else 2 * len(c) + 1 for c, f in zip(cuts, few)]
    # the column of fewer codes comes first
    sides = [(a, b) if sizes[a] <= sizes[b] else (b, a) for a, b in pairs]
    names = [F.array(*[F.lit(columns[pair[side]]) for pair in pairs]) for side in (0, 1)]
    cells = _grid(clean, cuts, few, sides).select(*[x[F.col("p")].alias(k) for x, k in zip(names, ("col_a", "col_b"))], "p", "i", "j", "w")
    cells = settle(cells, "kendall").select("p", "i", "j", "w").toArrow().sort_by("p")
    p, i, j, w = (cells.column(k).to_numpy() for k in ("p", "i", "j", "w"))
    inside = _inside(clean, cuts, few, pairs) if wide else {}

    # codes of single values
    single = [np.ones(s, bool) if f else np.arange(s) % 2 == 1 for s, f in zip(sizes, few)]
    total, out = n * (n - 1) / 2, {k: [] for k in schema.names}
    for at, ((a, b), (first, second)) in enumerate(zip(pairs, sides)):
        own = slice(*np.searchsorted(p, [at, at + 1]))
        grid = np.zeros((sizes[first], sizes[second]), np.int64)
        grid[i[own], j[own]] = w[own]
        grid = grid if first == a else grid.T
        lower = np.cumsum(np.cumsum(grid, axis=0), axis=1)
        c = float((grid[1:, 1:] * lower[:-1, :-1]).sum()) + inside.get(("up", at), 0)
        tx, ty = (float(_tied_pairs(grid.sum(axis=1 - s)[single[v]]) + inside.get(("ties", v), 0)) for s, v in ((0, a), (1, b)))
        txy = float(_tied_pairs(grid[np.ix_(single[a], single[b])].ravel()) + inside.get(("both", at), 0))
        discordant = total - tx - ty + txy - c
        spread = math.sqrt((total - tx) * (total - ty))
        for k, v in zip(schema.names, (columns[a], columns[b], n, (c - discordant) / spread if spread > 0 else None)):
            out[k].append(v)
    return small_table(spark, out, schema)
