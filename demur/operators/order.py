"""Exact order statistics and ranks that never sort a table in one task.

``order_statistics`` narrows value intervals with small histograms until each wanted order statistic
is found: a few passes of map-side combined counts, no shuffle of rows.
``ordered_cuts`` turns them into cuts ``(key, row_id)`` that split a table exactly after its first k rows.
``exact_rank`` is for the rarer case in which every row needs its rank: one range shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from demur.session import cut_lineage, small_table

# Histogram cells per pass over all open intervals; bounds what the driver receives.
CELLS_PER_PASS = 32_768
# Once the open intervals hold no more rows than this, their values are counted one by one.
DIRECT_ROWS = 100_000


# Doubles that span more powers of two than this are cut by their logarithm, others by their value.
OCTAVES = 4.0


class Statistic(NamedTuple):
    value: float | int
    below: int
    equal: int


class Cut(NamedTuple):
    """First k rows = ``key < key_cut or (key = key_cut and row_id <= id_cut)``; None id = all ties."""

    k: int
    key: int | None
    row_id: int | None


def group_spans(rows: DataFrame, group: str = "g", value: str = "v") -> dict[str, tuple]:
    """``(min, max, count)`` of the non-null values by group."""
    spans = (
        rows.where(F.col(value).isNotNull())
        .groupBy(F.col(group).alias("g"))
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    return {r["g"]: (r["lo"], r["hi"], r["n"]) for r in spans.collect()}


def _octave(v: float) -> float:
    """Place of a double on a scale of powers of two that runs through zero; infinities and NaN at its ends."""
    if math.isnan(v):
        return 2101.0
    if v == 0:
        return 0.0
    return math.copysign(2100.0 if math.isinf(v) else math.log2(abs(v)) + 1075.0, v)


_OCTAVE_SQL = "if(v = 0, 0D, signum(v) * least(log2(abs(v)) + 1075, 2100D))"


def _scale(lo: float | int, hi: float | int) -> tuple[bool, float, float]:
    """Whether a span is cut on the other scale, and its ends there.

    For doubles that is the scale of powers of two, for whole numbers their difference as doubles, which
    cannot overflow. Either narrows a span at once to one that the plain difference cuts evenly.
    """
    if isinstance(lo, int):
        wide = hi - lo >= 2**63
        return wide, float(lo) if wide else 0.0, float(hi) if wide else float(hi - lo)
    a, b = _octave(lo), _octave(hi)
    wide = b - a > OCTAVES
    return wide, a if wide else 0.0, b if wide else hi - lo


def order_statistics(
    rows: DataFrame,
    targets: dict[str, Iterable[int]],
    group: str = "g",
    value: str = "v",
    spans: dict[str, tuple] | None = None,
) -> dict[tuple[str, int], Statistic]:
    """k-th smallest ``value`` (1-based) by group, for a bounded set of groups and targets.

    Every pass counts the rows of each open interval in equal-width cells; the next interval is the
    span of the values really seen in the cell that holds the target, so ties end the search at once.
    Wide intervals are cut on a scale of their own first (see ``_scale``), so a pass gains the logarithm of
    its cells in bits whatever the values' spread. NaN is above all other doubles.
    """
    spark = rows.sparkSession
    is_long = dict(rows.dtypes)[value] == "bigint"
    arrow = pa.int64() if is_long else pa.float64()
    rows = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")

    found: dict[tuple[str, int], Statistic] = {}
    todo: dict[tuple, list] = {}
    spans = spans or group_spans(rows)
    for g, ks in targets.items():
        for k in set(ks):
            lo, hi, n = spans.get(g, (None, None, 0))
            if not 1 <= k <= n:
                raise ValueError(f"group {g!r} has no {k}-th value")
            todo.setdefault((g, lo, hi, 0, n), []).append(k)

    while True:
        open_spans = {}
        for span, ks in todo.items():
            g, lo, hi, below, n = span
            if lo == hi or lo != lo:  # one value, or NaN alone
                for k in ks:
                    found[(g, k)] = Statistic(lo, below, n)
            else:
                open_spans[span] = ks
        if not open_spans:
            break
        order = list(open_spans)
        cells = max(16, CELLS_PER_PASS // len(order))
        direct = sum(s[4] for s in order) <= DIRECT_ROWS
        scales = [_scale(s[1], s[2]) for s in order]
        spans_df = small_table(
            spark,
            {
                "g": [s[0] for s in order],
                "i": list(range(len(order))),
                "lo": [s[1] for s in order],
                "hi": [s[2] for s in order],
                "wide": [w for w, _, _ in scales],
                "first": [a for _, a, _ in scales],
                "width": [(b - a) / cells or 5e-324 for _, a, b in scales],
            },
            pa.schema(
                [
                    ("g", pa.string()),
                    ("i", pa.int32()),
                    ("lo", arrow),
                    ("hi", arrow),
                    ("wide", pa.bool_()),
                    ("first", pa.float64()),
                    ("width", pa.float64()),
                ]
            ),
        )
        # the intervals of a group are disjoint, so a row meets at most one of them
        hits = rows.join(F.broadcast(spans_df), "g").where("v between lo and hi")
        wide = "cast(v as double)" if is_long else _OCTAVE_SQL
        place = f"if(wide, {wide} - first, cast(v - lo as double)) / width"
        cell = f"if(v = hi, {cells - 1}, cast(floor(least({cells - 1}D, {place})) as int))"
        counts = (
            hits.select("i", "v", F.expr("v" if direct else cell).alias("cell"))
            .groupBy("i", "cell")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .toArrow()
            .sort_by([("i", "ascending"), ("cell", "ascending")])
        )
        by_span: dict[int, list] = {}
        for i, *r in zip(*(counts.column(c).to_pylist() for c in ("i", "lo", "hi", "n"))):
            by_span.setdefault(i, []).append(r)
        todo = {}
        for i, span in enumerate(order):
            g, _, _, below, _ = span
            waiting = sorted(open_spans[span])
            for lo, hi, n in by_span[i]:
                while waiting and waiting[0] <= below + n:
                    todo.setdefault((g, lo, hi, below, n), []).append(waiting.pop(0))
                below += n
    return found


def ordered_cuts(
    rows: DataFrame, wanted: Callable[[str, int], Iterable[int]]
) -> tuple[dict[str, int], dict[tuple[str, int], Cut]]:
    """Group sizes, and cuts after the first k rows in the order ``(key, row_id)`` by group ``g``.

    ``rows``: ``g string, key bigint, row_id bigint``, unique by (g, row_id).
    ``wanted(group, size)`` names the k of each group.
    """
    spans = group_spans(rows, value="key")
    sizes = {g: n for g, (_, _, n) in spans.items()}
    cuts: dict[tuple[str, int], Cut] = {}
    inner: dict[str, list[int]] = {}
    for g, n in sizes.items():
        for k in set(wanted(g, n)):
            if k <= 0:
                cuts[(g, k)] = Cut(0, None, None)
            elif k >= n:
                cuts[(g, k)] = Cut(n, 2**63 - 1, None)
            else:
                inner.setdefault(g, []).append(k)
    if not inner:
        return sizes, cuts
    stats = order_statistics(rows, inner, value="key", spans=spans)
    ties = {}
    for (g, k), s in stats.items():
        if s.below + s.equal == k:
            cuts[(g, k)] = Cut(k, s.value, None)
        else:
            ties[(g, k)] = s
    if ties:
        spark = rows.sparkSession
        heavy: dict[tuple, str] = {}
        for (g, _), s in ties.items():
            heavy.setdefault((g, s.value), str(len(heavy)))
        marks = small_table(
            spark,
            {
                "g": [g for g, _ in heavy],
                "key": [v for _, v in heavy],
                "tie": list(heavy.values()),
            },
            pa.schema([("g", pa.string()), ("key", pa.int64()), ("tie", pa.string())]),
        )
        tied = rows.join(F.broadcast(marks), ["g", "key"]).select("tie", "row_id")
        places: dict[str, list[int]] = {}
        for (g, k), s in ties.items():
            places.setdefault(heavy[(g, s.value)], []).append(k - s.below)
        ids = order_statistics(tied, places, group="tie", value="row_id")
        for (g, k), s in ties.items():
            cuts[(g, k)] = Cut(k, s.value, ids[(heavy[(g, s.value)], k - s.below)].value)
    return sizes, cuts


def before_cut(key: str, row_id: str, cut: Cut) -> str:
    """SQL condition: the row is among the first k."""
    if cut.key is None:
        return "false"
    if cut.row_id is None:
        return f"({key} <= {cut.key}L)"
    return f"({key} < {cut.key}L or ({key} = {cut.key}L and {row_id} <= {cut.row_id}L))"


def method_cuts(
    scored: DataFrame, keys: dict[str, Column], rates: Iterable[float], row_id: str = "row_id"
) -> tuple[int, dict[tuple[str, float], Cut]]:
    """Cut of every (method, rate) cell: the first ``floor(rate * n)`` rows by ``(key, row_id)``.

    Works on a narrow projection that is cached for the passes and released before the return.
    """
    rates = list(rates)
    narrow = scored.select(
        F.col(row_id).alias("row_id"),
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("g"), k.alias("key")) for m, k in keys.items()])
        ).alias("e"),
    ).select("row_id", "e.g", "e.key")
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes, cuts = ordered_cuts(narrow, lambda g, n: [math.floor(r * n) for r in rates])
    finally:
        narrow.unpersist()
    if not sizes:  # an empty table has nothing to reject
        return 0, {(m, r): Cut(0, None, None) for m in keys for r in rates}
    n = next(iter(sizes.values()))
    return n, {(m, r): cuts[(m, math.floor(r * n))] for m in keys for r in rates}


# ---------------------------------------------------------------------------------------------
ROWS_PER_RANGE = 2_000_000
_POSITION_BITS = 33


def exact_rank(
    df: DataFrame, order: list[str | Column], group: str | None = None, name: str = "rank"
) -> DataFrame:
    """Adds the 1-based rank of every row in a total order (``order`` must be unique by row).

    One range shuffle on (group, order): ties and hot groups are spread, as the last order column
    tells rows apart. The ranged rows are checkpointed, so counts and positions belong to one layout.
    """
    spark = df.sparkSession
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = df.count()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(width, n // 10_000), math.ceil(n / ROWS_PER_RANGE))
    cols = ([F.col(group).asc_nulls_last()] if group else []) + list(order)
    ranged = (
        df.repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = cut_lineage(ranged)
    df.unpersist()
    part = F.shiftright("_at", _POSITION_BITS)
    local = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    totals = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, seen = [], 0
    for p in range(max(totals, default=-1) + 1):
        starts.append(seen)
        seen += totals.get(p, 0)
    offsets = small_table(
        spark,
        {"_p": list(range(len(starts))), "_start": starts},
        pa.schema([("_p", pa.int64()), ("_start", pa.int64())]),
    )
    out = (
        ranged.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_start") + local + 1)
    )
    if group:
        sizes = sorted(
            ((r[group], r["n"]) for r in ranged.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()),
            key=lambda t: (t[0] is None, t[0]),
        )
        before, acc = [], 0
        for _, c in sizes:
            before.append(acc)
            acc += c
        by_group = small_table(
            spark,
            {"_g": [g for g, _ in sizes], "_before": before},
            pa.schema([("_g", _arrow_type(ranged, group)), ("_before", pa.int64())]),
        )
        out = out.join(F.broadcast(by_group), F.col(group).eqNullSafe(F.col("_g"))).withColumn(
            name, F.col(name) - F.col("_before")
        ).drop("_g", "_before")
    return out.drop("_at", "_p", "_start")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    kind = dict(df.dtypes)[column]
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[kind]
