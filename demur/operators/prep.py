"""Projection, cleaning, encoding, imputation and scaling.

Fitted steps follow one pattern: ``fit_*(df, ...)`` returns a small parameter object found on one part
of the data, ``apply(df)`` is a row-local expression (or a size-aware join) for any part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from demur.operators.order import exact_rank, group_spans, order_statistics
from demur.session import num_lit, quoted

# Most categories that become one column each.
MAX_ONEHOT = 2_000


# --- projection and type selection ----------------------------------------------------------
def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def split_features_target(df: DataFrame, target: str) -> DataFrame:
    """Features and ``y`` stay in one table, so they can never lose their alignment."""
    return df.withColumnRenamed(target, "y")


def select_by_type(df: DataFrame, skip: list[str] = ()) -> tuple[list[str], list[str]]:
    """``(categorical, numeric)`` columns: strings and booleans against the rest."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    categorical = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    return categorical, [f.name for f in fields if f.name not in categorical]


def type_by_cardinality(df: DataFrame, columns: list[str], most: int = 4) -> dict[str, str]:
    """``categorical`` for at most ``most`` distinct non-null values, else ``continuous``.

    Steps up through the smallest values of all columns at once: ``most + 1`` aggregates without a
    shuffle of values, instead of a full distinct.
    """
    seen = dict.fromkeys(columns, 0)
    last: dict[str, object] = {}
    open_columns = list(columns)
    for _ in range(most + 1):
        if not open_columns:
            break
        nxt = df.agg(
            *[
                F.min(F.when(F.col(quoted(c)) > F.lit(last[c]), F.col(quoted(c))) if c in last else F.col(quoted(c))).alias(c)
                for c in open_columns
            ]
        ).first()
        for c in list(open_columns):
            if nxt[c] is None:
                open_columns.remove(c)
            else:
                seen[c] += 1
                last[c] = nxt[c]
    return {c: "categorical" if seen[c] <= most else "continuous" for c in columns}


# --- nulls, filters, membership ------------------------------------------------------------
def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def fill_constant(df: DataFrame, columns: list[str], value=0) -> DataFrame:
    return df.na.fill(value, columns)


def sentinel_to_null(df: DataFrame, sentinel: str = "?") -> DataFrame:
    """The sentinel in any string column -> NULL, after trimming."""
    changed = {
        f.name: F.when(F.trim(quoted(f.name)) == sentinel, None).otherwise(F.trim(quoted(f.name)))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(changed) if changed else df


def contains_pattern(column: Column, pattern: str) -> Column:
    """Regex search; NULL counts as false."""
    return F.coalesce(column.rlike(pattern), F.lit(False))


def only_first_missing(a: Column, b: Column) -> Column:
    """a is missing while b is not."""
    return a.isNull() & b.isNotNull()


def in_list(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value occurs in the other column."""
    values = other.select(F.col(other_column).alias("_v")).distinct()
    return df.join(values, F.col(column) == F.col("_v"), "left_semi")


def not_in_list(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value does not occur in the other column; a missing value counts as not in."""
    values = other.select(F.col(other_column).alias("_v")).distinct()
    return df.join(values, F.col(column) == F.col("_v"), "left_anti")


def column_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two columns are equal; two nulls are not."""
    return df.groupBy(F.coalesce(F.col(a) == F.col(b), F.lit(False)).alias("agree")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- targets and encodings -----------------------------------------------------------------
def binary_target(condition: Column) -> Column:
    return condition.cast("int")


def shift_label(column: Column) -> Column:
    """Classes from 1 -> classes from 0."""
    return column - 1


def flags_to_label(flags: list[str]) -> Column:
    """No flag -> 0, exactly one -> its position from 1, several -> NULL."""
    total = F.expr(" + ".join(quoted(f) for f in flags))
    which = F.array_position(F.array(*[F.col(quoted(f)) for f in flags]), 1)
    return F.when(total > 1, None).when(total == 0, 0).otherwise(which).cast("int")


def encode_ordinal(column: Column, ordered: list[str]) -> Column:
    """Position in an ordered list from 0; NULL outside of it."""
    return (F.nullif(F.array_position(F.array(*[F.lit(v) for v in ordered]), column), F.lit(0)) - 1).cast("int")


def encode_dict(df: DataFrame, maps: dict[str, dict]) -> DataFrame:
    """Maps values by column to codes; unmapped values stay, as text."""
    changed = {}
    for name, mapping in maps.items():
        table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (str(k), str(v))])
        text = F.col(quoted(name)).cast("string")
        changed[name] = F.coalesce(F.try_element_at(table, text), text)
    return df.withColumns(changed)


def encode_flag(column: Column, true_value: str = "t") -> Column:
    """The given text is true; everything else, NULL too, is false."""
    return F.coalesce(column == true_value, F.lit(False))


def encode_label(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Adds codes 0.. by sorted distinct value, found on all rows.

    The codes come from a ranged rank of the distinct values; the join back is left to the adaptive
    planner, which broadcasts the codes by their measured size or splits hot values.
    """
    values = df.select(F.col(column).alias("_v")).where("_v is not null").distinct()
    codes = exact_rank(values, ["_v"], name="_rank").select("_v", (F.col("_rank") - 1).alias(code))
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v")


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct non-null values; their number is checked."""
    rows = df.select(quoted(column)).where(F.col(quoted(column)).isNotNull()).distinct().limit(MAX_ONEHOT + 1).collect()
    if len(rows) > MAX_ONEHOT:
        raise ValueError(f"{column} has more than {MAX_ONEHOT} categories: use encode_label for it")
    return sorted(r[0] for r in rows)


@dataclass
class OneHot:
    """0/1 columns for the categories of the fit split; unseen values are 0 everywhere."""

    values: dict[str, list] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> OneHot:
        return cls({c: categories(df, c) for c in columns})

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.values.items() for v in vs]

    def apply(self, df: DataFrame) -> DataFrame:
        new = {
            f"{c}_{v}": F.coalesce(F.col(quoted(c)) == F.lit(v), F.lit(False)).cast("int")
            for c, vs in self.values.items()
            for v in vs
        }
        return df.withColumns(new).drop(*self.values)


# --- imputation ----------------------------------------------------------------------------
def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of several columns together, without gathering their values anywhere."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("g"), F.col(quoted(c)).cast("double").alias("v")) for c in columns])
        ).alias("e")
    ).select("e.g", "e.v").where("v is not null and not isnan(v)")
    long = long.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        spans = group_spans(long)
        middle = {g: [(n + 1) // 2, n // 2 + 1] for g, (_, _, n) in spans.items()}
        stats = order_statistics(long, middle, spans=spans)
    finally:
        long.unpersist()
    return {g: (stats[(g, a)].value + stats[(g, b)].value) / 2 for g, (a, b) in middle.items()}


def exact_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value by column; ties go to the smallest."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("g"), F.col(quoted(c)).cast("string").alias("v")) for c in columns])
        ).alias("e")
    ).select("e.g", "e.v").where("v is not null")
    best = (
        long.groupBy("g", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("g")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
    )
    return {r["g"]: r["b"]["v"] for r in best.collect()}


@dataclass
class Imputer:
    values: dict[str, object] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        new = {}
        for c, v in self.values.items():
            fill = F.lit(v).cast(kinds[c]) if kinds[c] in ("string", "boolean") else F.lit(v)
            new[c] = F.coalesce(F.col(quoted(c)), fill)
        return df.withColumns(new)


def impute_median(df: DataFrame, columns: list[str]) -> Imputer:
    return Imputer(exact_medians(df, columns))


def impute_mode(df: DataFrame, columns: list[str]) -> Imputer:
    return Imputer(exact_modes(df, columns))


# --- scaling -------------------------------------------------------------------------------
@dataclass
class Scaler:
    """Standardises chosen columns by mean and population deviation; a deviation of 0 counts as 1.

    A column without any value stays NULL.
    """

    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None) -> Scaler:
        columns = columns or [c for c in df.columns if c not in ("row_id", "y", "split")]
        aggs = []
        for i, c in enumerate(columns):
            aggs += [F.avg(quoted(c)).alias(f"m{i}"), F.stddev_pop(quoted(c)).alias(f"s{i}")]
        r = df.agg(*aggs).first()
        return cls({c: (r[f"m{i}"], r[f"s{i}"] or 1.0) for i, c in enumerate(columns)})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: F.lit(None).cast("double") if m is None else F.expr(f"({quoted(c)} - {num_lit(m)}) / {num_lit(s)}")
                for c, (m, s) in self.stats.items()
            }
        )


# --- the generic preprocessor --------------------------------------------------------------
@dataclass
class Preprocessor:
    """Numeric columns: median and scale. Categorical columns: mode and one-hot. Fitted on one split."""

    medians: Imputer
    scaler: Scaler
    modes: Imputer
    onehot: OneHot

    @classmethod
    def fit(cls, df: DataFrame, skip: list[str] = ("row_id", "y", "split")) -> Preprocessor:
        cat, num = select_by_type(df, skip)
        medians = impute_median(df, num) if num else Imputer()
        scaler = Scaler.fit(medians.apply(df), num) if num else Scaler()
        modes = impute_mode(df, cat) if cat else Imputer()
        onehot = OneHot.fit(modes.apply(df), cat) if cat else OneHot()
        return cls(medians, scaler, modes, onehot)

    @property
    def features(self) -> list[str]:
        return list(self.scaler.stats) + self.onehot.names()

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.scaler.apply(self.medians.apply(df)) if self.scaler.stats else df
        return self.onehot.apply(self.modes.apply(out)) if self.onehot.values else out
