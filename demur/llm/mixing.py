"""Mixing sources to target weights with hierarchical budgets.

The tree is domain, language, source; its leaves are the distinct combinations. A node's budget is split
among its children by weight. A child that cannot use its share (its tokens times the number of epochs)
takes what it can, and the rest goes to its siblings by weight; only what no sibling can take leaves the
node, and then its own siblings share it. A leaf's budget is met with whole epochs of all its documents
and a prefix of one more, in an order seeded by leaf, epoch and document.

The tree has one row by leaf and its budgets are aggregates and small joins over it. Documents are never
sorted in one task: a leaf's hash range is cut into cells, cells are summed, and only the documents of
the one cell in which the budget ends are put in order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demur.llm.registry import query, stored, table
from demur.session import str_lit

# levels of the tree as expressions over the documents; sources numbered from 0 belong to four domains in turn
LEVELS = {
    "domain": "coalesce(concat('d', try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4), 'other')",
    "lang": "lang",
    "source": "source",
}
# about so many documents share a cell
CELL_ROWS = 256
MAX_EPOCHS = 4
SEED = 17
# weights of the languages; other names and other levels weigh the same (fixed values of the queries)
LANGUAGE_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def word_tokens(text_col: str = "text") -> Column:
    """Tokens of a text: its words. Null and empty texts have none."""
    return F.expr(
        f"cast(size(filter(split(coalesce(cast(`{text_col}` as string), ''), '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), x -> x <> '')) as bigint)"
    )


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> str:
    given = weights.get(level, {})
    if not given:
        return "1D"
    return "case " + level + " " + " ".join(f"when {str_lit(k)} then {float(v)}D" for k, v in given.items()) + " else 1D end"


def budgets(leaves: DataFrame, budget: float, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """Adds ``budget`` to a table of leaves (the levels and ``tokens``).

    Top down: a parent's budget is split over its children by weight, each child held to what its leaves
    can give. Children that fill up leave their rest to the others by weight. The order in which they fill
    up (room by weight) gives the final level in one pass: it is that of the first child that stays open.
    """
    names = [c for c in leaves.columns if c not in ("tokens", "docs")]
    df = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    room = df.agg(F.sum("cap").alias("cap")).first()["cap"] or 0.0
    df = df.withColumn("give", F.lit(float(min(budget, room))))
    path: list[str] = []
    for level in names:
        siblings = W.partitionBy(*path) if path else W.partitionBy(F.lit(0))
        path.append(level)
        nodes = df.groupBy(*path).agg(F.sum("cap").alias("node_cap"), F.max("give").alias("give"))
        nodes = nodes.withColumn("wt", F.expr(weight_of(level, weights)))
        before = siblings.orderBy(F.expr("node_cap / wt"), level).rowsBetween(W.unboundedPreceding, -1)
        nodes = nodes.withColumns(
            {
                "cap_before": F.coalesce(F.sum("node_cap").over(before), F.lit(0.0)),
                "wt_before": F.coalesce(F.sum("wt").over(before), F.lit(0.0)),
                "wt_all": F.sum("wt").over(siblings),
            }
        )
        nodes = nodes.withColumn("even", F.expr("greatest(give - cap_before, 0D) / greatest(wt_all - wt_before, 1e-12D)"))
        nodes = nodes.withColumn("full", F.expr("node_cap / wt <= even"))
        nodes = nodes.withColumn("water", F.max(F.expr("if(full, null, even)")).over(siblings))
        nodes = nodes.withColumn("share", F.expr("if(full or water is null, node_cap, least(node_cap, water * wt))"))
        df = df.drop("give").join(nodes.select(*path, F.col("share").alias("give")), path)
    return df.withColumnRenamed("give", "budget").drop("cap")


class Plan(NamedTuple):
    """``rows``: id, levels and tokens of every document; ``leaves``: budget and cut of every leaf."""

    rows: DataFrame
    leaves: DataFrame
    levels: dict[str, str]
    seed: int

    def order(self) -> str:
        """Place of a document in its leaf's next epoch."""
        return f"xxhash64({self.seed}, {', '.join(self.levels)}, whole, doc_id)"

    def decided(self, rows: DataFrame) -> DataFrame:
        """Adds ``epochs`` and ``leaf_budget`` to rows that have ``doc_id`` and the levels.

        The table of leaves is written before, so the planner knows its size and broadcasts it only below
        the session's limit.
        """
        df = rows.join(self.leaves, list(self.levels)).withColumn("u", F.expr(self.order()))
        prefix = "cut is not null and (u < cut.u or (u = cut.u and doc_id <= cut.doc_id))"
        return df.withColumn("epochs", F.expr(f"whole + if({prefix}, 1L, 0L)")).withColumnRenamed("budget", "leaf_budget")


def leaf_names(docs: DataFrame, levels: dict[str, str]) -> dict[str, Column]:
    """The levels as columns; a null name is a leaf of its own, '(none)'."""
    return {k: F.coalesce(F.expr(v).cast("string"), F.lit("(none)")) for k, v in levels.items()}


def plan_mix(
    docs: DataFrame,
    budget_share: float = 1.0,
    weights: dict[str, dict[str, float]] | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    levels: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Plan:
    """Budgets and cuts for a total of ``budget_share`` times the tokens of all documents.

    A leaf takes whole epochs and then, in the order of the next epoch, the documents up to the one with
    which its budget would be passed. Rows that share id and leaf have one place and are taken together.
    A leaf without tokens has no budget; an empty table has no leaf.
    """
    levels = levels or LEVELS
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            *(c.alias(k) for k, c in leaf_names(docs, levels).items()),
            word_tokens(text_col).alias("n_tokens"),
        ),
        "mix-rows",
    )
    names = list(levels)
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = leaves.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    leaves = budgets(leaves, budget_share * total, weights or {}, max_epochs)
    leaves = stored(
        leaves.withColumn("whole", F.expr("if(tokens > 0, cast(floor(budget / tokens + 1e-9D) as bigint), 0L)"))
        .withColumn("rest", F.expr("greatest(budget - whole * tokens, 0D)"))
        .withColumn("cells", F.expr(f"greatest(1L, cast(ceil(docs / {CELL_ROWS}) as bigint))"))
        .coalesce(1),
        "mix-leaves",
    )
    # a place's cell: its hash, made positive, in equal parts of its range
    placed = rows.join(leaves, names).withColumn("u", F.expr(Plan(rows, leaves, levels, seed).order()))
    placed = placed.withColumn("cell", F.expr("cast(least(cells - 1, floor((u / 18446744073709551616D + 0.5D) * cells)) as bigint)"))
    cells = placed.groupBy(*names, "cell", "rest").agg(F.sum("n_tokens").alias("n"))
    cells = cells.withColumn("upto", F.sum("n").over(W.partitionBy(*names).orderBy("cell")))
    ends = (
        cells.where("upto > rest")
        .groupBy(*names)
        .agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("n")).alias("before")), "cell").alias("end"))
    )
    last = placed.join(ends, names, "left").where("end is null or cell <= end.cell")
    inner = last.where("end is not null and cell = end.cell")
    inner = inner.groupBy(*names, "rest", "u", "doc_id", "end").agg(F.sum("n_tokens").alias("n"))
    inner = inner.withColumn("upto", F.sum("n").over(W.partitionBy(*names).orderBy("u", "doc_id")) + F.col("end.before"))
    taken = inner.where("upto <= rest").select(*names, F.struct("u", "doc_id").alias("at"))
    earlier = last.where("end is null or cell < end.cell").groupBy(*names).agg(F.max(F.struct("u", "doc_id")).alias("at"))
    cuts = taken.unionByName(earlier).groupBy(*names).agg(F.max("at").alias("cut"))
    leaves = stored(
        leaves.join(cuts, names, "left").select(*names, "budget", "whole", F.expr("if(rest > 0D, cut, null) as cut")).coalesce(1),
        "mix-cuts",
    )
    return Plan(rows, leaves, levels, seed)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, the levels, ``n_tokens``, ``epochs`` and ``leaf_budget`` for every row of the input.

    ``epochs`` is how many times the row belongs to the mixture; 0 leaves it out. Options: ``plan_mix``.
    """
    plan = plan_mix(docs, **options)
    return plan.decided(plan.rows).select("doc_id", *plan.levels, "n_tokens", "epochs", "leaf_budget")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The input's rows, each as many times as it belongs to the mixture, with the input's columns only."""
    plan = plan_mix(docs, id_col=id_col, **options)
    keys = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).alias("doc_id"),
        *(c.alias(k) for k, c in leaf_names(docs, plan.levels).items()),
    )
    times = plan.decided(keys).where("epochs > 0").select("row", F.explode(F.expr("sequence(1L, epochs)")))
    return times.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), weights={"lang": LANGUAGE_WEIGHTS})
