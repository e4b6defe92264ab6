"""Pool scoring and fusion rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.functions import fusion as fu
from demur.functions.scores import model_uncertainty, select_models
from demur.plans import views
from demur.plans.oracle_parts import EVENTS_P, ORDERS_P
from demur.plans.registry import query


def _scores_sql(agg: str) -> str:
    """Best class by an aggregate over the models, first class on ties."""
    return f"""{ORDERS_P}
SELECT row_id, y, c AS pred FROM (SELECT row_id, y, c, {agg} AS f FROM p GROUP BY row_id, y, c)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY f DESC, c) = 1"""


def _rule(scores):
    def run(spark, sf_dir):
        scored, _ = views.scored_orders(spark, sf_dir)
        return scored.select("row_id", "y", fu.decide(scores()).alias("pred"))

    return run


for _name, _fn, _agg in (
    ("fuse_sum", fu.fuse_sum, "round(sum(p), 9)"),
    ("fuse_product", fu.fuse_product, "list_reduce(list(p ORDER BY m), lambda a, b: a * b)"),
    ("fuse_max", fu.fuse_max, "max(p)"),
    ("fuse_min", fu.fuse_min, "min(p)"),
    ("fuse_median", fu.fuse_median, "round(median(p), 9)"),
):
    query(_scores_sql(_agg), name=_name)(_rule(_fn))


BORDA_SQL = """
SELECT row_id, y, c AS pred FROM (
  SELECT row_id, y, c, sum(r) AS f FROM (
    SELECT row_id, y, c, row_number() OVER (PARTITION BY row_id, m ORDER BY p, c) - 1 AS r FROM p)
  GROUP BY row_id, y, c)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY f DESC, c) = 1"""


@query(ORDERS_P + BORDA_SQL)
def fuse_borda(spark, sf_dir):
    return _rule(fu.fuse_borda)(spark, sf_dir)


@query(EVENTS_P + BORDA_SQL)
def fuse_borda_five_classes(spark, sf_dir):
    scored, _ = views.scored_events(spark, sf_dir)
    return scored.select("row_id", "y", fu.decide(fu.fuse_borda()).alias("pred"))


VOTES = """
, b AS (SELECT row_id, y, m, c AS pred FROM p QUALIFY row_number() OVER (PARTITION BY row_id, m ORDER BY p DESC, c) = 1)"""


@query(
    ORDERS_P
    + VOTES
    + """
SELECT row_id, y, pred FROM (SELECT row_id, y, pred, count(*) AS n FROM b GROUP BY row_id, y, pred)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pred) = 1"""
)
def fuse_majority(spark, sf_dir):
    scored, pool = views.scored_orders(spark, sf_dir)
    scored = pool.predict(scored)
    return scored.select("row_id", "y", fu.decide(fu.fuse_majority("preds", len(pool.labels))).alias("pred"))


@query(ORDERS_P + VOTES + " SELECT row_id, y, m AS model, pred FROM b")
def pool_predict(spark, sf_dir):
    scored, pool = views.scored_orders(spark, sf_dir)
    return pool.predict(scored).select("row_id", "y", F.posexplode("preds").alias("model", "pred"))


@query(ORDERS_P + " SELECT row_id, y, m AS model, c AS class, round(p, 6) AS p FROM p")
def pool_predict_proba(spark, sf_dir):
    scored, _ = views.scored_orders(spark, sf_dir)
    long = scored.select("row_id", "y", F.posexplode("probas").alias("model", "ps"))
    return long.select("row_id", "y", "model", F.posexplode("ps").alias("class", "p")).withColumn(
        "p", F.round("p", 6)
    )


@query(
    ORDERS_P
    + """
SELECT 'first_2' AS kind, row_id, c AS pred FROM (SELECT row_id, c, round(sum(p), 9) AS f FROM p WHERE m < 2 GROUP BY row_id, c)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY f DESC, c) = 1
UNION ALL
SELECT 'without_1' AS kind, row_id, c AS pred FROM (SELECT row_id, c, round(sum(p), 9) AS f FROM p WHERE m <> 1 GROUP BY row_id, c)
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY f DESC, c) = 1"""
)
def pool_subset(spark, sf_dir):
    """One scoring pass serves every smaller pool."""
    scored, pool = views.scored_orders(spark, sf_dir)
    first = pool.slice_probas(pool.first(2).names)
    rest = pool.slice_probas(pool.subset(drop=["nb_1"]).names)
    kinds = F.array(
        F.struct(F.lit("first_2").alias("kind"), first.alias("ps")),
        F.struct(F.lit("without_1").alias("kind"), rest.alias("ps")),
    )
    long = scored.select("row_id", F.explode(kinds).alias("k")).select("row_id", "k.kind", "k.ps")
    return long.select("kind", "row_id", fu.decide(fu.fuse_sum("ps")).alias("pred"))


SELECTION = """
, u AS (SELECT row_id, y, m, 1 - max(p) AS u FROM p GROUP BY row_id, y, m),
sel AS (SELECT row_id, m, u FROM u QUALIFY u <= avg(u) OVER (PARTITION BY row_id) + 1e-12)"""


@query(
    ORDERS_P
    + VOTES
    + SELECTION
    + """
SELECT g.row_id, g.c AS class,
  round(coalesce(v.n, 0) / t.n, 6) AS share
FROM (SELECT DISTINCT row_id, c FROM p) g
JOIN (SELECT row_id, count(*) AS n FROM sel GROUP BY row_id) t ON g.row_id = t.row_id
LEFT JOIN (SELECT b.row_id, b.pred, count(*) AS n FROM b JOIN sel ON b.row_id = sel.row_id AND b.m = sel.m
           GROUP BY b.row_id, b.pred) v ON g.row_id = v.row_id AND g.c = v.pred"""
)
def fuse_hard_share(spark, sf_dir):
    scored, pool = views.scored_orders(spark, sf_dir)
    rows = (
        pool.predict(scored)
        .withColumn("uncertainty", model_uncertainty())
        .withColumn("selected", select_models())
        .select("row_id", F.posexplode(fu.fuse_hard_share("preds", len(pool.labels), "selected")).alias("class", "share"))
    )
    return rows.withColumn("share", F.round("share", 6))


@query(
    ORDERS_P
    + SELECTION
    + """
SELECT p.row_id, p.c AS class, round(round(avg(p.p), 9), 6) AS p FROM p JOIN sel ON p.row_id = sel.row_id AND p.m = sel.m
GROUP BY p.row_id, p.c"""
)
def fuse_masked_mean(spark, sf_dir):
    scored, _ = views.scored_orders(spark, sf_dir)
    rows = scored.withColumn("uncertainty", model_uncertainty()).withColumn("selected", select_models())
    return rows.select(
        "row_id", F.posexplode(fu.fuse_masked_mean("probas", "selected")).alias("class", "p")
    ).withColumn("p", F.round("p", 6))


@query(
    ORDERS_P
    + VOTES
    + SELECTION
    + """
, w AS (SELECT u.row_id, u.m, 1 - u.u AS w, sel.m IS NOT NULL AS s FROM u LEFT JOIN sel ON u.row_id = sel.row_id AND u.m = sel.m)
SELECT p.row_id, p.c AS class,
  round(round(sum(p.p * w.w) / sum(w.w), 9), 6) AS weighting,
  round(round(sum(p.p * w.w) FILTER (w.s) / sum(w.w) FILTER (w.s), 9), 6) AS hybrid,
  round(round(coalesce(sum(w.w) FILTER (b.pred = p.c), 0) / sum(w.w), 9), 6) AS weighting_votes,
  round(round(coalesce(sum(w.w) FILTER (b.pred = p.c AND w.s), 0) / sum(w.w) FILTER (w.s), 9), 6) AS hybrid_votes
FROM p JOIN w ON p.row_id = w.row_id AND p.m = w.m JOIN b ON b.row_id = p.row_id AND b.m = p.m
GROUP BY p.row_id, p.c"""
)
def fuse_weighted(spark, sf_dir):
    """Confidence of each model stands in for its competence."""
    scored, pool = views.scored_orders(spark, sf_dir)
    k = len(pool.labels)
    rows = (
        pool.predict(scored)
        .withColumn("uncertainty", model_uncertainty())
        .withColumn("selected", select_models())
        .withColumn("w", F.transform("uncertainty", lambda u: 1 - u))
        .select(
            "row_id",
            F.posexplode(
                F.arrays_zip(
                    fu.fuse_weighted("probas", "w").alias("weighting"),
                    fu.fuse_weighted("probas", "w", "selected").alias("hybrid"),
                    fu.fuse_weighted_votes("preds", "w", k).alias("weighting_votes"),
                    fu.fuse_weighted_votes("preds", "w", k, "selected").alias("hybrid_votes"),
                )
            ).alias("class", "z"),
        )
    )
    return rows.select(
        "row_id",
        "class",
        *[F.round(F.col("z")[n], 6).alias(n) for n in ("weighting", "hybrid", "weighting_votes", "hybrid_votes")],
    )


@query(
    ORDERS_P
    + """
SELECT row_id, y, m AS model, round(1 - max(p), 6) AS uncertainty FROM p GROUP BY row_id, y, m""",
    name="model_uncertainty",
)
def model_uncertainty_by_row(spark, sf_dir):
    scored, _ = views.scored_orders(spark, sf_dir)
    long = scored.select("row_id", "y", F.posexplode(model_uncertainty()).alias("model", "uncertainty"))
    return long.withColumn("uncertainty", F.round("uncertainty", 6))
