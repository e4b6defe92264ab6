"""Uncertainty, selection, rejection and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.functions.scores import METHODS, normalised_rate, row_score, score_key
from demur.operators import metrics as me
from demur.operators import reject as rj
from demur.operators import sweep as sw
from demur.operators.order import exact_rank
from demur.plans import views
from demur.plans.oracle_parts import DECISION, EVENTS_P, ORDERS_P, metrics_sql
from demur.plans.registry import query

RATES = [round(i * 0.05, 2) for i in range(20)]
RATES_SQL = "(SELECT unnest([" + ", ".join(f"{r}::DOUBLE" for r in RATES) + "]) AS rate)"
METHOD_ROWS = """
SELECT row_id, y, pred, 'avg' AS method, s_avg AS s FROM d
UNION ALL SELECT row_id, y, pred, 'median', s_median FROM d
UNION ALL SELECT row_id, y, pred, 'min', s_min FROM d
UNION ALL SELECT row_id, y, pred, 'max', s_max FROM d"""
RANKED = f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(s, 9) DESC, row_id) AS rk,
        count(*) OVER (PARTITION BY method) AS n FROM ({METHOD_ROWS})),
acc AS (SELECT k.*, r.rate FROM k, {RATES_SQL} r WHERE k.rk > floor(r.rate * k.n))"""


def _decided(spark, sf_dir):
    scored, pool = views.scored_orders(spark, sf_dir)
    return rj.pool_decision(scored, pool.labels), pool


@query(
    f"""{ORDERS_P}, {DECISION}
SELECT row_id, y, round(s_avg, 6) AS score,
  row_number() OVER (ORDER BY round(s_avg, 9) DESC, row_id) <= floor(0.2 * count(*) OVER ()) AS rejected,
  CASE WHEN row_number() OVER (ORDER BY round(s_avg, 9) DESC, row_id) <= floor(0.2 * count(*) OVER ()) THEN NULL ELSE pred END AS pred
FROM d"""
)
def reject_predict(spark, sf_dir):
    """Flagship: pool prediction of all orders, the 20 % most uncertain rows refused."""
    scored, pool = views.scored_orders(spark, sf_dir)
    out = rj.reject_predict(scored, pool.labels, 0.2, "avg")
    return out.select("row_id", "y", F.round("score", 6).alias("score"), "rejected", "pred")


@query(
    f"""{ORDERS_P}, {DECISION}
SELECT row_id, round(s_avg, 6) AS s_avg, round(s_median, 6) AS s_median, round(s_min, 6) AS s_min, round(s_max, 6) AS s_max FROM d"""
)
def row_uncertainty(spark, sf_dir):
    scored, _ = views.scored_orders(spark, sf_dir)
    rows = rj.with_uncertainty(scored)
    return rows.select("row_id", *[F.round(row_score("uncertainty", m), 6).alias(f"s_{m}") for m in METHODS])


@query(
    f"""{ORDERS_P}, {DECISION}
SELECT u.row_id, u.m AS model, u.u <= us.s_avg + 1e-12 AS selected FROM u JOIN us ON u.row_id = us.row_id"""
)
def select_models(spark, sf_dir):
    decided, _ = _decided(spark, sf_dir)
    return decided.select("row_id", F.posexplode("selected").alias("model", "selected"))


@query(
    """SELECT DISTINCT l_quantity AS rate, CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END AS normalised FROM lineitem
    UNION ALL SELECT DISTINCT l_discount, l_discount FROM lineitem"""
)
def normalise_rate(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    rates = lines.select(F.col("l_quantity").alias("rate")).distinct().unionByName(
        lines.select(F.col("l_discount").alias("rate")).distinct()
    )
    return rates.select("rate", normalised_rate("rate").alias("normalised"))


@query(
    f"""{EVENTS_P}, {DECISION}
SELECT row_id, row_number() OVER (ORDER BY round(s_max, 9) DESC, row_id) <= floor(0.35 * count(*) OVER ()) AS rejected FROM d"""
)
def reject_top_rate(spark, sf_dir):
    scored, _ = views.scored_events(spark, sf_dir)
    rows = rj.with_uncertainty(scored)
    return rj.reject_top_rate(rows, row_score("uncertainty", "max"), 0.35).select("row_id", "rejected")


@query(
    """SELECT event_id AS row_id, row_number() OVER (ORDER BY (user_id % 3) DESC, event_id) <= floor(0.5 * count(*) OVER ()) AS rejected FROM events"""
)
def reject_top_rate_tied(spark, sf_dir):
    """Three distinct scores only: the cut falls inside a group of a third of all rows."""
    rows = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), (F.col("user_id") % 3).cast("double").alias("score")
    )
    return rj.reject_top_rate(rows, F.col("score"), 0.5).select("row_id", "rejected")


@query(
    f"""{ORDERS_P}, {DECISION}
SELECT count(*) AS n_rows, floor(0.2 * count(*))::BIGINT AS n_rejected, 'ok' AS status FROM d"""
)
def reject_alert(spark, sf_dir):
    scored, pool = views.scored_orders(spark, sf_dir)
    return rj.reject_alert(rj.reject_predict(scored, pool.labels, 0.2))


@query(
    f"""{ORDERS_P}, {DECISION}
SELECT row_id, round(s_avg, 9) > 0.6 AS rejected, CASE WHEN round(s_avg, 9) > 0.6 THEN NULL ELSE pred END AS pred FROM d"""
)
def reject_threshold(spark, sf_dir):
    decided, _ = _decided(spark, sf_dir)
    rows = rj.reject_threshold(decided.withColumn("score", row_score("uncertainty", "avg")), "score", 0.6)
    return rows.select("row_id", "rejected", F.when(~F.col("rejected"), F.col("pred_label")).alias("pred"))


@query(
    f"""{ORDERS_P}, {DECISION}
SELECT row_id, round(s_avg, 6) AS score, row_number() OVER (ORDER BY round(s_avg, 9) DESC, row_id) AS "rank" FROM d"""
)
def rank_rows(spark, sf_dir):
    decided, _ = _decided(spark, sf_dir)
    rows = decided.withColumn("score", row_score("uncertainty", "avg")).select(
        "row_id", "score", score_key(F.col("score")).alias("_key")
    )
    return exact_rank(rows, ["_key", "row_id"]).select("row_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""{ORDERS_P}
SELECT row_id, m AS model, c AS class, row_number() OVER (PARTITION BY row_id, m ORDER BY p, c) - 1 AS "rank" FROM p"""
)
def rank_classes(spark, sf_dir):
    scored, _ = views.scored_orders(spark, sf_dir)
    ranks = F.expr(
        "transform(probas, p -> transform(p, (x, i) ->"
        " cast(size(filter(p, (q, j) -> q < x or (q = x and j < i))) as bigint)))"
    )
    long = scored.select("row_id", F.posexplode(ranks).alias("model", "rs"))
    return long.select("row_id", "model", F.posexplode("rs").alias("class", "rank"))


@query(f"{ORDERS_P}, {DECISION} {RANKED} {metrics_sql('acc', ['method', 'rate'])}")
def sweep_rates(spark, sf_dir):
    decided, pool = _decided(spark, sf_dir)
    curve = sw.sweep_rates(decided, pool.labels, RATES)
    return _rounded(curve, ["method", "rate"])


@query(f"{EVENTS_P}, {DECISION} {RANKED} {metrics_sql('acc', ['method', 'rate'])}")
def sweep_rates_five_classes(spark, sf_dir):
    scored, pool = views.scored_events(spark, sf_dir)
    curve = sw.sweep_rates(rj.pool_decision(scored, pool.labels), pool.labels, RATES)
    return _rounded(curve, ["method", "rate"])


def _rounded(curve, keys):
    return curve.select(*keys, *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


HISTORY = f"""
, h AS (SELECT k.row_id, k.method, min(r.rate) AS rate
        FROM k, (SELECT rate FROM {RATES_SQL} UNION ALL SELECT 1.0::DOUBLE) r WHERE k.rk <= floor(r.rate * k.n)
        GROUP BY k.row_id, k.method)"""


@query(f"{ORDERS_P}, {DECISION} {RANKED} {HISTORY} SELECT row_id, method, rate FROM h")
def first_reject_rate(spark, sf_dir):
    decided, _ = _decided(spark, sf_dir)
    return sw.first_reject_rate(decided, RATES)


@query(f"{ORDERS_P}, {DECISION} {RANKED} {HISTORY} SELECT method, rate, count(*) AS n_new FROM h GROUP BY method, rate")
def new_rejections(spark, sf_dir):
    decided, pool = _decided(spark, sf_dir)
    _, history = sw.sweep_history(decided, pool.labels, RATES)
    return sw.new_rejections(history)


@query(
    f"""{ORDERS_P}, {DECISION} {RANKED} {HISTORY},
c AS ({metrics_sql('acc', ['method', 'rate'])}),
g AS (SELECT method, rate, count(*) AS n_new FROM h GROUP BY method, rate)
SELECT method, rate, accuracy, f1, n_new FROM c FULL JOIN g USING (method, rate)"""
)
def sweep_history(spark, sf_dir):
    decided, pool = _decided(spark, sf_dir)
    curve, history = sw.sweep_history(decided, pool.labels, RATES)
    counts = sw.new_rejections(history)
    return (
        _rounded(curve, ["method", "rate"]).join(counts, ["method", "rate"], "full")
        .select("method", "rate", "accuracy", "f1", "n_new")
    )


@query(
    f"""{ORDERS_P},
mp AS (SELECT row_id, y, m, c AS pred, 1 - p AS s FROM p QUALIFY row_number() OVER (PARTITION BY row_id, m ORDER BY p DESC, c) = 1),
mk AS (SELECT *, 'nb_' || m AS model, row_number() OVER (PARTITION BY m ORDER BY round(s, 9) DESC, row_id) AS rk,
       count(*) OVER (PARTITION BY m) AS n FROM mp),
ma AS (SELECT mk.*, r.rate FROM mk, {RATES_SQL} r WHERE mk.rk > floor(r.rate * mk.n))
{metrics_sql('ma', ['model', 'rate'])}"""
)
def sweep_models(spark, sf_dir):
    scored, pool = views.scored_orders(spark, sf_dir)
    return _rounded(sw.sweep_models(scored, pool.labels, pool.names, RATES), ["model", "rate"])


@query(
    "SELECT m AS method, r.rate AS rate, t.threshold FROM (SELECT unnest(['avg','median','min','max']) AS m), "
    + RATES_SQL
    + " r, (SELECT DISTINCT l_discount AS threshold FROM lineitem) t"
)
def sweep_grid(spark, sf_dir):
    thresholds = me.label_set(views.table(spark, sf_dir, "lineitem"), "l_discount")
    return sw.sweep_grid(spark, METHODS, RATES, thresholds)


@query(
    f"""{ORDERS_P}, {DECISION} {RANKED},
c AS (SELECT method, rate, avg((y = pred)::INTEGER) AS a FROM acc GROUP BY method, rate),
l AS (SELECT *, lag(rate) OVER w AS r0, lag(a) OVER w AS a0 FROM c WINDOW w AS (PARTITION BY method ORDER BY rate))
SELECT method, round(sum((rate - r0) * (a + a0) / 2), 6) AS au_arc FROM l GROUP BY method"""
)
def au_arc(spark, sf_dir):
    decided, pool = _decided(spark, sf_dir)
    curve = sw.sweep_rates(decided, pool.labels, RATES)
    return me.au_arc(curve, ["method"]).withColumn("au_arc", F.round("au_arc", 6))


@query(f"{ORDERS_P}, {DECISION} SELECT row_id, y, pred AS pred_idx, pred AS pred_label FROM d")
def pool_decision(spark, sf_dir):
    decided, _ = _decided(spark, sf_dir)
    return decided.select("row_id", "y", "pred_idx", "pred_label")
