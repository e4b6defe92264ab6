"""Neighbour joins, nearest-neighbour and discriminant members, dynamic selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from demur.functions.scores import METHODS
from demur.operators import des
from demur.operators import neighbors as nb
from demur.operators import reject as rj
from demur.operators import sweep as sw
from demur.operators.bayes import QDA
from demur.operators.metrics import label_set, metric_auto
from demur.plans import views
from demur.plans.oracle_parts import ORDERS, SEED, SPLIT, VECTORS_P, metrics_sql, prepared, with_split
from demur.plans.registry import query
from demur.plans.views import ORDER_FEATURES
from demur.session import settle

EMB = f"e AS (SELECT vec_id AS row_id, label AS y, embedding::DOUBLE[] AS x, {SPLIT.replace('row_id', 'vec_id')} AS split FROM embeddings)"


def _nn(dist: str, k: int, where: str = "q.row_id <> r.row_id") -> str:
    """k nearest by rounded distance, then id."""
    return f"""nn AS (SELECT q.row_id, r.row_id AS ref_id, r.y AS ref_y, round({dist}, 9) AS dist,
  row_number() OVER (PARTITION BY q.row_id ORDER BY round({dist}, 9), r.row_id) AS "rank"
  FROM e q, e r WHERE {where} QUALIFY "rank" <= {k})"""


def _flat(found):
    return nb.flat(found).select("row_id", F.col("rank").cast("bigint").alias("rank"), "ref_id", F.round("dist", 6).alias("dist"))


def _knn(dist, k=7):
    return f'WITH {EMB}, {_nn(dist, k)} SELECT row_id, "rank", ref_id, round(dist, 6) AS dist FROM nn'


def _vec(spark, sf_dir):
    return views.vectors_view(spark, sf_dir).select("row_id", "y", "vec")


@query(_knn("list_distance(q.x, r.x)"))
def knn_join(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _flat(nb.knn_join(v, v, 7, exclude_self=True))


@query(_knn("list_sum([abs(q.x[i] - r.x[i]) for i in range(1, 65)])"))
def knn_metric_manhattan(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _flat(nb.knn_join(v, v, 7, p=1, exclude_self=True))


@query(_knn("list_sum([abs(q.x[i] - r.x[i]) ** 3 for i in range(1, 65)]) ** (1.0 / 3)"))
def knn_metric_minkowski(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _flat(nb.knn_join(v, v, 7, p=3, exclude_self=True))


@query(_knn("list_cosine_distance(q.x, r.x)"))
def knn_metric_cosine(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _flat(nb.knn_join(v, v, 7, exclude_self=True, metric="cosine"))


@query("""WITH e AS (SELECT vec_id AS row_id, label AS y, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
s AS (SELECT covar_samp(a, a) AS caa, covar_samp(a, b) AS cab, covar_samp(b, b) AS cbb FROM e),
i AS (SELECT cbb / (caa * cbb - cab * cab) AS iaa, -cab / (caa * cbb - cab * cab) AS iab, caa / (caa * cbb - cab * cab) AS ibb FROM s),
d AS (SELECT q.row_id, r.row_id AS ref_id, round(sqrt((q.a - r.a) * (q.a - r.a) * iaa + 2 * (q.a - r.a) * (q.b - r.b) * iab + (q.b - r.b) * (q.b - r.b) * ibb), 9) AS dist
  FROM e q, e r, i WHERE q.row_id <> r.row_id)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY dist, ref_id) AS "rank", ref_id, round(dist, 6) AS dist FROM d QUALIFY "rank" <= 7""")
def knn_metric_mahalanobis(spark, sf_dir):
    v = views.vectors_view(spark, sf_dir)
    two = v.select("row_id", F.array("e0", "e1").alias("vec"))
    return _flat(nb.knn_join(two, two, 7, exclude_self=True, metric="mahalanobis", vi=nb.inverse_covariance(v, ["e0", "e1"])))


@query()
def knn_metric_mahalanobis_full(spark, sf_dir):
    """The same over all numbers of the vectors."""
    v = views.vectors_view(spark, sf_dir)
    vi = nb.inverse_covariance(v, views.VECTOR_FEATURES)
    vec = v.select("row_id", "vec")
    return _flat(nb.knn_join(vec, vec, 7, exclude_self=True, metric="mahalanobis", vi=vi))


@query(f"""WITH {EMB}, n AS (SELECT q.row_id, r.y, r.row_id AS ref_id, round(list_distance(q.x, r.x), 9) AS dist FROM e q, e r WHERE q.row_id <> r.row_id)
SELECT row_id, y, row_number() OVER (PARTITION BY row_id, y ORDER BY dist, ref_id) AS "rank", ref_id FROM n QUALIFY "rank" <= 2""")
def knn_equal_class(spark, sf_dir):
    v = _vec(spark, sf_dir)
    labels = label_set(v)
    found = nb.knn_equal_class(v, v, 2, labels, exclude_self=True)
    return found.select("row_id", "y", F.posexplode("neighbors").alias("pos", "n")).select(
        "row_id", "y", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("n.ref_id").alias("ref_id")
    )


ORDER_NN = f"""WITH {ORDERS}, {with_split()}, {prepared(ORDER_FEATURES)},
nn AS (SELECT q.row_id, arg_min({{'id': r.row_id, 'y': r.y}}, (round(sqrt((q.o_totalprice - r.o_totalprice) ** 2 + (q.max_price - r.max_price) ** 2), 9), r.row_id), 5) AS l
  FROM z q, z r WHERE r.split = 'T_lambda' AND q.row_id <> r.row_id GROUP BY q.row_id)"""


@query(ORDER_NN + ' SELECT row_id, unnest(range(1, 6)) AS "rank", unnest(list_transform(l, lambda x: x.id)) AS ref_id FROM nn')
def knn_join_orders(spark, sf_dir):
    """All orders against the orders of one part, by two features."""
    rows = settle(views.split_prepared(settle(views.orders_view(spark, sf_dir)), ORDER_FEATURES))
    v = rows.select("row_id", "split", F.array("o_totalprice", "max_price").alias("vec"))
    found = nb.knn_join(v, v.where("split = 'T_lambda'"), 5, exclude_self=True)
    return nb.flat(found).select("row_id", F.col("rank").cast("bigint").alias("rank"), "ref_id")


@query(ORDER_NN.replace("(q.o_totalprice - r.o_totalprice) ** 2 + (q.max_price - r.max_price) ** 2", " + ".join(f"(q.{f} - r.{f}) ** 2" for f in ORDER_FEATURES))
       + ' SELECT row_id, unnest(range(1, 6)) AS "rank", unnest(list_transform(l, lambda x: x.id)) AS ref_id FROM nn')
def knn_join_orders_full(spark, sf_dir):
    """The same by all features."""
    rows = settle(views.split_prepared(settle(views.orders_view(spark, sf_dir)), ORDER_FEATURES))
    v = rows.select("row_id", "split", F.array(*ORDER_FEATURES).alias("vec"))
    found = nb.knn_join(v, v.where("split = 'T_lambda'"), 5, exclude_self=True)
    return nb.flat(found).select("row_id", F.col("rank").cast("bigint").alias("rank"), "ref_id")


def _knn_vote(weight):
    return f"""WITH {EMB}, {_nn("list_distance(q.x, r.x)", 7, "r.split = 'T'")},
w AS (SELECT row_id, ref_y, {weight} AS w FROM nn),
l AS (SELECT DISTINCT y AS c FROM e WHERE split = 'T')
SELECT e.row_id, l.c AS class, round(coalesce(sum(w.w) FILTER (w.ref_y = l.c), 0) / sum(w.w), 6) AS p
FROM e JOIN w ON e.row_id = w.row_id, l GROUP BY e.row_id, l.c"""


def _probabilities(member, rows, name="p"):
    scored = member.add_probability(rows, "_p").select("row_id", F.posexplode("_p").alias("pos", "v"))
    labels = F.array(*[F.lit(v) for v in member.labels])
    return scored.select("row_id", F.element_at(labels, F.col("pos") + 1).alias("class"), F.round("v", 6).alias(name))


def _fit_knn(spark, sf_dir, weights):
    rows = views.split_four_way(views.vectors_view(spark, sf_dir), SEED)
    member = nb.KNN(views.VECTOR_FEATURES, 7, weights).fit(rows.where("split = 'T'"))
    return _probabilities(member, rows)


@query(_knn_vote("1.0"))
def fit_knn(spark, sf_dir):
    return _fit_knn(spark, sf_dir, "uniform")


@query(_knn_vote("CASE WHEN min(dist) OVER (PARTITION BY row_id) = 0 THEN (dist = 0)::INTEGER ELSE 1 / dist END"))
def fit_knn_distance(spark, sf_dir):
    """Rows of the fitted part find themselves at distance 0."""
    return _fit_knn(spark, sf_dir, "distance")


QDA_FEATURES = ["o_totalprice", "max_price"]


@query(f"""WITH {ORDERS}, {with_split()}, {prepared(ORDER_FEATURES)},
qs AS (SELECT y AS c, count(*) / (SELECT count(*) FROM z WHERE split = 'T') AS pr, avg(o_totalprice) AS ma, avg(max_price) AS mb,
  covar_samp(o_totalprice, o_totalprice) AS caa, covar_samp(o_totalprice, max_price) AS cab, covar_samp(max_price, max_price) AS cbb
  FROM z WHERE split = 'T' GROUP BY y),
g AS (SELECT *, caa * cbb - cab * cab AS det FROM qs),
l AS (SELECT z.row_id, c, ln(pr) - 0.5 * ln(det) - 0.5 * (cbb * (o_totalprice - ma) ** 2 - 2 * cab * (o_totalprice - ma) * (max_price - mb) + caa * (max_price - mb) ** 2) / det AS ll FROM z, g),
x AS (SELECT row_id, c, exp(ll - max(ll) OVER (PARTITION BY row_id)) AS e FROM l)
SELECT row_id, c AS class, round(e / sum(e) OVER (PARTITION BY row_id), 6) AS p FROM x""")
def fit_qda(spark, sf_dir):
    rows = views.split_prepared(settle(views.orders_view(spark, sf_dir)), ORDER_FEATURES)
    member = QDA(QDA_FEATURES).fit(rows.where("split = 'T'"))
    return _probabilities(member, rows)


@query(f"""WITH {ORDERS}, {with_split()}, {prepared(ORDER_FEATURES)},
f AS (SELECT unnest({ORDER_FEATURES}) AS feature),
u AS ({' UNION ALL '.join(f"SELECT y, split, '{f}' AS feature, {f} AS x FROM z" for f in ORDER_FEATURES)}),
fl AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT feature, var_pop(x) AS v FROM u WHERE split = 'T' GROUP BY feature))
SELECT y AS class, feature, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x) + max(eps), 6) AS var FROM u, fl WHERE split = 'T' GROUP BY y, feature""")
def fit_gaussian_nb(spark, sf_dir):
    """The fitted parameters, as a table."""
    rows = views.split_prepared(settle(views.orders_view(spark, sf_dir)), ORDER_FEATURES)
    model = views.GaussianNB(ORDER_FEATURES).fit(rows.where("split = 'T'"))
    return spark.createDataFrame(
        [
            (int(c), f, round(m, 6) + 0.0, round(v, 6))
            for c, ms, vs in zip(model.labels, model.mean, model.var)
            for f, m, v in zip(ORDER_FEATURES, ms, vs)
        ],
        "class int, feature string, mean double, var double",
    )


# --- dynamic selection: references T_lambda, queries all rows, never their own neighbour ---
K, KP = 7, 5
PRED = ", b AS (SELECT row_id, y, split, m, c AS pred FROM p QUALIFY row_number() OVER (PARTITION BY row_id, m ORDER BY p DESC, c) = 1)"
HIT = f"""{PRED},
hit AS MATERIALIZED (SELECT b.row_id, b.y, b.split, b.m, (b.pred = b.y)::INTEGER AS hit, p.p AS conf FROM b
  JOIN p ON b.row_id = p.row_id AND b.m = p.m AND p.c = b.y)"""
NEAR = f""", {EMB},
{_nn("list_distance(q.x, r.x)", K, "r.split = 'T_lambda' AND q.row_id <> r.row_id").replace("nn AS (", "nn AS MATERIALIZED (")}"""
PROFILE = f""", o AS (SELECT row_id, split, list(p ORDER BY m, c) AS x FROM p GROUP BY row_id, split),
alike AS MATERIALIZED (SELECT q.row_id, r.row_id AS ref_id, round(list_distance(q.x, r.x), 9) AS dist,
  row_number() OVER (PARTITION BY q.row_id ORDER BY round(list_distance(q.x, r.x), 9), r.row_id) AS "rank"
  FROM o q, o r WHERE r.split = 'T_lambda' AND q.row_id <> r.row_id QUALIFY "rank" <= {KP})"""
LOCAL = """, la AS MATERIALIZED (SELECT nn.row_id, h.m, avg(h.hit) AS comp FROM nn JOIN hit h ON h.row_id = nn.ref_id GROUP BY nn.row_id, h.m)"""
CHOSEN = """, ms AS (SELECT row_id, m, comp, comp >= avg(comp) OVER (PARTITION BY row_id) - 1e-12 AS s FROM la),
dd AS MATERIALIZED (SELECT p.row_id, p.y, p.c AS pred FROM p JOIN ms ON p.row_id = ms.row_id AND p.m = ms.m WHERE ms.s
  GROUP BY p.row_id, p.y, p.c QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY round(avg(p.p), 9) DESC, p.c) = 1)"""


def _scored(spark, sf_dir):
    scored, pool = views.scored_vectors(spark, sf_dir)
    scored = settle(scored, "vectors-scored")
    return scored, scored.where("split = 'T_lambda'"), pool


def _selector(pool, refs, **settings):
    return des.CompetenceSelector(pool.labels, k=K, kp=KP, meta=settings.pop("meta", None), **settings).fit(refs)


@query(VECTORS_P + HIT + " SELECT row_id, m AS model, hit::DOUBLE AS hit, round(conf, 6) AS conf FROM hit")
def des_hit_matrix(spark, sf_dir):
    scored, _, _ = _scored(spark, sf_dir)
    rows = des.hit_matrix(scored).select("row_id", F.posexplode(F.arrays_zip("hits", "confs")).alias("model", "z"))
    return rows.select("row_id", "model", F.col("z.hits").alias("hit"), F.round("z.confs", 6).alias("conf"))


@query(VECTORS_P + PRED + """ SELECT row_id, round(max(n) / sum(n), 6) AS consensus FROM (SELECT row_id, pred, count(*) AS n FROM b GROUP BY row_id, pred)
GROUP BY row_id HAVING max(n) / sum(n) < 0.5""")
def des_consensus_filter(spark, sf_dir):
    scored, _, _ = _scored(spark, sf_dir)
    kept = des.consensus(des.consensus_filter(scored, 0.5))
    return kept.select("row_id", F.round("consensus", 6).alias("consensus"))


@query(VECTORS_P + PROFILE + ' SELECT row_id, "rank", ref_id, round(dist, 6) AS dist FROM alike')
def profile_knn_join(spark, sf_dir):
    scored, refs, _ = _scored(spark, sf_dir)
    return _flat(des.profile_knn_join(scored, refs, KP, exclude_self=True))


@query(VECTORS_P + HIT + NEAR + LOCAL + " SELECT row_id, m AS model, round(comp, 6) AS competence FROM la")
def des_local_accuracy(spark, sf_dir):
    scored, refs, pool = _scored(spark, sf_dir)
    rows = _selector(pool, refs).competence(scored)
    return rows.select("row_id", F.posexplode("competences").alias("model", "competence")).withColumn(
        "competence", F.round("competence", 6)
    )


@query(VECTORS_P + HIT + NEAR + PROFILE + LOCAL + f"""
SELECT nn.row_id, h.m AS model, "rank" - 1 AS pos, h.hit::DOUBLE AS value FROM nn JOIN hit h ON h.row_id = nn.ref_id
UNION ALL SELECT nn.row_id, h.m, {K} + "rank" - 1, round(h.conf, 6) FROM nn JOIN hit h ON h.row_id = nn.ref_id
UNION ALL SELECT row_id, m, {2 * K}, round(comp, 6) FROM la
UNION ALL SELECT a.row_id, h.m, {2 * K + 1} + "rank" - 1, h.hit FROM alike a JOIN hit h ON h.row_id = a.ref_id
UNION ALL SELECT row_id, m, {2 * K + 1 + KP}, round(max(p), 6) FROM p GROUP BY row_id, m""")
def des_meta_features(spark, sf_dir):
    scored, refs, pool = _scored(spark, sf_dir)
    rows = des.meta_features(_selector(pool, refs).described(scored))
    long = rows.select("row_id", "model", F.posexplode("meta").alias("pos", "value"))
    return long.select("row_id", "model", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(VECTORS_P + HIT + NEAR + LOCAL + """
SELECT row_id, m AS model, comp >= avg(comp) OVER (PARTITION BY row_id) - 1e-12 AS selected FROM la""")
def select_competent(spark, sf_dir):
    scored, refs, pool = _scored(spark, sf_dir)
    selector = _selector(pool, refs)
    rows = selector.decision(selector.competence(scored))
    return rows.select("row_id", F.posexplode("selected").alias("model", "selected"))


@query(VECTORS_P + HIT + NEAR + LOCAL + CHOSEN + """,
sc AS (SELECT row_id, median(comp) AS s FROM la GROUP BY row_id),
rk AS (SELECT row_id, row_number() OVER (ORDER BY round(s, 9), row_id) <= floor(0.25 * count(*) OVER ()) AS rejected FROM sc)
SELECT dd.row_id, dd.y, rk.rejected, CASE WHEN rk.rejected THEN NULL ELSE dd.pred END AS pred FROM dd JOIN rk ON dd.row_id = rk.row_id""")
def des_predict(spark, sf_dir):
    """Selector prediction of all vectors, the quarter of lowest median competence refused."""
    scored, refs, pool = _scored(spark, sf_dir)
    return _selector(pool, refs, rate=0.25, method="median").predict(scored).select("row_id", "y", "rejected", "pred")


@query(VECTORS_P + HIT + NEAR + LOCAL + CHOSEN + """,
sc AS (SELECT row_id, avg(comp) AS s FROM la GROUP BY row_id),
rk AS (SELECT row_id, row_number() OVER (ORDER BY round(s, 9), row_id) <= floor(0.4 * count(*) OVER ()) AS rejected FROM sc)
SELECT dd.row_id, CASE WHEN rk.rejected THEN NULL ELSE dd.pred END AS pred FROM dd JOIN rk ON dd.row_id = rk.row_id""")
def des_classify(spark, sf_dir):
    """Rate and method are changed after the fit; an unknown method means the average."""
    scored, refs, pool = _scored(spark, sf_dir)
    selector = _selector(pool, refs).set_params(rate=0.4, method="other")
    return selector.predict(scored).select("row_id", "pred")


@query(VECTORS_P + HIT + NEAR + LOCAL + """
SELECT row_id, row_number() OVER (ORDER BY round(s, 9), row_id) <= floor(0.3 * count(*) OVER ()) AS rejected
FROM (SELECT row_id, min(comp) AS s FROM la GROUP BY row_id)""")
def reject_low_competence(spark, sf_dir):
    scored, refs, pool = _scored(spark, sf_dir)
    rows = settle(_selector(pool, refs).competence(scored).select("row_id", "competences"))
    return rj.reject_low_competence(rows, "min", 0.3).select("row_id", "rejected")


@query(VECTORS_P + HIT + NEAR + LOCAL + " SELECT row_id, max(round(comp, 9)) < 0.9 AS rejected FROM la GROUP BY row_id")
def reject_if_none_competent(spark, sf_dir):
    scored, refs, pool = _scored(spark, sf_dir)
    rows = rj.reject_if_none_competent(_selector(pool, refs).competence(scored), 0.9)
    return rows.select("row_id", "rejected")


@query(VECTORS_P + HIT + NEAR + LOCAL + """,
cells AS (SELECT 'avg' AS method, 0.2::DOUBLE AS rate UNION ALL SELECT 'max', 0.6),
sc AS (SELECT row_id, avg(comp) AS a, max(comp) AS b FROM la GROUP BY row_id)
SELECT method, rate, count(*) FILTER (rk <= floor(rate * n)) AS n_rejected, sum(row_id) FILTER (rk <= floor(rate * n))::BIGINT AS id_sum FROM (
  SELECT method, rate, row_id, count(*) OVER (PARTITION BY method) AS n,
    row_number() OVER (PARTITION BY method ORDER BY round(CASE method WHEN 'avg' THEN a ELSE b END, 9), row_id) AS rk FROM sc, cells)
GROUP BY method, rate""")
def set_reject_params(spark, sf_dir):
    """Two settings on one scored table; nothing is scored again."""
    scored, refs, pool = _scored(spark, sf_dir)
    selector = _selector(pool, refs)
    rows = settle(selector.competence(scored).select("row_id", "competences"))
    out = None
    for method, rate in (("avg", 0.2), ("max", 0.6)):
        selector.set_params(rate, method)
        part = rj.reject_low_competence(rows, selector.method, selector.rate).where("rejected").agg(
            F.count(F.lit(1)).alias("n_rejected"), F.sum("row_id").alias("id_sum")
        ).select(F.lit(method).alias("method"), F.lit(rate).alias("rate"), "n_rejected", "id_sum")
        out = part if out is None else out.unionByName(part)
    return out


@query(VECTORS_P + HIT + NEAR + """,
fr AS (SELECT nn.row_id, h.m, count(DISTINCT nn.ref_y) FILTER (h.hit = 1) >= 2 AS ok FROM nn JOIN hit h ON h.row_id = nn.ref_id GROUP BY nn.row_id, h.m),
mx AS (SELECT row_id, count(DISTINCT ref_y) > 1 AS mixed FROM nn GROUP BY row_id)
SELECT fr.row_id, fr.m AS model, CASE WHEN mx.mixed AND bool_or(fr.ok) OVER (PARTITION BY fr.row_id) THEN fr.ok ELSE true END AS kept
FROM fr JOIN mx ON fr.row_id = mx.row_id""")
def des_frienemy_prune(spark, sf_dir):
    scored, refs, pool = _scored(spark, sf_dir)
    rows = _selector(pool, refs).near(scored)
    return rows.select("row_id", F.posexplode(des.frienemy_mask("near")).alias("model", "kept"))


@query(VECTORS_P + HIT + NEAR + LOCAL + CHOSEN + f""",
cn AS (SELECT row_id, ref_y, count(*) AS n FROM nn GROUP BY row_id, ref_y),
kn AS (SELECT row_id, ref_y, 1 - n / {K} AS hard FROM cn QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, ref_y) = 1)
SELECT dd.row_id, round(kn.hard, 6) AS hardness, CASE WHEN kn.hard < 0.3 THEN kn.ref_y ELSE dd.pred END AS pred FROM dd JOIN kn ON dd.row_id = kn.row_id""")
def des_hardness_switch(spark, sf_dir):
    """Easy neighbourhoods are decided by the neighbours alone."""
    scored, refs, pool = _scored(spark, sf_dir)
    selector = _selector(pool, refs, use_hardness=True, hardness_rate=0.3)
    rows = selector.decision(selector.competence(scored))
    return rows.select("row_id", F.round(des.hardness("near", len(pool.labels)), 6).alias("hardness"), "pred_idx").withColumnRenamed("pred_idx", "pred")


THRESHOLDS = [0.0, 0.25, 0.5, 0.75]
T_RATES = [0.0, 0.1, 0.3, 0.5]


@query(VECTORS_P + HIT + NEAR + LOCAL + f""",
th AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), ra AS (SELECT unnest({T_RATES})::DOUBLE AS rate),
dt AS MATERIALIZED (SELECT p.row_id, p.y, threshold, p.c AS pred FROM p JOIN la ON p.row_id = la.row_id AND p.m = la.m, th WHERE round(la.comp, 9) >= threshold
  GROUP BY p.row_id, p.y, threshold, p.c QUALIFY row_number() OVER (PARTITION BY p.row_id, threshold ORDER BY round(avg(p.p), 9) DESC, p.c) = 1),
sc AS (SELECT row_id, 'avg' AS method, avg(comp) AS s FROM la GROUP BY row_id UNION ALL SELECT row_id, 'median', median(comp) FROM la GROUP BY row_id
  UNION ALL SELECT row_id, 'min', min(comp) FROM la GROUP BY row_id UNION ALL SELECT row_id, 'max', max(comp) FROM la GROUP BY row_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(s, 9), row_id) AS rk, count(*) OVER (PARTITION BY method) AS n FROM sc),
ta AS (SELECT rk.method, ra.rate, dt.threshold, dt.y, dt.pred FROM rk JOIN dt ON rk.row_id = dt.row_id, ra WHERE rk.rk > floor(ra.rate * rk.n))
{metrics_sql('ta', ['method', 'rate', 'threshold'])}""")
def sweep_thresholds(spark, sf_dir):
    """Method x rate x fixed selection threshold; a row without a selected model has no decision."""
    scored, refs, pool = _scored(spark, sf_dir)
    rows = settle(_selector(pool, refs).competence(scored).drop("near"), "thresholds")
    labels = F.array(*[F.lit(v) for v in pool.labels])

    def decide_at(t):
        kept = f"filter(probas, (p, i) -> round(competences[i], 9) >= {t}D)"
        mean = (
            f"transform(array({kept}), k -> if(size(k) = 0, cast(null as array<double>), transform(sequence(0, size(k[0]) - 1), c ->"
            " round(aggregate(k, 0D, (s, p) -> s + p[c]) / size(k), 9))))[0]"
        )
        index = F.expr(f"transform(array({mean}), f -> cast(array_position(f, array_max(f)) as int))[0]")
        return F.when(index.isNotNull(), F.element_at(labels, index))

    curve = sw.sweep_thresholds(rows, pool.labels, T_RATES, THRESHOLDS, decide_at, METHODS)
    return curve.select(
        "method", "rate", "threshold", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


@query(VECTORS_P + HIT + NEAR + LOCAL + CHOSEN + f""",
ra AS (SELECT unnest({T_RATES})::DOUBLE AS rate),
sc AS (SELECT row_id, avg(comp) AS s FROM la GROUP BY row_id),
rk AS (SELECT row_id, row_number() OVER (ORDER BY round(s, 9), row_id) AS rk, count(*) OVER () AS n FROM sc),
ta AS (SELECT ra.rate, dd.y, dd.pred FROM rk JOIN dd ON rk.row_id = dd.row_id, ra WHERE rk.rk > floor(ra.rate * rk.n))
{metrics_sql('ta', ['rate'])}""")
def sweep_selector(spark, sf_dir):
    """Curve of the selector by rate."""
    scored, refs, pool = _scored(spark, sf_dir)
    selector = _selector(pool, refs)
    rows = settle(selector.decision(selector.competence(scored)).drop("near"), "selector-sweep")
    curve = sw.sweep_rates(rows, pool.labels, T_RATES, ["avg"], kind="selector")
    return curve.select("rate", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def _meta(spark, sf_dir, meta):
    scored, refs, pool = _scored(spark, sf_dir)
    return scored, _selector(pool, refs, meta=meta)


@query()
def des_competence(spark, sf_dir):
    """Competences from the forest on the meta-features."""
    scored, selector = _meta(spark, sf_dir, des.forest(20, 5))
    rows = selector.competence(scored)
    return rows.select("row_id", F.posexplode("competences").alias("model", "competence"))


@query()
def des_meta_fit(spark, sf_dir):
    """Forest meta-classifier: how much each meta-feature tells."""
    _, selector = _meta(spark, sf_dir, des.forest(20, 5))
    weights = np.asarray(selector.model.featureImportances.toArray())
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "pos int, importance double")


@query()
def des_predict_meta(spark, sf_dir):
    """Selector with the default meta-classifier, hard voting and pruning, measured by part."""
    scored, refs, pool = _scored(spark, sf_dir)
    selector = _selector(pool, refs, meta="naive_bayes", rate=0.2, voting="hard", frienemy=True)
    return metric_auto(selector.predict(scored), ["split"])


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 50 END AS hc,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (user_id % 6)::INTEGER END AS kp, (event_id % 5)::INTEGER AS k FROM events)
SELECT CASE WHEN hc IS NULL OR isnan(hc) THEN 'hc must be a number' WHEN hc < 0.5 THEN 'hc must be at least 0.5'
  WHEN kp IS NULL THEN 'kp is missing' WHEN kp < 1 THEN 'kp must be at least 1'
  WHEN k < 1 THEN 'k must be an integer of at least 1' END AS error, count(*) AS n FROM s GROUP BY 1""")
def des_validate(spark, sf_dir):
    """Selector settings out of the events, by what is wrong with them."""
    settings = views.table(spark, sf_dir, "events").select(
        F.expr("if(event_id % 11 = 0, null, value / 50)").alias("hc"),
        F.expr("cast(if(event_id % 7 = 0, null, user_id % 6) as int)").alias("kp"),
        F.expr("cast(event_id % 5 as int)").alias("k"),
    )
    return des.setting_errors(settings).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
