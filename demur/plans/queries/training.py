"""Metrics, MLlib members, search, registry runs and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.functions import fusion as fu
from demur.functions.arrays import argmax_index
from demur.operators import learners
from demur.operators import metrics as me
from demur.operators import neighbors as nb
from demur.operators import search, trees
from demur.operators.bayes import QDA, GaussianNB
from demur.operators.mlp import MLP, fit_network
from demur.operators.pool import Pool
from demur.operators.prep import OneHot, Preprocessor
from demur.operators.sgd import SGD
from demur.operators.split import split_four_way
from demur.plans import study, views
from demur.plans.oracle_parts import ORDERS_P, SEED, metrics_sql
from demur.plans.registry import query
from demur.plans.views import ORDER_FEATURES
from demur.session import scratch_path, settle
from demur.sources.runs import Registry


def _decided(spark, sf_dir):
    """All orders with the label of the sum rule."""
    scored, pool = views.scored_orders(spark, sf_dir)
    return scored.select("row_id", "y", "split", fu.decide(fu.fuse_sum()).alias("pred")), pool


SUM = ORDERS_P + """,
d AS MATERIALIZED (SELECT row_id, y, split, c AS pred FROM (SELECT row_id, y, split, c, round(sum(p), 9) AS f FROM p GROUP BY row_id, y, split, c)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY f DESC, c) = 1)"""


@query(SUM + " SELECT y, pred, count(*) AS n FROM d GROUP BY y, pred")
def confusion(spark, sf_dir):
    return me.confusion(_decided(spark, sf_dir)[0])


@query(SUM + " SELECT round(avg((y = pred)::INTEGER), 6) AS accuracy FROM d")
def metric_accuracy(spark, sf_dir):
    found = me.metrics_from_confusion(me.confusion(_decided(spark, sf_dir)[0]))
    return found.select(F.round("accuracy", 6).alias("accuracy"))


def _round(df, keys=()):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(SUM + metrics_sql("d", []))
def metric_prf_macro(spark, sf_dir):
    return _round(me.metrics_from_confusion(me.confusion(_decided(spark, sf_dir)[0]), (), "macro"))


BINARY = SUM + ", e AS (SELECT (y = 1)::INTEGER AS y, (pred = 1)::INTEGER AS pred, split FROM d)"


def _binary(spark, sf_dir):
    rows, _ = _decided(spark, sf_dir)
    return rows.select("split", (F.col("y") == 1).cast("int").alias("y"), (F.col("pred") == 1).cast("int").alias("pred"))


@query(BINARY + metrics_sql("e", [], binary=True))
def metric_prf_binary(spark, sf_dir):
    return _round(me.metrics_from_confusion(me.confusion(_binary(spark, sf_dir)), (), "binary"))


@query(BINARY + f""", two AS ({metrics_sql("e", [], binary=True)}), three AS ({metrics_sql("d", [])})
SELECT 2 AS n_labels, * FROM two UNION ALL SELECT 3, * FROM three""")
def metric_auto(spark, sf_dir):
    rows, _ = _decided(spark, sf_dir)
    two = _round(me.metric_auto(_binary(spark, sf_dir))).withColumn("n_labels", F.lit(2))
    return two.unionByName(_round(me.metric_auto(rows)).withColumn("n_labels", F.lit(3)))


@query(SUM + metrics_sql("d", ["split"]))
def train_test_metrics(spark, sf_dir):
    rows, pool = _decided(spark, sf_dir)
    return _round(study.train_test_metrics(rows, pool.labels), ["split"])


@query("""WITH s AS (SELECT l.quality AS y, round(n_chars::DOUBLE, 9) AS x FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM r""")
def metric_auroc(spark, sf_dir):
    rows = views.docs_view(spark, sf_dir).select("y", F.col("n_chars").cast("double").alias("score"))
    return me.metric_auroc(rows).select(F.round("auroc", 6).alias("auroc"))


@query(ORDERS_P + """, bx AS (SELECT (y = 1)::INTEGER AS b, round(p, 9) AS x FROM p WHERE m = 0 AND c = 1),
g AS (SELECT x, sum(b) AS pos, count(*) - sum(b) AS neg FROM bx GROUP BY x),
u AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0 AS lower FROM g)
SELECT round(sum(pos * lower) / (sum(pos) * sum(neg)), 6) AS auroc FROM u""")
def metric_auroc_scores(spark, sf_dir):
    """One class against the rest, by the probability of one member."""
    scored, _ = views.scored_orders(spark, sf_dir)
    rows = scored.select((F.col("y") == 1).cast("int").alias("y"), F.expr("probas[0][1]").alias("score"))
    return me.metric_auroc(rows).select(F.round("auroc", 6).alias("auroc"))


STUDY_ROWS = """WITH r AS (SELECT event_type AS method, (user_id % 3)::INTEGER AS ensemble_size, value / 100 AS accuracy,
  json_extract_string(props, '$.k')::DOUBLE / 100 AS f1_macro FROM events),
g AS (SELECT method, ensemble_size, avg(accuracy) AS am, coalesce(stddev_samp(accuracy), 0) AS asd, avg(f1_macro) AS fm,
  coalesce(stddev_samp(f1_macro), 0) AS fsd, count(accuracy) AS n_runs FROM r GROUP BY {by})
SELECT method, ensemble_size, round(am, 6) AS accuracy_mean, round(asd, 6) AS accuracy_std, round(fm, 6) AS f1_macro_mean,
  round(fsd, 6) AS f1_macro_std, n_runs FROM g {tail}"""


def _results(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"),
        (F.col("user_id") % 3).cast("int").alias("ensemble_size"),
        (F.col("value") / 100).alias("accuracy"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("f1_macro"),
    )


def _summary_round(df):
    return df.select(
        "method", "ensemble_size",
        *[F.round(c, 6).alias(c) for c in ("accuracy_mean", "accuracy_std", "f1_macro_mean", "f1_macro_std")], "n_runs",
    )


@query(STUDY_ROWS.format(by="method, ensemble_size", tail=""))
def study_summary(spark, sf_dir):
    return _summary_round(me.study_summary(_results(spark, sf_dir)))


@query(STUDY_ROWS.format(by="CUBE (method, ensemble_size)", tail=""))
def study_summary_margins(spark, sf_dir):
    return _summary_round(me.study_summary(_results(spark, sf_dir), margins=True))


@query(STUDY_ROWS.format(by="method, ensemble_size", tail="ORDER BY am DESC, fm DESC, method, ensemble_size LIMIT 1"))
def top_result(spark, sf_dir):
    return _summary_round(me.top_result(me.study_summary(_results(spark, sf_dir))))


# --- MLlib members: fitted on T, measured on every part ------------------------------------
def _orders(spark, sf_dir):
    return settle(views.split_prepared(settle(views.orders_view(spark, sf_dir)), ORDER_FEATURES), "orders-rows")


def _fit_and_measure(spark, sf_dir, member):
    rows = _orders(spark, sf_dir)
    member.fit(rows.where("split = 'T'"))
    labels = F.array(*[F.lit(v) for v in member.labels])
    scored = member.add_probability(rows, "p").select(
        "split", "y", F.element_at(labels, argmax_index("p") + 1).alias("pred")
    )
    return study.train_test_metrics(scored, member.labels)


for _name, _make in (
    ("fit_tree", lambda: learners.fit_tree(ORDER_FEATURES)),
    ("fit_logistic", lambda: learners.fit_logistic(ORDER_FEATURES)),
    ("fit_sgd", lambda: learners.fit_sgd(ORDER_FEATURES, "elasticnet")),
    ("fit_linear_svm", lambda: learners.fit_linear_svm(ORDER_FEATURES, max_iter=1000)),
    ("fit_mlp", lambda: learners.fit_mlp(ORDER_FEATURES, (8,), 20)),
    ("fit_forest", lambda: learners.fit_forest(ORDER_FEATURES, trees=100, depth=5)),
    ("fit_boosted", lambda: learners.fit_boosted(ORDER_FEATURES, trees=5)),
    ("fit_adaboost", lambda: learners.fit_adaboost(ORDER_FEATURES, rounds=50)),
    ("fit_tree_deep", lambda: trees.fit_deep_tree(ORDER_FEATURES, impurity="log_loss", min_split=4)),
    ("fit_forest_deep", lambda: trees.fit_deep_forest(ORDER_FEATURES)),
    ("fit_extra_trees", lambda: trees.fit_extra_trees(ORDER_FEATURES)),
    ("fit_boosted_second_order", lambda: trees.fit_second_order(ORDER_FEATURES, rounds=20)),
    ("fit_gradient_boosting", lambda: trees.fit_gradient_boosting(ORDER_FEATURES, rounds=20)),
    ("fit_sgd_epochs", lambda: SGD(ORDER_FEATURES, "modified_huber", "elasticnet")),
    ("fit_mlp_adam", lambda: fit_network(ORDER_FEATURES)),
    ("fit_mlp_momentum", lambda: MLP(ORDER_FEATURES, [100], "tanh", "sgd", schedule="adaptive", eta0=0.01, early_stop=True, patience=20)),
    ("fit_qda_full", lambda: QDA(ORDER_FEATURES)),
):

    def _run(spark, sf_dir, make=_make):
        return _fit_and_measure(spark, sf_dir, make())

    query(name=_name)(_run)


@query()
def score_as_unit(spark, sf_dir):
    """Scaler and classifier as one unit that scores raw rows."""
    rows = settle(split_four_way(views.docs_view(spark, sf_dir), SEED), "docs")
    onehot = OneHot.fit(rows.where("split = 'T'"), ["lang"])
    rows = onehot.apply(rows)
    member = learners.fit_logistic(["n_chars", *onehot.names()]).fit(rows.where("split = 'T'"))
    return member.add_probability(rows, "p").select("row_id", "y", F.col("p")[1].alias("p"))


@query()
def pool_fit(spark, sf_dir):
    """Members of several kinds; the one that is fitted already is left alone."""
    rows = _orders(spark, sf_dir)
    train = rows.where("split = 'T'")
    first = GaussianNB(ORDER_FEATURES[:2]).fit(train)
    pool = Pool({"nb_ready": first, "nb": GaussianNB(ORDER_FEATURES[2:]), "tree": learners.fit_tree(ORDER_FEATURES, 4)})
    pool.fit(train)
    scored = pool.predict(pool.predict_proba(rows).select("row_id", "y", "split", "probas"))
    return scored.select("split", "y", F.posexplode("preds").alias("model", "pred")).groupBy("model", "split").agg(
        F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy")
    )


@query()
def search_params(spark, sf_dir):
    """Cross-validated random draws for a tree and for neighbours, as many as the training takes."""
    rows = _orders(spark, sf_dir).where("split = 'T'")
    out = []
    for name in ("Decision_Tree", "KNN"):
        _, ranked = search.search(rows, ORDER_FEATURES, name, trials=25, seed=SEED)
        out += [(name, i, str(sorted(d.items())), float(s)) for i, (d, s) in enumerate(ranked)]
    return spark.createDataFrame(out, "member string, trial int, params string, f1 double")


def _docs(spark, sf_dir):
    parts = split_four_way(views.docs_view(spark, sf_dir), SEED)
    prep = Preprocessor.fit(parts.where("split = 'T'"))
    return settle(prep.apply(parts), "docs-rows"), prep.features


def _run_table(registry):
    return registry.runs.select("experiment", "run_name", F.explode("metrics").alias("metric", "value"))


@query()
def registry_append(spark, sf_dir):
    """A fitted member with its metrics on the training and the test part."""
    rows, features = _docs(spark, sf_dir)
    train, test = rows.where("split = 'T'"), rows.where("split = 'G'")
    registry = Registry(spark, scratch_path(spark, "registry"))
    member = learners.fit_tree(features, 4).fit(train)
    study.register(registry, "docs_v6_42", "Decision_Tree", member, {"maxDepth": 4}, train, test)
    return _run_table(registry)


@query()
def load_or_fit(spark, sf_dir):
    """The second call finds the run of the first."""
    rows, features = _docs(spark, sf_dir)
    train, test = rows.where("split = 'T'"), rows.where("split = 'G'")
    registry = Registry(spark, scratch_path(spark, "registry"))

    make = search.searched(train, features, "Decision_Tree", trials=25, seed=SEED)
    out = None
    for turn in (1, 2):
        member, loaded = study.load_or_fit(registry, "docs_v6_42", "Decision_Tree", make, train, test)
        part = member.add_probability(rows, "p").select(
            F.lit(turn).alias("turn"), F.lit(loaded).alias("loaded"), "row_id", F.col("p")[1].alias("p")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query()
def registry_migrate(spark, sf_dir):
    """Runs of one version, five kinds of members, measured again under the next."""
    rows, features = _docs(spark, sf_dir)
    train, test = rows.where("split = 'T'"), rows.where("split = 'G'")
    registry = Registry(spark, scratch_path(spark, "registry"))
    members = {
        "Decision_Tree": trees.fit_deep_tree(features),
        "SGD": SGD(features),
        "KNN": nb.KNN(features),
        "MLP": fit_network(features, (100,)),
        "Random_Forest": trees.fit_deep_forest(features),
    }
    for name, member in members.items():
        study.register(registry, "docs_v5_42", name, member.fit(train), {"n_features": len(features)}, train, test)
    study.registry_migrate(registry, "docs_v5_42", "docs_v6_42", list(members), train, test)
    return _run_table(registry)


def _library(features):
    return {
        "logreg": learners.fit_logistic(features, max_iter=1000),
        "tree": learners.fit_tree(features, 8),
        "knn": nb.KNN(features, 7),
        "rf": trees.fit_deep_forest(features, trees=300),
        "extra_trees": trees.fit_extra_trees(features, trees=300),
        "gradient_boosting": trees.fit_gradient_boosting(features, rounds=100),
        "naive_bayes": GaussianNB(features),
        "qda": QDA(features),
        "mlp": fit_network(features),
    }


@query()
def study_run(spark, sf_dir):
    """The labelled documents: nine members, seven rules, two ensemble sizes."""
    return study.study_run(views.docs_view(spark, sf_dir), "documents", _library, [4, 9], seed=SEED)


@query()
def des_default_pool(spark, sf_dir):
    """Bagged trees; half of the rows are set aside as references."""
    rows = _orders(spark, sf_dir)
    pool, aside = study.default_pool(rows.drop("split"), ORDER_FEATURES, members=10, seed=SEED)
    scored = pool.predict(pool.predict_proba(aside).select("row_id", "y", "probas"))
    return scored.select("y", F.posexplode("preds").alias("model", "pred")).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy")
    )


@query()
def des_search(spark, sf_dir):
    """Selector settings by macro F1 on the validation part."""
    scored, pool = views.scored_vectors(spark, sf_dir)
    scored = settle(scored, "vectors-scored")
    _, ranked = study.des_search(
        pool, scored.where("split = 'T_lambda'"), scored.where("split = 'DSEL'"), trials=25, seed=SEED
    )
    return spark.createDataFrame(
        [(i, d["k"], d["kp"], d["trees"], float(s)) for i, (d, s) in enumerate(ranked)],
        "trial int, k int, kp int, trees int, f1 double",
    )
