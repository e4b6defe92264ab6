"""Whole runs: studies over datasets, training with a registry, and default pools."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demur.functions.fusion import RULES, decide, fuse, model_labels
from demur.operators.des import CompetenceSelector, forest
from demur.operators.learners import draw_params, fit_tree
from demur.operators.metrics import average_mode, confusion, metric_auroc, metrics_from_confusion, positive_label
from demur.operators.pool import Member, Pool
from demur.operators.prep import Preprocessor
from demur.operators.split import split_random, split_stratified
from demur.session import settle
from demur.sources.runs import Registry, RunNotFound

# --- study ---------------------------------------------------------------------------------
def evaluate_study(scored: DataFrame, dataset: str, names: list[str], labels: list, sizes: list[int]) -> DataFrame:
    """Accuracy and macro F1 of every member and of the seven rules at every ensemble size.

    One scoring pass serves all sizes: an ensemble is a slice of the scores. All decisions of a row are
    counted in one aggregate.
    """
    rows = scored.withColumn("preds", model_labels("probas"))
    wanted = sorted({min(s, len(names)) for s in sizes})
    for s in wanted:
        rows = rows.withColumn(f"_p{s}", F.slice("probas", 1, s)).withColumn(f"_v{s}", F.slice("preds", 1, s))

    def item(method, size, index):
        return F.struct(F.lit(method).alias("method"), F.lit(size).alias("ensemble_size"), index.cast("int").alias("i"))

    decisions = [item(f"base_{n}", 1, F.col("preds")[i]) for i, n in enumerate(names)]
    for s in wanted:
        decisions += [item(r, s, decide(fuse(r, len(labels), f"_p{s}", f"_v{s}"))) for r in RULES]
    label_array = F.array(*[F.lit(v) for v in labels])
    long = rows.select("y", F.explode(F.array(*decisions)).alias("d")).select(
        "y", "d.method", "d.ensemble_size", F.element_at(label_array, F.col("d.i") + 1).alias("pred")
    )
    keys = ["method", "ensemble_size"]
    out = metrics_from_confusion(confusion(long, keys), keys, "macro")
    return out.select(F.lit(dataset).alias("dataset"), *keys, "accuracy", F.col("f1").alias("f1_macro"))


def study_run(
    df: DataFrame,
    dataset: str,
    library: Callable[[list[str]], dict],
    sizes: list[int],
    test_size: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """Stratified split, preprocessing fitted on the training part, pool fit, and all metrics.

    ``library(features)`` gives the members by name, in order.
    """
    parts = settle(split_stratified(df, test_size, seed), "study-parts")
    prep = Preprocessor.fit(parts.where("not is_test"), skip=["row_id", "y", "is_test"])
    rows = settle(prep.apply(parts), "study-rows")
    pool = Pool(library(prep.features)).fit(rows.where("not is_test"))
    scored = pool.predict_proba(rows.where("is_test")).select("row_id", "y", "probas")
    return evaluate_study(settle(scored, "study-scored"), dataset, pool.names, pool.labels, sizes)


# --- training with a registry --------------------------------------------------------------
def train_test_metrics(scored: DataFrame, labels: list, split: str = "split") -> DataFrame:
    """Accuracy, precision, recall and F1 by part, from one aggregate.

    ``scored``: ``split, y, pred``. The average follows the labels of the whole y.
    """
    return metrics_from_confusion(confusion(scored, [split]), [split], average_mode(labels), positive_label(labels))


def measured(member, train: DataFrame, test: DataFrame) -> dict[str, float | None]:
    """The metrics a run keeps, by part; AUROC of two classes only."""
    out: dict[str, float | None] = {}
    labels = member.labels
    label_array = F.array(*[F.lit(v) for v in labels])
    both = train.withColumn("_part", F.lit("train")).unionByName(test.withColumn("_part", F.lit("test")))
    scored = member.add_probability(both, "_p").select(
        "_part", "y", "_p", F.element_at(label_array, F.expr("cast(array_position(_p, array_max(_p)) as int)")).alias("pred")
    )
    scored = settle(scored, "measured")
    for r in train_test_metrics(scored, labels, "_part").collect():
        out |= {
            f"{r['_part']}_accuracy": r["accuracy"],
            f"{r['_part']}_precision": r["precision"],
            f"{r['_part']}_recall": r["recall"],
            f"{r['_part']}_f1_score": r["f1"],
        }
    if len(labels) == 2:
        for part in ("train", "test"):
            rows = scored.where(F.col("_part") == part).select("y", F.col("_p")[1].alias("score"))
            out[f"{part}_auroc"] = metric_auroc(rows, positive=labels[1]).first()[0]
    return out


def register(registry: Registry, experiment: str, name: str, member: Member, params: dict, train: DataFrame, test: DataFrame) -> str:
    """Measures a fitted member on both parts and appends its run."""
    stored = params | {"labels": ",".join(str(v) for v in member.labels)}
    return registry.append(experiment, name, stored, measured(member, train, test), member)


def load_or_fit(
    registry: Registry,
    experiment: str,
    name: str,
    make: Callable[[], tuple[Member, dict]],
    train: DataFrame,
    test: DataFrame,
    wait: float = 1.0,
) -> tuple[Member, bool]:
    """The registered member, or a new one that is fitted and registered; True if it was loaded.

    ``make`` gives an unfitted member and its parameters, from a search (``search.searched``) or fixed. Of several
    sessions that miss the same run one searches and fits; the others look again every ``wait`` seconds.
    """
    while True:
        try:
            return registry.load_member(experiment, name), True
        except RunNotFound:
            if not registry.claim(experiment, name):
                time.sleep(wait)
                continue
        try:
            try:
                # another session may have finished between the look and the claim
                return registry.load_member(experiment, name), True
            except RunNotFound:
                member, params = make()
                member.fit(train)
                register(registry, experiment, name, member, params, train, test)
                return member, False
        finally:
            registry.release(experiment, name)


def registry_migrate(
    registry: Registry, old: str, new: str, names: list[str], train: DataFrame, test: DataFrame
) -> list[str]:
    """Copies the newest runs to a new experiment and measures every model again."""
    made = []
    for name in names:
        params = {k: v for k, v in registry.lookup(old, name)["params"].items() if k != "labels"}
        made.append(register(registry, new, name, registry.load_member(old, name), params, train, test))
    return made


# --- selector runs -------------------------------------------------------------------------
def default_pool(df: DataFrame, features: list[str], members: int = 10, seed: int = 42, depth: int = 5, dsel: float = 0.5):
    """Bagged trees when no pool is given: ``(pool, rows set aside as references)``.

    A bootstrap is a Poisson(1) weight by row and member, drawn from the row's hash.
    """
    parts = split_random(df, dsel, seed)
    train, aside = parts.where("not is_test").drop("is_test"), parts.where("is_test").drop("is_test")
    weights = {}
    for i in range(members):
        u = (
            f"((cast(conv(substr(md5(concat('{seed}-bag{i}-', row_id)), 1, 10), 16, 10) as double) + 0.5D)"
            " / 1099511627776D)"
        )
        # inverse Poisson(1) distribution function
        steps, total, mass = [], 0.0, 0.36787944117144233
        for k in range(8):
            total += mass
            steps.append(f"when u < {total!r}D then {k}D")
            mass /= k + 1
        weights[f"_w{i}"] = F.expr(f"transform(array({u}), u -> case {' '.join(steps)} else 8D end)[0]")
    train = settle(train.withColumns(weights), "bags")
    trees = {}
    for i in range(members):
        bag = train.where(F.col(f"_w{i}") > 0)
        trees[f"bag_{i}"] = fit_tree(features, depth=depth, seed=seed + i, weight=f"_w{i}").fit(bag)
    return Pool(trees), aside


def des_search(
    pool: Pool, refs: DataFrame, dsel: DataFrame, trials: int = 25, seed: int = 42, parallelism: int = 4
) -> tuple[dict, list[tuple[dict, float]]]:
    """k, Kp and forest size by macro F1 on the accepted rows of the validation part.

    The neighbours of both parts are found once, for the largest k and Kp; every draw takes the nearest of them.
    """
    space = {"k": (3, 25, "log_int"), "kp": (3, 25, "log_int"), "trees": (10, 500, "log_int"), "depth": (5, 30, "log_int"), "min_leaf": (1, 30, "int")}
    draws = draw_params(space, trials, seed)
    widest = CompetenceSelector(pool.labels, k=max(d["k"] for d in draws), kp=max(d["kp"] for d in draws))
    widest.refs = refs = settle(refs.select("row_id", "y", "vec", "probas"), "search-refs")
    near_refs, near_dsel = settle(widest.described(refs), "search-near-refs"), settle(widest.described(dsel), "search-near-dsel")

    def scored(d: dict) -> tuple[dict, float]:
        selector = CompetenceSelector(
            pool.labels, k=d["k"], kp=d["kp"], meta=forest(d["trees"], d["depth"], d["min_leaf"], seed=seed)
        ).fit(refs, near_refs)
        found = selector.predict(dsel, near_dsel).where("pred is not null")
        return d, float(metrics_from_confusion(confusion(found), (), "macro").first()["f1"])

    # a fit is a row of short jobs, so several draws share the executors
    with ThreadPoolExecutor(parallelism) as threads:
        ranked = list(threads.map(scored, draws))
    return max(ranked, key=lambda t: t[1])[0], ranked



def train_and_register(
    registry: Registry,
    experiment: str,
    data,
    members: dict[str, Callable[[], tuple[Member, dict]]],
    selector: Callable[[Pool, DataFrame], CompetenceSelector] | None = None,
) -> tuple[Pool, CompetenceSelector | None]:
    """Pool of a prepared dataset from the registry or from new fits, then the selector on T_lambda.

    ``members`` gives an unfitted member and its parameters by name (found by ``search_params`` or
    fixed); ``selector(pool, scored references)`` gives a fitted selector, whose run is measured on G. A
    stored selector is taken if its run names the same members in the same order.
    """
    train, test = settle(data.train(), "train-part"), data.part("G")
    fitted = {}
    for name, make in members.items():
        fitted[name], _ = load_or_fit(registry, experiment, name, make, train, test)
    pool = Pool(fitted)
    if selector is None:
        return pool, None
    vec = F.array(*[F.col(f"`{c}`").cast("double") for c in data.features]).alias("vec")

    def scored(rows):
        # the selector works on class indices
        index = (F.array_position(F.array(*[F.lit(v) for v in pool.labels]), F.col("y")) - 1).cast("int")
        return settle(pool.predict_proba(rows).select("row_id", index.alias("y"), vec, "probas"), "selector-scored")

    try:
        if registry.lookup(experiment, "Selector")["params"].get("pool") == ",".join(pool.names):
            return pool, registry.load_member(experiment, "Selector")
    except RunNotFound:
        pass
    chosen = selector(pool, scored(data.part("T_lambda")))
    index_labels = list(range(len(pool.labels)))
    metrics = {}
    for part, rows in (("train", chosen.refs), ("test", scored(test))):
        found = chosen.decision(chosen.competence(rows)).select("y", F.col("pred_idx").alias("pred"))
        r = metrics_from_confusion(confusion(found), (), average_mode(index_labels)).first()
        metrics |= {f"{part}_accuracy": r["accuracy"], f"{part}_precision": r["precision"], f"{part}_recall": r["recall"], f"{part}_f1_score": r["f1"]}
    params = {"k": chosen.k, "Kp": chosen.kp, "Hc": chosen.hc, "voting": chosen.voting, "rejection_rate": 0.0, "pool": ",".join(pool.names)}
    registry.append(experiment, "Selector", params, metrics, chosen)
    return pool, chosen
