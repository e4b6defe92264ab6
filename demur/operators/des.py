"""Dynamic ensemble selection with rejection: each row trusts the models with a good record near it.

Tables: *references* and *queries* are scored rows ``row_id, y (class index), vec, probas``. Nothing here
depends on rejection rate or method, so competences are computed once for a whole sweep.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from numbers import Real

from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.functions.fusion import (
    decide,
    fuse_hard_share,
    fuse_masked_mean,
    fuse_weighted,
    fuse_weighted_votes,
    model_labels,
)
from demur.functions.scores import select_competent
from demur.operators.learners import checked_depth
from demur.operators.neighbors import flat, knn_equal_class, knn_join
from demur.operators.reject import label_of, reject_low_competence
from demur.session import settle

# Names of the combination modes.
MODES = ("selection", "weighting", "hybrid")


def hit_matrix(refs: DataFrame) -> DataFrame:
    """Adds ``hits`` (1 where a model is right) and ``confs`` (its probability of the true class)."""
    hits = F.expr("transform(probas, p -> if(array_position(p, array_max(p)) - 1 = y, 1D, 0D))")
    return refs.withColumn("hits", hits).withColumn("confs", F.expr("transform(probas, p -> p[y])"))


def consensus(scored: DataFrame) -> DataFrame:
    """Adds ``consensus``: the largest share of models that agree on a class."""
    preds = scored.withColumn("_preds", model_labels("probas"))
    share = (
        "array_max(transform(_preds, v -> cast(size(filter(_preds, w -> w = v)) as double))) / size(_preds)"
    )
    return preds.withColumn("consensus", F.expr(share)).drop("_preds")


def consensus_filter(scored: DataFrame, hc: float) -> DataFrame:
    """Rows on which the pool agrees less than ``hc``; full agreement teaches nothing about competence."""
    return consensus(scored).where(F.col("consensus") < hc).drop("consensus")


def profile_vector(probas: str = "probas") -> Column:
    """Point of a row in the space of the pool's outputs."""
    return F.flatten(probas)


def profile_knn_join(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """Nearest references by pool output."""
    return knn_join(
        queries.select("row_id", profile_vector().alias("vec")),
        refs.select("row_id", profile_vector().alias("vec")),
        k,
        exclude_self=exclude_self,
    )


def with_records(neighbors: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """Neighbours with the records of the reference rows, in order: ``(row_id, name array<struct>)``.

    A reference near to many queries is a hot key of this join; its side of the join has one short row
    by key, so the adaptive planner can split the other.
    """
    record = hit_matrix(refs).select(F.col("row_id").alias("ref_id"), F.col("y").alias("ref_y"), "hits", "confs")
    rows = flat(neighbors).join(record, "ref_id")
    item = F.struct("rank", "hits", "confs", "ref_y", "dist")
    return rows.groupBy("row_id").agg(F.array_sort(F.collect_list(item)).alias(name))


def local_accuracy(near: str = "near") -> Column:
    """Share of the neighbours that each model gets right."""
    return F.expr(
        f"transform({near}[0].hits, (h, m) ->"
        f" aggregate({near}, 0D, (s, n) -> s + n.hits[m]) / size({near}))"
    )


def frienemy_mask(near: str = "near") -> Column:
    """Models that are right on two neighbours of different classes.

    All models if the neighbourhood has one class, or if no model qualifies.
    """
    ok = (
        f"transform({near}[0].hits, (h, m) ->"
        f" size(array_distinct(transform(filter({near}, n -> n.hits[m] = 1D), n -> n.ref_y))) >= 2)"
    )
    mixed = f"size(array_distinct(transform({near}, n -> n.ref_y))) > 1"
    every = f"transform({near}[0].hits, h -> true)"
    return F.expr(
        f"transform(array({ok}), ok -> if({mixed} and exists(ok, o -> o), ok, {every}))[0]"
    )


def neighbor_votes(near: str, n_classes: int, safe_k: int | None = None) -> str:
    """SQL array with the number of neighbours by class."""
    some = near if safe_k is None else f"slice({near}, 1, {safe_k})"
    return f"transform(sequence(0, {n_classes - 1}), c -> size(filter({some}, n -> n.ref_y = c)))"


def hardness(near: str, n_classes: int, safe_k: int | None = None) -> Column:
    """Share of the neighbours outside of the majority class."""
    some = near if safe_k is None else f"slice({near}, 1, {safe_k})"
    return F.expr(f"1D - array_max({neighbor_votes(near, n_classes, safe_k)}) / size({some})")


def neighbor_majority(near: str, n_classes: int) -> Column:
    """Plain nearest-neighbour decision; ties go to the smallest class."""
    return F.expr(
        f"transform(array({neighbor_votes(near, n_classes)}), v -> cast(array_position(v, array_max(v)) - 1 as int))[0]"
    )


def meta_features(rows: DataFrame) -> DataFrame:
    """One row by (row, model) with the meta-features.

    Hits of the neighbours, their true-class probabilities, local accuracy, hits of the neighbours by
    output profile, and the model's own confidence. Needs ``near``, ``alike`` and ``probas``.
    """
    m = "model"
    parts = (
        f"transform(near, n -> n.hits[{m}])",
        f"transform(near, n -> n.confs[{m}])",
        f"array(aggregate(near, 0D, (s, n) -> s + n.hits[{m}]) / size(near))",
        f"transform(alike, n -> n.hits[{m}])",
        f"array(array_max(probas[{m}]))",
    )
    keep = [c for c in ("y", "hits") if c in rows.columns]
    long = rows.withColumn(m, F.explode(F.sequence(F.lit(0), F.size("probas") - 1)))
    return long.select("row_id", m, *keep, F.expr(f"concat({', '.join(parts)})").alias("meta"))


def setting_errors(settings: DataFrame) -> DataFrame:
    """``settings`` (``hc double, kp int, k int``) with ``error``: what the selector would refuse first, else null."""
    return settings.withColumn(
        "error",
        F.when(F.col("hc").isNull() | F.isnan("hc"), F.lit("hc must be a number"))
        .when(F.col("hc") < 0.5, F.lit("hc must be at least 0.5"))
        .when(F.col("kp").isNull(), F.lit("kp is missing"))
        .when(F.col("kp") < 1, F.lit("kp must be at least 1"))
        .when(F.col("k").isNull() | (F.col("k") < 1), F.lit("k must be an integer of at least 1")),
    )


@dataclass
class CompetenceSelector:
    """Selector with settings; ``fit`` on references, then ``competence`` and ``predict`` on queries.

    ``meta``: an MLlib estimator that gives probabilities; ``"naive_bayes"`` for the multinomial default;
    ``None`` takes the local accuracy as the competence.
    """

    labels: list
    k: int = 7
    kp: int = 5
    hc: float = 1.0
    rate: float = 0.0
    method: str = "median"
    mode: str = "selection"
    voting: str = "soft"
    frienemy: bool = False
    use_hardness: bool = False
    hardness_rate: float = 0.3
    safe_k: int | None = None
    equal_class: bool = False
    metric: str = "minkowski"
    metric_options: dict = field(default_factory=dict)
    meta: object = "naive_bayes"
    refs: DataFrame | None = None
    model: object = None

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        if isinstance(self.hc, bool) or not isinstance(self.hc, Real) or self.hc != self.hc:
            raise ValueError(f"hc must be a number, not {type(self.hc).__name__}")
        if self.hc < 0.5:
            raise ValueError(f"hc must be at least 0.5, not {self.hc}")
        if self.kp is None:
            raise ValueError("kp is missing")
        if isinstance(self.kp, bool) or not isinstance(self.kp, int):
            raise TypeError("kp must be an integer")
        if self.kp < 1:
            raise ValueError(f"kp must be at least 1, not {self.kp}")
        if not isinstance(self.k, int) or self.k < 1:
            raise ValueError(f"k must be an integer of at least 1, not {self.k}")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.voting not in ("soft", "hard"):
            raise ValueError("voting must be 'soft' or 'hard'")
        if self.safe_k is not None and not 1 <= self.safe_k <= self.k:
            raise ValueError("safe_k must lie between 1 and k")
        if not (self.meta is None or self.meta == "naive_bayes" or hasattr(self.meta, "probabilityCol")):
            raise ValueError("the meta-classifier must give probabilities")

    def set_params(self, rate: float | None = None, method: str | None = None) -> CompetenceSelector:
        """Changes rate or method; competences do not depend on them."""
        if rate is not None:
            self.rate = rate
        if method is not None:
            self.method = method
        return self

    # -- neighbourhoods
    def near(self, queries: DataFrame) -> DataFrame:
        """Queries with the records of their nearest references, or of equally many from each class."""
        options = {"exclude_self": True, "metric": self.metric, **self.metric_options}
        asked = queries.select("row_id", "vec")
        if self.equal_class:
            indices = list(range(len(self.labels)))
            by_class = knn_equal_class(asked, self.refs, max(1, self.k // len(indices)), indices, **options)
            merged = F.array_sort(F.flatten(F.collect_list("neighbors"))).alias("neighbors")
            found = by_class.groupBy("row_id").agg(merged)
        else:
            found = knn_join(asked, self.refs.select("row_id", "vec"), self.k, **options)
        return queries.join(with_records(found, self.refs, "near"), "row_id")

    def described(self, queries: DataFrame) -> DataFrame:
        """Queries with nearest references by features and by output profile."""
        alike = with_records(profile_knn_join(queries, self.refs, self.kp, exclude_self=True), self.refs, "alike")
        return self.near(queries).join(alike, "row_id")

    def _cut(self, described: DataFrame) -> DataFrame:
        """What ``described`` of a selector with at least as many neighbours gave, as this one would."""
        return described.withColumns({"near": F.slice("near", 1, self.k), "alike": F.slice("alike", 1, self.kp)})

    # -- fitting
    def fit(self, refs: DataFrame, described: DataFrame | None = None) -> CompetenceSelector:
        """Keeps the references; fits the meta-classifier on those without full agreement.

        ``described``: the references with the neighbours that a selector with at least this k and kp found.
        """
        self.refs = settle(refs.select("row_id", "y", "vec", "probas"), "selector-refs")
        if self.refs.count() <= max(self.k, self.kp):
            raise ValueError("there must be more references than neighbours")
        if self.meta is None:
            return self
        if described is None:
            train = hit_matrix(self.described(consensus_filter(self.refs, self.hc)))
        else:
            train = hit_matrix(self._cut(consensus_filter(described, self.hc)))
        rows = meta_features(train).select(
            array_to_vector("meta").alias("features"), F.expr("hits[model]").alias("label")
        )
        estimator = self.meta
        if estimator == "naive_bayes":
            estimator = NaiveBayes(modelType="multinomial")
        rows = settle(rows.select(vector_to_array("features").alias("meta"), "label"), "selector-meta")
        self.model = estimator.fit(rows.select(array_to_vector("meta").alias("features"), "label"))
        return self

    # -- prediction
    def competence(self, queries: DataFrame, described: DataFrame | None = None) -> DataFrame:
        """Queries with ``near`` and ``competences`` by model; ``described`` as in ``fit``."""
        if self.meta is None:
            near = self.near(queries) if described is None else self._cut(described).drop("alike")
            rows = near.withColumn("competences", local_accuracy("near"))
        else:
            described = settle(self.described(queries), "selector-queries") if described is None else self._cut(described)
            scored = self.model.transform(
                meta_features(described).select("row_id", "model", array_to_vector("meta").alias("features"))
            )
            by_row = scored.select("row_id", "model", vector_to_array("probability")[1].alias("c")).groupBy("row_id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("model", "c"))), lambda x: x["c"]).alias("competences")
            )
            rows = described.drop("alike").join(by_row, "row_id")
        if self.frienemy:
            rows = rows.withColumn("_mask", frienemy_mask("near")).withColumn(
                "competences", F.expr("zip_with(competences, _mask, (c, m) -> if(m, c, 0D))")
            ).drop("_mask")
        return rows

    def decision(self, rows: DataFrame) -> DataFrame:
        """Adds ``selected``, ``fused``, ``pred_idx`` and ``pred_label`` to rows with competences."""
        n = len(self.labels)
        rows = rows.withColumn("selected", select_competent("competences"))
        mask = None if self.mode == "weighting" else "selected"
        if self.voting == "hard":
            rows = rows.withColumn("_preds", model_labels("probas"))
            if self.mode == "selection":
                fused = fuse_hard_share("_preds", n, "selected")
            else:
                fused = fuse_weighted_votes("_preds", "competences", n, mask)
        elif self.mode == "selection":
            fused = fuse_masked_mean("probas", "selected")
        else:
            fused = fuse_weighted("probas", "competences", mask)
        rows = rows.withColumn("fused", fused).drop("_preds").withColumn("pred_idx", decide("fused"))
        if self.use_hardness:
            easy = hardness("near", n, self.safe_k) < self.hardness_rate
            rows = rows.withColumn("pred_idx", F.when(easy, neighbor_majority("near", n)).otherwise(F.col("pred_idx")))
        return rows.withColumn("pred_label", label_of("pred_idx", self.labels))

    def predict(self, queries: DataFrame, described: DataFrame | None = None) -> DataFrame:
        """Adds ``rejected`` and ``pred`` (NULL when rejected) by the lowest competences; ``described`` as in ``fit``."""
        rows = settle(self.decision(self.competence(queries, described)).drop("near"), "selector-decision")
        return classify(reject_low_competence(rows, self.method, self.rate))


def classify(rows: DataFrame) -> DataFrame:
    """Label of the decision; a rejected row stays without one."""
    return rows.withColumn("pred", F.when(~F.col("rejected"), F.col("pred_label")))


def forest(n_trees: int = 100, depth: int = 5, min_leaf: int = 1, impurity: str = "gini", seed: int = 42):
    """Meta-classifier as used in the selector search."""
    return RandomForestClassifier(
        numTrees=n_trees, maxDepth=checked_depth(depth), minInstancesPerNode=min_leaf, impurity=impurity, seed=seed
    )
