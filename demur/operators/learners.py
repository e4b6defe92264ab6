"""Pool members on distributed MLlib fits.

A member keeps its feature names and label order; classes are indexed by sorted label. Members whose
MLlib class handles two classes only are fitted once against each class.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.operators.metrics import average_mode, confusion, label_set, metrics_from_confusion
from demur.operators.prep import Scaler
from demur.operators.split import fold_assign, fold_count
from demur.operators.stumps import Stump, boosted
from demur.session import num_lit, quoted, settle

# Names of the members of the trained pool and of the study library.
POOL_NAMES = (
    "Decision_Tree",
    "SGD",
    "Logistic_Regression",
    "KNN",
    "SVM_Linear",
    "MLP",
    "Random_Forest",
    "Gradient_Boosting",
    "AdaBoost",
    "XGBoost",
)
STUDY_NAMES = (
    "logreg",
    "tree",
    "knn",
    "rf",
    "extra_trees",
    "gradient_boosting",
    "naive_bayes",
    "qda",
    "mlp",
)


def label_index(y: str, labels: list) -> Column:
    """Class index of a label as the double that MLlib wants."""
    return (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(y)) - 1).cast("double")


def scale_stage(scaler: Scaler) -> SQLTransformer:
    """Population scaling as a stage, so that it is saved and loaded with the classifier."""
    cols = ", ".join(
        f"({quoted(c)} - {num_lit(m)}) / {num_lit(s)} AS {quoted('scaled_' + c)}" for c, (m, s) in scaler.stats.items()
    )
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


class MLMember:
    """One MLlib classifier over given features; raw data in, probabilities out.

    ``scaled``: standardise the features first, inside the same pipeline.
    """

    def __init__(self, features: list[str], make: Callable[[int], Estimator], scaled: bool = False):
        self.features, self.make, self.scaled = features, make, scaled
        self.labels: list = []
        self.model = None

    def stages(self, df: DataFrame) -> list:
        inputs, first = self.features, []
        if self.scaled:
            first = [scale_stage(Scaler.fit(df, self.features))]
            inputs = [f"scaled_{f}" for f in self.features]
        return [*first, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")]

    def fit(self, df: DataFrame, y: str = "y") -> MLMember:
        self.labels = label_set(df, y)
        train = df.withColumn("label", label_index(y, self.labels))
        self.model = Pipeline(stages=[*self.stages(df), self.make(len(self.labels))]).fit(train)
        return self

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        return self.model.transform(df).select(*df.columns, vector_to_array("probability").alias(name))


class OneVsRest(MLMember):
    """A two-class member by class; shares are normalised. Two classes need one fit only."""

    def __init__(self, features: list[str], make_binary: Callable[[], MLMember]):
        super().__init__(features, lambda n: None)
        self.make_binary = make_binary
        self.parts: list[MLMember] = []

    def fit(self, df: DataFrame, y: str = "y") -> OneVsRest:
        self.labels = label_set(df, y)
        tops = self.labels[1:] if len(self.labels) == 2 else self.labels
        self.parts = [
            self.make_binary().fit(df.withColumn("_bin", (F.col(y) == F.lit(v)).cast("int")), "_bin") for v in tops
        ]
        return self

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        columns, out = df.columns, df
        for i, part in enumerate(self.parts):
            out = part.add_probability(out, f"_b{i}")
        if len(self.parts) == 1:
            return out.select(*columns, F.col("_b0").alias(name))
        raw = F.array(*[F.col(f"_b{i}")[1] for i in range(len(self.parts))])
        shares = "transform(array(aggregate(_raw, 0D, (s, x) -> s + x)), t -> transform(_raw, x -> if(t = 0, 1D / size(_raw), x / t)))[0]"
        return out.withColumn("_raw", raw).select(*columns, F.expr(shares).alias(name))


class LinearSVM(MLMember):
    """Linear SVM of two classes with probabilities from a logistic fit on its margin."""

    def __init__(self, features: list[str], c: float = 1.0, max_iter: int = 50):
        super().__init__(features, lambda n: None, scaled=True)
        self.c, self.max_iter = c, max_iter

    def fit(self, df: DataFrame, y: str = "y") -> LinearSVM:
        self.labels = label_set(df, y)
        train = df.withColumn("label", label_index(y, self.labels))
        n = df.count()
        svm = LinearSVC(regParam=1.0 / (self.c * n), maxIter=self.max_iter, rawPredictionCol="margin", predictionCol="side")
        link = VectorAssembler(inputCols=["margin"], outputCol="margins")
        platt = LogisticRegression(featuresCol="margins", regParam=0.0, maxIter=50)
        self.model = Pipeline(stages=[*self.stages(df), svm, link, platt]).fit(train)
        return self


class AdaBoost(MLMember):
    """SAMME boosting over stumps: a pass over the rows by round, weights written every ``cut_every`` rounds."""

    def __init__(self, features: list[str], rounds: int = 50, learning_rate: float = 1.0, seed: int = 42, cut_every: int = 25):
        super().__init__(features, lambda n: None)
        self.rounds, self.learning_rate, self.seed, self.cut_every = rounds, learning_rate, seed, cut_every
        self.stumps: list[tuple[float, Stump]] = []

    def _assembled(self, df: DataFrame) -> DataFrame:
        """Adds ``_x``, the features as an array; a null or NaN is an error."""
        return self.stages(df)[0].transform(df).withColumn("_x", vector_to_array("features")).drop("features")

    def fit(self, df: DataFrame, y: str = "y") -> AdaBoost:
        self.labels = label_set(df, y)
        known = F.coalesce(label_index(y, self.labels).cast("int"), F.raise_error(F.lit("labels must not be null")).cast("int"))
        rows = self._assembled(df).select(F.col("_x").alias("x"), known.alias("yi"), F.lit(1.0).alias("w"))
        self.stumps = boosted(settle(rows, "boost-rows"), len(self.labels), self.rounds, self.learning_rate, self.seed, self.cut_every)
        if not self.stumps:
            raise ValueError("no stump is better than chance")
        return self

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        n = len(self.labels)
        total = sum(a for a, _ in self.stumps)
        stumps = F.array(*[
            F.struct(F.lit(a / total).alias("a"), *[F.lit(v).alias(k) for k, v in s._asdict().items()]) for a, s in self.stumps
        ])
        out = self._assembled(df).withColumn("_s", stumps)
        votes = F.expr("transform(_s, s -> struct(s.a as a, if(_x[s.feature] <= s.cut, s.left, s.right) as c))")
        out = out.select(*df.columns, votes.alias("_v"))
        score = f"aggregate(_v, 0D, (s, v) -> s + if(v.c = c, v.a, {num_lit(-1 / (n - 1))} * v.a))"
        raw = f"transform(sequence(0, {n - 1}), c -> exp({score} / {n - 1}))"
        shares = f"transform(array({raw}), e -> transform(e, x -> x / aggregate(e, 0D, (s, t) -> s + t)))[0]"
        return out.withColumn(name, F.expr(shares)).drop("_v")


def stump_of(model) -> Stump:
    """The stump of an MLlib tree of one level at most, as older runs have it."""
    root = model._java_obj.rootNode()
    if not root.subtreeDepth():
        return Stump(0, float("inf"), int(root.prediction()), int(root.prediction()))
    split = root.split()
    return Stump(split.featureIndex(), split.threshold(), int(root.leftChild().prediction()), int(root.rightChild().prediction()))


MAX_DEPTH = 30


def checked_depth(depth: int) -> int:
    """MLlib's trees end at 30 levels; a deeper wish is an error and not cut silently."""
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} is more than MLlib's limit of {MAX_DEPTH}")
    return depth


# --- factories: one by member name ---------------------------------------------------------
def fit_tree(features, depth=8, impurity="gini", min_leaf=1, seed=42, weight=None):
    def make(n):
        tree = DecisionTreeClassifier(maxDepth=checked_depth(depth), impurity=impurity, minInstancesPerNode=min_leaf, seed=seed)
        return tree.setWeightCol(weight) if weight else tree

    return MLMember(features, make)


class LogisticMember(MLMember):
    """L2 logistic regression with the inverse strength C of the sum of losses."""

    def __init__(self, features, c=1.0, max_iter=100):
        super().__init__(features, lambda n: None, scaled=True)
        self.c, self.max_iter = c, max_iter

    def fit(self, df: DataFrame, y: str = "y") -> LogisticMember:
        n = df.count()
        self.make = lambda k: LogisticRegression(regParam=1.0 / (self.c * n), maxIter=self.max_iter, standardization=False)
        return super().fit(df, y)


def fit_logistic(features, c=1.0, max_iter=100):
    return LogisticMember(features, c, max_iter)


def fit_sgd(features, penalty="l2", alpha=1e-4, max_iter=100):
    """Log-loss linear model with an L1, L2 or mixed penalty."""
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15}[penalty]
    return MLMember(
        features,
        lambda n: LogisticRegression(regParam=alpha, elasticNetParam=mix, maxIter=max_iter, standardization=False),
        scaled=True,
    )


def fit_linear_svm(features, c=1.0, max_iter=50):
    return OneVsRest(features, lambda: LinearSVM(features, c, max_iter))


def fit_mlp(features, hidden=(50,), max_iter=100, seed=42):
    return MLMember(
        features,
        lambda n: MultilayerPerceptronClassifier(layers=[len(features), *hidden, n], maxIter=max_iter, seed=seed),
        scaled=True,
    )


def fit_forest(features, trees=100, depth=10, min_leaf=1, impurity="gini", subset="auto", seed=42):
    return MLMember(
        features,
        lambda n: RandomForestClassifier(
            numTrees=trees, maxDepth=checked_depth(depth), minInstancesPerNode=min_leaf, impurity=impurity,
            featureSubsetStrategy=subset, seed=seed,
        ),
    )


def fit_boosted(features, trees=50, depth=3, step=0.1, subsample=1.0, min_leaf=1, seed=42):
    def binary():
        return MLMember(
            features,
            lambda n: GBTClassifier(
                maxIter=trees, maxDepth=checked_depth(depth), stepSize=step, subsamplingRate=subsample,
                minInstancesPerNode=min_leaf, seed=seed,
            ),
        )

    return OneVsRest(features, binary)


def fit_adaboost(features, rounds=50, learning_rate=1.0, seed=42):
    return AdaBoost(features, rounds, learning_rate, seed)


# --- parameter search ----------------------------------------------------------------------
class MacroF1(Evaluator):
    """F1 of class 1 for two labels, else the macro F1; the labels are those of the whole table."""

    def __init__(self, labels: list):
        super().__init__()
        self.labels = labels

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col("label").alias("y"), F.col("prediction").alias("pred"))
        found = metrics_from_confusion(confusion(rows), (), average_mode(self.labels)).first()
        return float(found["f1"]) if found and found["f1"] is not None else 0.0

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def draw_params(space: dict, trials: int, seed: int) -> list[dict]:
    """Seeded random draws. A space entry is a list of choices or ``(low, high, kind)``.

    Kinds: ``int``, ``float``, ``log_int`` and ``log_float``.
    """
    from math import exp, log

    rng = random.Random(seed)
    draws = []
    for _ in range(trials):
        one = {}
        for name, rule in space.items():
            if isinstance(rule, list):
                one[name] = rng.choice(rule)
                continue
            low, high, kind = rule
            x = exp(rng.uniform(log(low), log(high))) if kind.startswith("log") else rng.uniform(low, high)
            one[name] = min(int(high), max(int(low), round(x))) if kind.endswith("int") else x
        draws.append(one)
    return draws


# Search ranges of the members.
SPACES = {
    "Decision_Tree": {
        "maxDepth": (5, 30, "log_int"),
        "impurity": ["gini", "entropy"],
        "minInstancesPerNode": (1, 30, "int"),
    },
    "Logistic_Regression": {"regParam": (1e-5, 1e-1, "log_float"), "maxIter": (100, 1000, "int")},
    "SGD": {"regParam": (1e-5, 1e-1, "log_float"), "elasticNetParam": [0.0, 0.15, 1.0]},
    "Random_Forest": {
        "numTrees": (50, 500, "log_int"),
        "maxDepth": (5, 30, "log_int"),
        "minInstancesPerNode": (1, 30, "int"),
        "impurity": ["gini", "entropy"],
    },
    "Gradient_Boosting": {
        "maxIter": (50, 500, "log_int"),
        "stepSize": (1e-3, 1.0, "log_float"),
        "maxDepth": (3, 20, "int"),
        "minInstancesPerNode": (1, 30, "int"),
        "subsamplingRate": (0.5, 1.0, "float"),
    },
}


def search_params(
    df: DataFrame,
    features: list[str],
    make: Callable[[int], Estimator],
    space: dict,
    trials: int = 25,
    seed: int = 42,
    y: str = "y",
    parallelism: int = 4,
    folds: int | None = None,
) -> tuple[dict, list[tuple[dict, float]]]:
    """Best draw by cross-validated F1, and the score of every draw."""
    labels = label_set(df, y)
    k = folds or fold_count(df.count())
    rows = fold_assign(df, seed, y, k).withColumn("label", label_index(y, labels))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    # the folds are found once; every fit reads the written table
    rows = settle(rows.select(vector_to_array("features").alias("fv"), "label", "fold"), "folds")
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(array_to_vector("fv").alias("features"), "label", "fold")
    estimator = make(len(labels))
    draws = draw_params(space, trials, seed)
    maps = [{estimator.getParam(n): v for n, v in d.items()} for d in draws]
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=MacroF1(labels),
        numFolds=k,
        foldCol="fold",
        parallelism=parallelism,
    )
    scores = cv.fit(rows).avgMetrics
    ranked = list(zip(draws, scores))
    return max(ranked, key=lambda t: t[1])[0], ranked
