"""Fitted pool members and selectors on disk: a JSON description, with MLlib models and tables beside it.

Labels and parameters go through JSON, so they keep type and value. What grows with the data (the
references of a neighbour member or of a selector) is written as a table by its tasks.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import SparkSession

from demur.operators.bayes import QDA, GaussianNB
from demur.operators.des import CompetenceSelector
from demur.operators.foreign import ForeignMember
from demur.operators.learners import AdaBoost, MLMember, OneVsRest, stump_of
from demur.operators.mlp import MLP
from demur.operators.neighbors import KNN
from demur.operators.sgd import SGD
from demur.operators.stumps import Stump
from demur.operators.trees import Growth, TreeMember

BY_NUMBERS = {c.__name__: c for c in (GaussianNB, MLP, QDA, SGD)}


def _write(spark: SparkSession, member, path: str) -> dict:
    about = {"kind": type(member).__name__, "labels": member.labels}
    if isinstance(member, tuple(BY_NUMBERS.values())):
        return about | asdict(member)
    about["features"] = member.features
    if isinstance(member, KNN):
        member.refs.write.parquet(f"{path}/refs")
        return about | {"k": member.k, "weights": member.weights, "p": member.p}
    if isinstance(member, ForeignMember):
        spark.createDataFrame([(bytearray(member.packed()),)], "object binary").write.parquet(f"{path}/object")
        return about | {"mark": member.mark(), "max_rows": member.max_rows}
    if isinstance(member, TreeMember):
        member.nodes.write.parquet(f"{path}/nodes")
        return about | {"settings": member.settings()}
    if isinstance(member, OneVsRest):
        return about | {"parts": [_write(spark, part, f"{path}/part-{i}") for i, part in enumerate(member.parts)]}
    if isinstance(member, AdaBoost):
        return about | {"alphas": [float(a) for a, _ in member.stumps], "stumps": [list(stump) for _, stump in member.stumps]}
    if isinstance(member, MLMember):
        member.model.write().save(f"{path}/model")
        return about | {"kind": "MLMember"}
    raise TypeError(f"a member of type {type(member).__name__} cannot be stored")


def _read(spark: SparkSession, about: dict, path: str):
    kind, labels = about["kind"], about["labels"]
    if kind in BY_NUMBERS:
        return BY_NUMBERS[kind](**{k: v for k, v in about.items() if k != "kind"})
    if kind == "KNN":
        member = KNN(about["features"], about["k"], about["weights"], about["p"])
        member.refs = spark.read.parquet(f"{path}/refs")
    elif kind == "ForeignMember":
        data = bytes(spark.read.parquet(f"{path}/object").first()["object"])
        return ForeignMember.unpacked(data, about["mark"], about["features"], labels, about["max_rows"])
    elif kind == "TreeMember":
        settings = dict(about["settings"])
        member = TreeMember(about["features"], Growth(**settings.pop("how")), **settings)
        member.nodes = spark.read.parquet(f"{path}/nodes")
    elif kind == "OneVsRest":
        member = OneVsRest(about["features"], _refuse)
        member.parts = [_read(spark, a, f"{path}/part-{i}") for i, a in enumerate(about["parts"])]
    elif kind == "AdaBoost":
        member = AdaBoost(about["features"], rounds=len(about["alphas"]))
        if "stumps" in about:
            stumps = [Stump(*s) for s in about["stumps"]]
        else:  # a run of an older version
            stumps = [stump_of(m) for m in PipelineModel.load(f"{path}/model").stages[1:]]
        member.stumps = list(zip(about["alphas"], stumps))
    elif kind == "MLMember":
        member = MLMember(about["features"], _refuse)
        member.model = PipelineModel.load(f"{path}/model")
    else:
        raise ValueError(f"unknown kind of member: {kind!r}")
    member.labels = labels
    return member


def _refuse(*_):
    raise ValueError("a member that was read back is not fitted again")


def _write_selector(selector: CompetenceSelector, path: str) -> dict:
    settings = {f.name: getattr(selector, f.name) for f in fields(selector) if f.name not in ("refs", "model", "meta")}
    selector.refs.write.parquet(f"{path}/refs")
    given = selector.meta is not None and selector.meta != "naive_bayes"
    if given:
        Pipeline(stages=[selector.meta]).write().save(f"{path}/meta")
    if selector.model is not None:
        PipelineModel(stages=[selector.model]).write().save(f"{path}/model")
    return {
        "kind": "CompetenceSelector",
        "settings": settings,
        "meta": "given" if given else selector.meta,
        "fitted": selector.model is not None,
    }


def _read_selector(spark: SparkSession, about: dict, path: str) -> CompetenceSelector:
    meta = Pipeline.load(f"{path}/meta").getStages()[0] if about["meta"] == "given" else about["meta"]
    selector = CompetenceSelector(**about["settings"], meta=meta)
    selector.refs = spark.read.parquet(f"{path}/refs")
    if about["fitted"]:
        selector.model = PipelineModel.load(f"{path}/model").stages[0]
    return selector


def save_member(spark: SparkSession, member, path: str) -> None:
    """Writes a fitted member or selector below ``path``; the description comes last, so it marks a whole write."""
    about = _write_selector(member, path) if isinstance(member, CompetenceSelector) else _write(spark, member, path)
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


def load_member(spark: SparkSession, path: str):
    """The member or selector that ``save_member`` wrote; it scores like the one that was saved."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    return (_read_selector if about["kind"] == "CompetenceSelector" else _read)(spark, about, path)
