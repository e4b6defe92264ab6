"""A pool of named members that scores rows into one ``probas`` column."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demur.functions.fusion import model_labels
from demur.operators.bayes import GaussianNB, add_softmax, fit_gaussian_nb_pool
from demur.session import quoted


class Member(Protocol):
    """Anything that can be fitted and adds one ``array<double>`` of class probabilities."""

    labels: list

    def fit(self, df: DataFrame, y: str = "y"): ...

    def add_probability(self, df: DataFrame, name: str) -> DataFrame: ...


@dataclass
class Pool:
    """Ordered members by name."""

    members: dict

    def __len__(self) -> int:
        return len(self.members)

    def __getitem__(self, name: str):
        return self.members[name]

    @property
    def names(self) -> list[str]:
        return list(self.members)

    @property
    def labels(self) -> list:
        """Class labels, which all members must share."""
        sets = {tuple(m.labels) for m in self.members.values()}
        if len(sets) != 1:
            raise ValueError("the members were fitted on different label sets")
        return list(sets.pop())

    def fit(self, df: DataFrame, y: str = "y") -> Pool:
        """Fits the members that are not fitted yet; naive Bayes members share one pass."""
        waiting = [m for m in self.members.values() if not m.labels]
        together = [m for m in waiting if isinstance(m, GaussianNB)]
        if together:
            fit_gaussian_nb_pool(together, df, y)
        for m in waiting:
            if not isinstance(m, GaussianNB):
                m.fit(df, y)
        return self

    def predict_proba(self, df: DataFrame, column: str = "probas") -> DataFrame:
        """Adds ``probas``: models outside, classes inside."""
        names = [f"_p{i}" for i in range(len(self))]
        by_log = {}
        for name, m in zip(names, self.members.values()):
            if hasattr(m, "log_scores"):
                by_log[name] = m.log_scores()
            else:
                df = m.add_probability(df, name)
        if by_log:
            df = add_softmax(df, by_log)
        return df.withColumn(column, F.array(*names)).drop(*names)

    def predict(self, scored: DataFrame, probas: str = "probas") -> DataFrame:
        """Adds ``preds array<int>`` with the class index by model."""
        return scored.withColumn("preds", model_labels(probas))

    def subset(self, keep: list[str] | None = None, drop: list[str] = ()) -> Pool:
        """A pool of the kept members, in the old order."""
        names = [n for n in self.names if (keep is None or n in keep) and n not in drop]
        return Pool({n: self.members[n] for n in names})

    def first(self, n: int) -> Pool:
        return Pool(dict(list(self.members.items())[:n]))

    def slice_probas(self, names: list[str], probas: str = "probas") -> Column:
        """The scores of some members out of an already scored row."""
        at = [self.names.index(n) for n in self.names if n in names]
        return F.array(*[F.col(quoted(probas))[i] for i in at])
