"""Any fitted object with ``predict_proba`` as a pool member: scored by Arrow batches in the tasks."""

from __future__ import annotations

import platform

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demur.operators.metrics import label_set
from demur.session import quoted


class ForeignMember:
    """``model``: has ``predict_proba(matrix)`` and, once fitted, ``classes_``.

    An unfitted one is fitted on the driver on at most ``max_rows`` rows, those with the smallest hash of all
    values; fitting on everything is for the distributed members. Classes that the sample lacks get probability 0.
    """

    def __init__(self, model, features: list[str], max_rows: int = 100_000):
        self.model, self.features, self.max_rows = model, features, max_rows
        self.labels: list = [v.item() if hasattr(v, "item") else v for v in getattr(model, "classes_", [])]

    def fit(self, df: DataFrame, y: str = "y") -> ForeignMember:
        self.labels = label_set(df, y)
        columns = [F.col(quoted(f)).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]
        rows = df.where(F.col(y).isNotNull()).select(*columns, F.col(y).alias("y"))
        names = [c for c in rows.columns]
        sample = rows.orderBy(F.xxhash64(*names), *names).limit(self.max_rows).toArrow()
        x = np.stack([sample.column(c).to_numpy() for c in names[:-1]], axis=1)
        self.model.fit(x, np.array(sample.column("y").to_pylist()))
        return self

    def add_probability(self, df: DataFrame, name: str) -> DataFrame:
        model, labels = self.model, self.labels

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def score(x: pa.Array) -> pa.Array:
            n = len(x)
            matrix = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            out = np.zeros((n, len(labels)))
            if n:
                at = [labels.index(v.item() if hasattr(v, "item") else v) for v in model.classes_]
                out[:, at] = model.predict_proba(matrix)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(labels)), pa.array(out.ravel()))

        x = F.array(*[F.col(quoted(f)).cast("double") for f in self.features])
        return df.withColumn(name, score(x))

    def mark(self) -> dict:
        """What the stored object depends on."""
        kind = type(self.model)
        return {"python": platform.python_version(), "numpy": np.__version__, "class": f"{kind.__module__}.{kind.__qualname__}"}

    def packed(self) -> bytes:
        return cloudpickle.dumps(self.model)

    @classmethod
    def unpacked(cls, data: bytes, mark: dict, features: list[str], labels: list, max_rows: int) -> ForeignMember:
        """The stored member; refuses an object that other versions wrote."""
        here = {"python": platform.python_version(), "numpy": np.__version__}
        wrong = {k: mark.get(k) for k, v in here.items() if mark.get(k) != v}
        if wrong:
            raise ValueError(f"the stored {mark.get('class')} was written with {wrong}, here are {here}")
        member = cls(cloudpickle.loads(data), features, max_rows)
        member.labels = labels
        return member
