"""Run registry: a parquet table of runs and saved models beside it."""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demur.sources.members import load_member, save_member


class RunNotFound(ValueError):
    """No such experiment, or no such run in it."""


RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("model_path", T.StringType()),
    ]
)


def experiment_key(name: Column, version: str, seed: int) -> Column:
    """Lower-case name without separators, version and seed."""
    return F.concat_ws("_", F.lower(F.regexp_replace(name, "[-_ ]", "")), F.lit(version), F.lit(str(seed)))


def experiment_name(name: str, version: str, seed: int) -> str:
    """The same for one name."""
    return "_".join([name.translate(str.maketrans("", "", "-_ ")).lower(), version, str(seed)])


def newest_run(runs: DataFrame) -> DataFrame:
    """The latest run of each (experiment, run name): a combined maximum, no sort of a group."""
    latest = F.max(F.struct("started_at", "run_id", "params", "metrics", "model_path"))
    if any(t.startswith("map") for _, t in runs.dtypes):
        # maps have no order; (time, id) is unique, so the rest follows by max_by
        stamp = F.struct("started_at", "run_id")
        latest = F.max_by(F.struct("started_at", "run_id", "params", "metrics", "model_path"), stamp)
    return runs.groupBy("experiment", "run_name").agg(latest.alias("r")).select("experiment", "run_name", "r.*")


class Registry:
    """Appends and finds runs under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @property
    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/runs")

    def _exists(self) -> bool:
        try:
            return bool(self.runs.inputFiles())
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise

    def append(
        self, experiment: str, run_name: str, params: dict, metrics: dict, model=None, started_at=None
    ) -> str:
        """Saves the fitted member or selector and adds one run; metrics without a value are left out."""
        run_id = uuid.uuid4().hex
        path = None
        if model is not None:
            path = f"{self.path}/models/{run_id}"
            save_member(self.spark, model, path)
        row = (
            run_id,
            experiment,
            run_name,
            started_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
            {k: str(v) for k, v in params.items()},
            {k: float(v) for k, v in metrics.items() if v is not None},
            path,
        )
        one = self.spark.createDataFrame([row], RUN_SCHEMA)
        one.write.mode("append").parquet(f"{self.path}/runs")
        return run_id

    def lookup(self, experiment: str, run_name: str) -> dict:
        """The newest run; an unknown experiment or run is an error."""
        known = self.runs.where(F.col("experiment") == experiment) if self._exists() else None
        if known is None or not known.head(1):
            raise RunNotFound(f"experiment {experiment!r} not found")
        found = newest_run(known.where(F.col("run_name") == run_name)).head(1)
        if not found:
            raise RunNotFound(f"run {run_name!r} not found in experiment {experiment!r}")
        return found[0].asDict()

    def _claim_file(self, experiment: str, run_name: str):
        """File system and path of a run's claim."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{quote(experiment, safe='')}--{quote(run_name, safe='')}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def claim(self, experiment: str, run_name: str, stale_after: float = 86_400.0) -> bool:
        """Takes the right to make a run; only one of several sessions gets it.

        The claim is a file that is created only if it is not there, in one step of the file system. A claim
        older than ``stale_after`` seconds belongs to a session that died, and is removed first.
        """
        fs, path = self._claim_file(experiment, run_name)
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale_after:
            fs.delete(path, False)
        if fs.getScheme() == "file":  # Hadoop's local files are looked for first and created then
            local = path.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        try:
            fs.create(path, False).close()
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def release(self, experiment: str, run_name: str) -> None:
        """Gives a claim back."""
        fs, path = self._claim_file(experiment, run_name)
        fs.delete(path, False)

    def load_pool(self, experiments: str | list[str], names: list[str]) -> dict[str, dict]:
        """The newest run of every name, from one experiment for all or one for each."""
        if isinstance(experiments, str):
            experiments = [experiments] * len(names)
        if len(experiments) != len(names):
            raise ValueError("give one experiment, or as many as there are models")
        return {n: self.lookup(e, n) for e, n in zip(experiments, names)}

    def load_member(self, experiment: str, run_name: str):
        """The fitted member or selector of the newest run; a run without one counts as not found."""
        run = self.lookup(experiment, run_name)
        if run["model_path"] is None:
            raise RunNotFound(f"run {run_name!r} in experiment {experiment!r} has no stored model")
        return load_member(self.spark, run["model_path"])

    def load_members(self, experiments: str | list[str], names: list[str]) -> dict:
        """The fitted member of every name, in order; ``Pool`` takes it as it is."""
        if isinstance(experiments, str):
            experiments = [experiments] * len(names)
        if len(experiments) != len(names):
            raise ValueError("give one experiment, or as many as there are models")
        return {n: self.load_member(e, n) for e, n in zip(experiments, names)}


def load_pool(runs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found, missing)`` for a table of requests ``(experiment, run_name)``."""
    newest = newest_run(runs)
    keys = ["experiment", "run_name"]
    return requests.join(newest, keys), requests.join(newest.select(*keys), keys, "left_anti")
