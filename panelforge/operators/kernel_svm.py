"""Support vector classification with a Gaussian kernel: random Fourier features and a linear machine on them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import durable
from . import ml as M


@dataclass(frozen=True)
class KernelSvm:
    """A fitted machine; it holds two numbers for each random feature and one for each of its inputs, whatever the rows."""

    names: list[str]
    c: float
    gamma: float
    width: int
    seed: int
    weights: list[float]
    intercept: float

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Adds the decision value; null where a feature is null."""
        whole = F.lit(True)
        for n in self.names:
            whole = whole & F.col(n).isNotNull()
        w, b, names = np.array(self.weights), self.intercept, self.names
        directions = _directions(len(names), self.gamma, self.width, self.seed)

        def decide(x: pd.Series) -> pd.Series:
            return pd.Series(_mapped(np.stack(x.to_numpy()).astype(float), *directions) @ w + b) if len(x) else pd.Series([], dtype=float)

        value = F.pandas_udf(decide, "double")(F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]))
        return df.withColumn(out, F.when(whole, value))

    def save(self, spark: SparkSession, path: str) -> None:
        """As one line of JSON, in any file system that Spark writes."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> KernelSvm:
        return KernelSvm(**json.loads(spark.read.text(path).first()[0]))


def _directions(dim: int, gamma: float, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.standard_normal((dim, width)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, width)


def _mapped(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Random features whose inner products approach exp(-gamma * squared distance)."""
    return np.sqrt(2.0 / w.shape[1]) * np.cos(x @ w + b)


def _vectors(names: Sequence[str], gamma: float, width: int, seed: int) -> Column:
    from pyspark.ml.functions import array_to_vector

    directions = _directions(len(names), gamma, width, seed)

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(_mapped(np.stack(x.to_numpy()).astype(float), *directions))) if len(x) else pd.Series([], dtype=object)

    return array_to_vector(F.pandas_udf(run, "array<double>")(F.array(*[F.col(n).cast("double") for n in names])))


def fit(train: DataFrame, names: Sequence[str], c: float = 1.0, gamma: float = 0.1, label: str = "label", width: int = 256, seed: int = 42, rounds: int = 50) -> KernelSvm:
    """Fits rows with labels 1 and -1 and features without null.  ``c`` is the usual cost: Spark's penalty is 1 / (c n)."""
    from pyspark.ml.classification import LinearSVC

    rows = train.select((F.col(label) > 0).cast("double").alias("_label"), _vectors(names, gamma, width, seed).alias("_x"))
    rows = durable(rows, "svm-rows")
    n = rows.count()
    model = LinearSVC(featuresCol="_x", labelCol="_label", regParam=1.0 / (c * max(n, 1)), maxIter=rounds, standardization=False).fit(rows)
    return KernelSvm(list(names), float(c), float(gamma), width, seed, [float(x) for x in model.coefficients.toArray()], float(model.intercept))


def grid_search(train: DataFrame, valid: DataFrame, names: Sequence[str], costs: Sequence[float], gammas: Sequence[float], label: str = "label", **options) -> tuple[KernelSvm, list[dict]]:
    """The machine with the best AUC on ``valid``, then the best accuracy, then the smaller cost and gamma; and the figures of each."""
    results, machines = [], {}
    for c in costs:
        for g in gammas:
            machine = machines[c, g] = fit(train, names, c, g, label, **options)
            t, v = (M.classifier_figures(machine.score(d), "score", label).first() for d in (train, valid))
            results.append({"c": c, "gamma": g, "valid_auc": v.auc, "valid_accuracy": v.accuracy, "train_auc": t.auc, "train_accuracy": t.accuracy, "valid_sample_count": v.sample_count, "train_sample_count": t.sample_count})
    results.sort(key=lambda r: (-(r["valid_auc"] or 0.0), -(r["valid_accuracy"] or 0.0), r["c"], r["gamma"]))
    return machines[results[0]["c"], results[0]["gamma"]], results


@dataclass(frozen=True)
class Trained:
    """What the training flow gives: the machine (fitted on all labelled rows with the best parameters), the components
    that its inputs went through, their shares of variance, and the figures of each setting."""

    machine: KernelSvm
    transform: object
    explained: list[float]
    results: list[dict]

    def score(self, panel: DataFrame) -> DataFrame:
        return self.machine.score(self.transform(panel))


def train_pipeline(features: DataFrame, labels: DataFrame, names: Sequence[str], costs: Sequence[float] = (0.1, 1.0, 10.0), gammas: Sequence[float] = (0.01, 0.1), pca: int | None = None, share: float = 0.1, seed: int = 42, **options) -> Trained:
    """Labelled rows, split, components fitted on the training part alone, grid search, and the final fit.  Without labelled
    rows there is nothing to fit: ``ValueError``."""
    rows = durable(M.supervised(features, labels, names), "svm-set")
    if rows.isEmpty():
        raise ValueError("no row has a label and all features")
    train, valid = M.train_valid(rows, share, seed)
    transform, explained = M.fit_pca(train, names, pca)
    made = [f"pc_{i + 1:03d}" for i in range(len(explained))]
    train, valid = durable(transform(train), "svm-train"), durable(transform(valid), "svm-valid")
    best, results = grid_search(train, valid, made, costs, gammas, seed=seed, **options)
    final = fit(train.unionByName(valid), made, best.c, best.gamma, seed=seed, **options)
    return Trained(final, transform, explained, results)


def selection_scores(panel: DataFrame, trained: Trained, names: Sequence[str], size: str | None = None) -> DataFrame:
    """(dt, symbol, value) of dates on which all features are complete: sizes filled by the date's median, features cleaned as for training."""
    d = M.gate_complete_dates(panel, names)
    if size:
        d = d.withColumn(size, M.median_filled(size))
    d = M.preprocessed(d, names, size)
    return trained.score(d.select("dt", "symbol", *names)).select("dt", "symbol", F.col("score").alias("value"))
