"""One-vs-rest multi-label classifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed


def logistic(n: int, c: float = 1.0) -> LogisticRegression:
    """M8: L2 logistic regression; strength ``C`` over ``n`` rows is ``1 / (C n)`` per row."""
    return LogisticRegression(
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=100,
        tol=fixed.LINEAR_TOLERANCE,
    )


def linear_svc(n: int, c: float = 1.0) -> LinearSVC:
    """L2 linear SVM. Spark's loss is the plain hinge, not the squared one."""
    return LinearSVC(
        regParam=1.0 / (c * n),
        standardization=False,
        maxIter=1000,
        tol=fixed.LINEAR_TOLERANCE,
    )


def boosted_trees(
    n: int,
    trees: int = fixed.BOOSTED_TREES,
    depth: int = fixed.BOOSTED_DEPTH,
    rate: float = fixed.BOOSTED_RATE,
) -> GBTClassifier:
    """M9: gradient-boosted trees over histogram splits, logistic loss."""
    return GBTClassifier(
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        # Spark's default: term weights are sparse, and the statistics of a level grow with it.
        maxBins=32,
        seed=42,
        # Room for the statistics of a whole tree level, so a level is one pass.
        maxMemoryInMB=1024,
    )


@dataclass(frozen=True)
class MultiLabelModel:
    """One binary model per class; a class seen always or never is a constant."""

    classes: list[str]
    models: list[Model | int]

    def transform(self, df: DataFrame, output: str = "predicted") -> DataFrame:
        """Add ``predicted array<int>``, 0/1 in class order."""
        keep = df.columns
        columns = []
        for i, model in enumerate(self.models):
            if isinstance(model, int):
                columns.append(F.lit(model))
                continue
            name = f"_p{i}"
            df = model.copy({model.predictionCol: name}).transform(df)
            df = df.drop("rawPrediction", "probability")
            columns.append(F.col(name).cast("int"))
        return df.select(*keep, F.array(*columns).alias(output))


def fit_one_vs_rest(
    train: DataFrame,
    classes: Sequence[str],
    estimator: Callable[[int], Estimator],
    features: str = "features",
    labels: str = "labels",
    parallelism: int = 4,
) -> MultiLabelModel:
    """Fit ``estimator(n)`` once per class on feature rows the caller has persisted.

    ``parallelism`` fits run at once so that their small stages overlap.
    """
    n = train.count()
    rows = train.select(features, labels)
    seen = dict(
        rows.select(F.explode(F.array_distinct(labels)).alias("label"))
        .filter(F.col("label").isin(list(classes)))
        .groupBy("label")
        .count()
        .collect()  # one row per class
    )

    def fit(name: str) -> Model | int:
        positives = seen.get(name, 0)
        if positives in (0, n):
            return int(positives > 0)
        target = F.array_contains(F.col(labels), name).cast("double")
        return estimator(n).fit(rows.select(features, target.alias("label")))

    with ThreadPool(min(parallelism, max(len(classes), 1))) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(fit), classes)
    return MultiLabelModel(list(classes), models)
