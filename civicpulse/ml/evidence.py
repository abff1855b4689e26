"""Facts that show a model was fitted: worked out from the model and its training rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassificationModel,
    LinearSVCModel,
    LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.ml.classifiers import MultiLabelModel
from civicpulse.ml.labels import binarize
from civicpulse.ml.linear import LinearModel, Loss, logistic_loss
from civicpulse.ml.trees import TreesModel

# A quasi-Newton run stops on small relative gains; its gradient is then this small.
GRADIENT_WITHIN = 1e-2


def is_fitted(model: MultiLabelModel | LinearModel | TreesModel, training: DataFrame) -> bool:
    """Whether every class's model passes the test of its kind; constants pass."""
    if isinstance(model, LinearModel):
        steady = bool((model.gradient <= model.settings.tolerance * model.start).all())
        return steady and _agree(model.losses, _losses(model, training, model.settings.loss, model.live))
    if isinstance(model, TreesModel):
        whole = len(model.losses) in (0, model.settings.trees + 1)
        steady = whole and bool((model.losses[1:] <= model.losses[:-1] + 1e-9).all())
        return steady and (not len(model.losses) or _agree(model.losses[-1], _losses(model, training, logistic_loss, model.live)))
    tests = {
        LogisticRegressionModel: _is_stationary,
        LinearSVCModel: _separates,
        GBTClassificationModel: _descends,
    }
    for name, fitted in zip(model.classes, model.models):
        if not isinstance(fitted, int):
            label = F.array_contains("labels", name).cast("double")
            rows = training.select("features", label.alias("label"))
            if not tests[type(fitted)](fitted, rows):
                return False
    return True


def _losses(model: LinearModel | TreesModel, rows: DataFrame, loss: Loss, live: np.ndarray) -> np.ndarray:
    """Each live class's loss, summed over the scores that ``model`` gives ``rows`` beside their truth."""
    scored = model.transform(rows.select("features", "labels")).select("scores", binarize(model.classes).alias("truth"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(live))
        for batch in batches:
            for scores, truth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sign = 2.0 * np.array(truth)[live] - 1
                total += loss(sign * np.array(scores)[live])[0]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["label", "loss"])

    found = scored.mapInArrow(summed, "label int, loss double").groupBy("label").agg(F.sum("loss").alias("loss")).collect()
    by_label = {r.label: r.loss for r in found}
    return np.array([by_label.get(k, 0.0) for k in range(len(live))])


def _agree(one: np.ndarray, two: np.ndarray) -> bool:
    return len(one) == len(two) and bool(np.allclose(one, two, rtol=1e-6, atol=1e-6))


def gradient_norm(model: LogisticRegressionModel, rows: DataFrame) -> float:
    """Norm of the penalised logistic loss's gradient at the model's weights."""
    excess = vector_to_array("probability")[1] - F.col("label")
    scored = model.transform(rows).select(excess.alias("e"), F.unwrap_udt("features").alias("x"))
    n = scored.count()
    cells = scored.select(
        "e", F.inline(F.arrays_zip(F.col("x.indices").alias("i"), F.col("x.values").alias("v")))
    )
    sums = cells.groupBy("i").agg(F.sum(F.col("e") * F.col("v")).alias("s"))
    gradient = [w * model.getRegParam() for w in model.coefficients.toArray()]
    for row in sums.collect():  # one row per feature at most
        gradient[row.i] += row.s / n
    level = scored.agg(F.avg("e")).first()[0]  # the intercept is not penalised
    return math.sqrt(sum(g * g for g in gradient) + level * level)


def _is_stationary(model: LogisticRegressionModel, rows: DataFrame) -> bool:
    return gradient_norm(model, rows) <= GRADIENT_WITHIN


def _hinge(label: Column, margin: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - (2 * label - 1) * margin)


def _separates(model: LinearSVCModel, rows: DataFrame) -> bool:
    """The objective lies below that of the zero model, and predictions follow the margin."""
    margin = vector_to_array("rawPrediction")[1]
    facts = model.transform(rows).agg(
        F.avg(_hinge(F.col("label"), margin)).alias("hinge"),
        F.min(((margin > model.getThreshold()) == (F.col("prediction") == 1)).cast("int")).alias("same"),
    ).first()
    weights = model.coefficients.toArray()
    objective = facts.hinge + model.getRegParam() / 2 * float(weights @ weights)
    return bool(objective <= 1.0 and facts.same == 1)


def _descends(model: GBTClassificationModel, rows: DataFrame) -> bool:
    """All rounds were run, and the training loss never rises from one to the next."""
    losses = model.evaluateEachIteration(rows)
    steady = all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    return model.getNumTrees == model.getMaxIter() == len(losses) and steady
