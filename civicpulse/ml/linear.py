"""Linear one-vs-rest classifiers, all classes in one pass.

The weights of all classes are one matrix. A pass over the blocks adds up, per task, every
class's loss and gradient; tasks' sums are added in the JVM, and the driver, which holds a
vector per class, makes the next step of limited-memory BFGS for each. The number of
passes does not depend on the number of classes: a class that has converged waits.

The objective is ``|w|^2 / 2 + C * sum(loss)`` with the intercept a weight like the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.ml.blocks import class_counts, feature_count, parsed, read_blocks, settled, to_blocks, vector_cells

Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
HISTORY = 10


def logistic_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative at ``margin = sign * score``."""
    return np.logaddexp(0.0, -margin), -np.exp(-np.logaddexp(0.0, margin))


def squared_hinge_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = np.maximum(0.0, 1.0 - margin)
    return short * short, -2.0 * short


@dataclass(frozen=True)
class Linear:
    """What is fitted: a loss, its weight ``c``, and when to stop.

    A class has converged when no part of its gradient exceeds ``tolerance`` times the
    greatest part at the start.
    """

    loss: Loss
    c: float = 1.0
    tolerance: float = fixed.LINEAR_TOLERANCE
    passes: int = 1000

    def fit(self, train: DataFrame, classes: Sequence[str], features: str = "features", labels: str = "labels") -> "LinearModel":
        blocks = settled(to_blocks(train, classes, features, labels), "blocks").persist()
        try:
            n, positives = class_counts(blocks, len(classes))
            constant = (positives == 0) | (positives == n)
            weights = np.zeros((len(classes), feature_count(train, features) + 1))
            live = np.nonzero(~constant)[0]
            gradient, start, value = np.zeros(len(classes)), np.zeros(len(classes)), np.empty(0)
            if len(live):
                weights[live], gradient[live], start[live], value = _minimize(
                    lambda w: _pass(blocks, self, w, live, len(classes)), weights[live], self.tolerance, self.passes
                )
        finally:
            blocks.unpersist()
        weights[constant, -1] = np.where(positives[constant] > 0, 1.0, -1.0)
        losses = (value - (weights[live] ** 2).sum(axis=1) / 2) / self.c
        return LinearModel(list(classes), weights, gradient, start, live, losses, self)


def logistic(c: float = 1.0) -> Linear:
    """M8: L2 logistic regression."""
    return Linear(logistic_loss, c)


def linear_svc(c: float = 1.0) -> Linear:
    """L2 linear support vectors with squared hinge."""
    return Linear(squared_hinge_loss, c)


def _pass(blocks: DataFrame, task: Linear, weights: np.ndarray, live: np.ndarray, n_classes: int):
    """``(objectives, gradients)`` of the ``live`` classes at ``weights`` (classes x features)."""
    spark = blocks.sparkSession
    sent, loss = spark.sparkContext.broadcast(weights), task.loss
    names = ["label", "sums"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        across = held[:, :-1].T
        total = np.zeros((len(held), held.shape[1] + 1))
        for block in read_blocks(batches, n_classes):
            sign = 2.0 * block.targets[:, live] - 1
            value, slope = loss(sign * (block.times(across) + held[:, -1]))
            slope *= sign
            owner = block.owner
            for k in range(len(held)):
                total[k, :-2] += np.bincount(block.indices, block.values * slope[owner, k], across.shape[0])
            total[:, -2] += slope.sum(axis=0)
            total[:, -1] += value.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names
        )

    rows = (
        blocks.mapInArrow(sums, parsed("label int, sums array<double>"))
        .groupBy("label")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        .toPandas()  # a vector per class
        .sort_values("label")
    )
    sent.destroy()
    total = np.stack(rows["sums"].to_numpy())
    return (
        task.c * total[:, -1] + (weights * weights).sum(axis=1) / 2,
        task.c * total[:, :-1] + weights,
    )


def _direction(gradient: np.ndarray, steps: list, changes: list) -> np.ndarray:
    """Descent direction of one class by the two-loop recursion."""
    q, alphas = gradient.copy(), []
    for s, y in zip(reversed(steps), reversed(changes)):
        alpha = (s @ q) / (s @ y)
        q -= alpha * y
        alphas.append(alpha)
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, alpha in zip(steps, changes, reversed(alphas)):
        q += (alpha - (y @ q) / (s @ y)) * s
    return -q


def _minimize(evaluate, start: np.ndarray, tolerance: float, passes: int) -> tuple[np.ndarray, ...]:
    """``(weights, greatest gradient part at the end, at the start, objective)``; each pass tries a step of every class."""
    k = len(start)
    weights = start.copy()
    value, gradient = evaluate(weights)
    begun = np.abs(gradient).max(axis=1)
    goal = tolerance * begun
    steps, changes = [[] for _ in range(k)], [[] for _ in range(k)]
    way = -gradient
    length = np.minimum(1.0, 1.0 / np.maximum(np.linalg.norm(gradient, axis=1), 1e-12))
    for _ in range(passes):
        busy = np.abs(gradient).max(axis=1) > goal
        if not busy.any():
            break
        trial = weights + np.where(busy, length, 0.0)[:, None] * way
        new_value, new_gradient = evaluate(trial)
        for at in np.nonzero(busy)[0]:
            slope = gradient[at] @ way[at]
            enough = value[at] + 1e-4 * length[at] * slope
            # At the end of the road objectives agree to rounding: then the gradient decides.
            flat = abs(new_value[at] - value[at]) <= 1e-12 * max(1.0, abs(value[at]))
            if new_value[at] > enough and not (flat and np.abs(new_gradient[at]).max() <= np.abs(gradient[at]).max()):
                length[at] /= 2
                if length[at] < 1e-10:  # no way down from here: start anew along the gradient
                    steps[at].clear()
                    changes[at].clear()
                    way[at], length[at] = -gradient[at], 1.0 / max(np.linalg.norm(gradient[at]), 1e-12)
                continue
            step, change = trial[at] - weights[at], new_gradient[at] - gradient[at]
            weights[at], value[at], gradient[at] = trial[at], new_value[at], new_gradient[at]
            if step @ change > 1e-12 * (change @ change):
                steps[at].append(step)
                changes[at].append(change)
                if len(steps[at]) > HISTORY:
                    steps[at].pop(0)
                    changes[at].pop(0)
            way[at], length[at] = _direction(gradient[at], steps[at], changes[at]), 1.0
    return weights, np.abs(gradient).max(axis=1), begun, value


@dataclass(frozen=True)
class LinearModel:
    """A weight vector per class, the intercept last; a constant class has only that.

    ``gradient`` and ``start`` are the greatest part of the objective's gradient at these
    weights and at zero; ``losses`` are the ``live`` (not constant) classes' summed losses.
    """

    classes: list[str]
    weights: np.ndarray
    gradient: np.ndarray
    start: np.ndarray
    live: np.ndarray
    losses: np.ndarray
    settings: Linear

    def transform(self, df: DataFrame, output: str = "predicted", scores: str = "scores", features: str = "features") -> DataFrame:
        """Add ``scores array<double>`` and ``predicted array<int>``, in class order. No shuffle."""
        indices, values = vector_cells(F.col(features))
        weights = self.weights

        @F.pandas_udf("array<double>")
        def margins(at: pd.Series, of: pd.Series) -> pd.Series:
            return pd.Series([weights[:, i] @ v + weights[:, -1] for i, v in zip(at, of)])

        return df.withColumn(scores, margins(indices, values)).withColumn(
            output, F.transform(scores, lambda s: (s > 0).cast("int"))
        )
