"""Train and score the three classifiers on silver tickets."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame

from civicpulse import fixed_values as fixed
from civicpulse.functions.text import Tokenizer, words
from civicpulse.ml.classifiers import MultiLabelModel, fit_one_vs_rest
from civicpulse.ml.features import fit_tfidf, with_tokens
from civicpulse.ml.labels import binarize, label_classes, labelled, split
from civicpulse.ml.linear import Linear, LinearModel, linear_svc, logistic
from civicpulse.ml.trees import BoostedTrees, TreesModel, boosted_trees
from civicpulse.session import shared_folder, via_table

# What fits all classes in one go, or one estimator per class, given the number of rows.
Fit = Linear | BoostedTrees | Callable[[int], Estimator]
Fitted = LinearModel | TreesModel | MultiLabelModel

# Model name -> (what fits it, least document count of a term).
MODELS: dict[str, tuple[Fit, int]] = {
    "logistic": (logistic(), fixed.MIN_DF),
    "boosted_trees": (boosted_trees(), fixed.MIN_DF),
    "linear_svc": (linear_svc(), 1),
}


@dataclass(frozen=True)
class Classified:
    """Classes, per model the test rows, and what was fitted on what.

    Test rows are ``(key, truth, predicted)``, with ``scores`` where the model has them.

    Feature rows stay cached until :meth:`close`; results are tables of their own.
    """

    classes: list[str]
    results: dict[str, DataFrame]
    fitted: dict[str, Fitted]
    training: dict[str, DataFrame]
    _cached: list[DataFrame]

    def close(self) -> None:
        for df in self._cached:
            df.unpersist()


def classify(
    tickets: DataFrame,
    key: str = "ticket_id",
    text: str = "comment",
    labels: str = "type",
    models: Mapping[str, tuple[Fit, int]] = MODELS,
    tokenizer: Tokenizer = words,
) -> Classified:
    """Train and score; texts are tokenized once, features made once per vocabulary setting."""
    shared_folder(tickets.sparkSession)  # Spark's own trees cut their lineage there
    rows = with_tokens(labelled(tickets.select(key, text, labels), text, labels), text, tokenizer)
    classes = label_classes(rows)
    train, test = split(rows, key)
    features: dict[int, tuple[DataFrame, DataFrame]] = {}
    results, fitted, training, cached = {}, {}, {}, []
    for name, (estimator, min_df) in models.items():
        if min_df not in features:
            tfidf = fit_tfidf(train, text, tokenizer, min_df=min_df)
            features[min_df] = (
                tfidf.transform(train).select("features", "labels").persist(),
                tfidf.transform(test).select(key, "features", "labels"),
            )
            cached.append(features[min_df][0])
        training[name], test_rows = features[min_df]
        if isinstance(estimator, Linear | BoostedTrees):
            fitted[name] = estimator.fit(training[name], classes)
        else:
            fitted[name] = fit_one_vs_rest(training[name], classes, estimator)
        scored = fitted[name].transform(test_rows)
        scores = [c for c in ("scores",) if c in scored.columns]
        results[name] = via_table(
            scored.select(key, binarize(classes).alias("truth"), "predicted", *scores), "scored"
        )
    return Classified(classes, results, fitted, training, cached)
