"""Labels, features, classifiers and scores."""

import math

import pytest
from helpers import column
from pyspark.sql import functions as F

from civicpulse.functions import text
from civicpulse.ml import classifiers, features, labels, metrics
from civicpulse.ml.evidence import is_fitted
from civicpulse.plans.classification import classify


def test_words_keep_marks_and_digits(spark):
    df = spark.createDataFrame([("Hello, น้ำ-ท่วม x_1 2",)], "t string")
    assert df.select(text.words(F.lower("t"))).first()[0] == ["hello", "น้ำ", "ท่วม", "x_1", "2"]


@pytest.mark.parametrize(
    "tokens, low, high, grams",
    [
        (["a", "b", "c"], 1, 2, ["a", "b", "c", "a b", "b c"]),
        (["a", "b", "c"], 2, 3, ["a b", "b c", "a b c"]),
        (["a"], 1, 2, ["a"]),
        ([], 1, 2, []),
    ],
)
def test_ngrams(spark, tokens, low, high, grams):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(text.ngrams(F.col("t"), low, high)).first()[0] == grams


def test_another_tokenizer_plugs_in(spark):
    df = spark.createDataFrame([("a|b",)], "t string")
    terms = features.with_terms(df, "t", tokenizer=lambda c: F.split(c, r"\|"))
    assert terms.first().terms == ["a", "b", "a b"]


def test_vocabulary_rules(spark):
    df = spark.createDataFrame([("a a b",), ("a b",), ("c c c c",)], "t string")
    terms = features.with_terms(df, "t", ngram_range=(1, 1))
    assert column(features.vocabulary(terms, min_df=1), "term", "tf", "df") == [
        ("c", 4, 1), ("a", 3, 2), ("b", 2, 2),
    ]
    assert column(features.vocabulary(terms, min_df=2), "term") == ["a", "b"]
    assert column(features.vocabulary(terms, min_df=1, max_features=1), "term") == ["c"]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a"), (3, "zzz")], "id int, t string")
    model = features.fit_tfidf(df, "t", ngram_range=(1, 1), min_df=1, max_features=2)
    assert model.terms == ["a", "b"]
    idf = [math.log(4 / 3) + 1, math.log(4 / 2) + 1]
    assert model.idf == pytest.approx(idf)
    a, b = 2 * idf[0], idf[1]
    norm = math.hypot(a, b)
    got = {(r.id, r.term): r.weight for r in model.weights(df, "id").collect()}
    assert got == pytest.approx({(1, "a"): a / norm, (1, "b"): b / norm, (2, "a"): 1.0})
    # a text without known terms has a zero vector but stays a row
    assert model.transform(df).count() == 3


def test_vectors_have_unit_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    weights = features.fit_tfidf(docs, "text").weights(docs, "doc_id")
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert norms.filter(F.abs(F.col("n") - 1) > 1e-9).count() == 0


def test_labels_and_classes(spark):
    df = spark.createDataFrame(
        [("x", "{b,a}"), ("x", "{}"), ("x", None), (None, "{a}"), ("x", " {a}")],
        "comment string, type string",
    )
    rows = labels.labelled(df)
    assert column(rows, "labels") == [["b", "a"], ["{a"]]
    classes = labels.label_classes(rows)
    assert classes == ["a", "b", "{a"]
    assert column(rows.select(labels.binarize(classes).alias("y")), "y") == [[1, 1, 0], [0, 0, 1]]


def test_split_is_stable_and_complete(spark):
    df = spark.range(5000)
    train, test = labels.split(df, "id")
    assert train.count() + test.count() == 5000
    assert 900 < test.count() < 1100
    again = labels.split(df.repartition(13), "id")[1]
    assert sorted(column(again, "id")) == sorted(column(test, "id"))
    assert column(labels.split(df, "id", seed=1)[1], "id") != column(test, "id")


def test_scores_by_hand(spark):
    rows = [([1, 0, 0], [1, 1, 0]), ([1, 0, 0], [0, 0, 0]), ([0, 1, 0], [0, 1, 0]), ([0, 0, 0], [0, 0, 0])]
    df = spark.createDataFrame(rows, "truth array<int>, predicted array<int>")
    # label 0: tp1 fp0 fn1, label 1: tp1 fp1 fn0, label 2: nothing
    f = metrics.f1_scores(df).first()
    assert f.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    assert f.micro_f1 == pytest.approx(4 / 6)
    assert f.weighted_f1 == pytest.approx(2 / 3)
    report = {r.label: r for r in metrics.classification_report(df, ["a", "b", "c"]).collect()}
    assert set(report) == {"a", "b", "c", "micro avg", "macro avg", "weighted avg", "samples avg"}
    assert (report["a"].precision, report["a"].recall, report["a"].support) == (1.0, 0.5, 2)
    assert (report["c"].precision, report["c"].f1, report["c"].support) == (0.0, 0.0, 0)
    assert report["samples avg"].precision == pytest.approx((0.5 + 0 + 1 + 0) / 4)
    assert report["samples avg"].recall == pytest.approx((1 + 0 + 1 + 0) / 4)
    assert report["micro avg"].support == report["samples avg"].support == 3


@pytest.fixture(scope="module")
def complaints(spark):
    # "flood" and "road" follow from their words, "always" is on every row.
    subjects = ["water high", "hole broken", "water hole", "tree"]
    rows = []
    for i in range(240):
        words = subjects[i % 4]
        tags = ["always"] + ["flood"] * ("water" in words) + ["road"] * ("hole" in words)
        rows.append((i, f"{words} place{i % 7}", "{" + ",".join(tags) + "}"))
    return spark.createDataFrame(rows, "ticket_id int, comment string, type string")


@pytest.mark.parametrize(
    "estimator",
    [
        classifiers.logistic,
        classifiers.linear_svc,
        lambda n: classifiers.boosted_trees(n, trees=5, depth=3, rate=0.5),
    ],
    ids=["logistic", "svc", "trees"],
)
def test_one_vs_rest_learns(complaints, estimator):
    done = classify(complaints, models={"m": (estimator, 5)})
    assert done.classes == ["always", "flood", "road"]
    assert metrics.f1_scores(done.results["m"]).first().micro_f1 == 1.0
    assert done.results["m"].count() == labels.split(complaints, "ticket_id")[1].count()
    assert is_fitted(done.fitted["m"], done.training["m"])
    done.close()


def test_a_model_that_was_not_fitted_is_found_out(complaints):
    lazy = {
        "logistic": (lambda n: classifiers.logistic(n).setMaxIter(1), 5),
        "trees": (lambda n: classifiers.boosted_trees(n, trees=3, depth=2, rate=1.0), 5),
    }
    done = classify(complaints, models=lazy)
    assert not is_fitted(done.fitted["logistic"], done.training["logistic"])
    trees = done.fitted["trees"].models[1]
    trees.set(trees.maxIter, 100)  # fewer trees than it should have
    assert not is_fitted(done.fitted["trees"], done.training["trees"])
    done.close()


def test_constant_classes(spark, complaints):
    rows = labels.labelled(complaints)
    train = features.fit_tfidf(rows, "comment").transform(rows)
    model = classifiers.fit_one_vs_rest(train, ["always", "never"], classifiers.logistic)
    assert model.models == [1, 0]
    predicted = model.transform(train).select("predicted").distinct()
    assert column(predicted, "predicted") == [[1, 0]]


@pytest.mark.parametrize("most", [1, 5, 1 << 20])
@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 3)])
def test_ngrams_are_counted_from_tokens(spark, monkeypatch, most, low, high):
    monkeypatch.setattr(features, "SLICE_TERMS", most)
    rows = [["a", "b", "a", "b"], None, [], ["b"], ["a b", "c", "a"], ["c", "a", "b", "c"]]
    want = {}
    for tokens in filter(None, rows):
        grams = [" ".join(tokens[i : i + n]) for n in range(low, high + 1) for i in range(len(tokens) - n + 1)]
        for g in set(grams):
            tf, texts = want.get(g, (0, 0))
            want[g] = (tf + grams.count(g), texts + 1)
    df = spark.createDataFrame([(r,) for r in rows], "terms array<string>").coalesce(1)
    got = {r.term: (r.tf, r.df) for r in features.term_statistics(df, ngram_range=(low, high)).collect()}
    assert got == want
