"""Quality rules and the site classifier against plain Python and held-out labels."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicpulse.llm.divergence import distances, keep_by_rules, quality_rules
from civicpulse.llm.site_quality import SiteQuality, classify_quality, keep_quality, site_posteriors
from civicpulse.llm.textstats import text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = "/root/testdata/sf0.001"


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if windows[window] > 1:
            again.update((i, i + 1, i + 2))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
    }


@pytest.mark.parametrize(
    "text",
    [None, "", " \n ", "a", "a b a b a b", "x\ny\nx\n\n \nx", "é ß # | <b>\x0b中文\x00 a b c a b c", "w " * 5000],
)
def test_counts(text):
    got = text_counts(text)
    assert {k: got[k] for k in slow_counts(text)} == slow_counts(text)
    assert sum(got["char_hist"]) == len(text or "")


def test_distance_of_equal_and_disjoint():
    found = distances(pd.Series([[1, 1], [5, 0], [1, 2], None]), pd.Series([[0.5, 0.5], [0.0, 1.0], None, [1.0, 0.0]]))
    assert found[0] == pytest.approx(0) and found[1] == pytest.approx(1) and np.isnan(found[2]) and np.isnan(found[3])


def test_rules_on_awkward_rows(docs, nothing):
    got = quality_rules(docs, carry=["doc_id", "row"]).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        want = slow_counts(texts[r.c_doc_id])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and r.kept in (True, False) and not (failed and r.kept)
    kept = keep_by_rules(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules(nothing).count() == 0 and keep_by_rules(nothing).count() == 0


def test_rules_keep_prose_and_reject_junk(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    judged = quality_rules(docs, carry=["doc_id"]).join(labels, F.col("c_doc_id") == labels.doc_id)
    rates = {
        r.quality: (r.kept, r.n)
        for r in judged.where("NOT base_failed").groupBy("quality").agg(
            F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")
        ).collect()
    }
    assert rates[1][0] > 0.98 and rates.get(0, (0, 0))[0] < 0.35


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{TABLES.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES.replace('0.001', '0.01')}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = classify_quality(docs, train, carry=["doc_id"]).join(test, F.col("c_doc_id") == test.doc_id)
    right = {r.quality: r.right for r in judged.groupBy("quality").agg(
        F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("right")
    ).collect()}
    assert right[1] > 0.98 and right[0] > 0.9


def test_sparse_sites_shrink_to_their_prior(spark):
    # Path a/good has 400 good rows, a/one has a single bad one, b/bad 400 bad rows.
    rows = [("a", "good", 1.0)] * 400 + [("a", "one", 0.0)] + [("b", "bad", 0.0)] * 400 + [("c", "mix", 1.0), ("c", "mix", 0.0)]
    frame = spark.createDataFrame(rows, "host string, path string, q double")
    sites, rate, top, low = site_posteriors(frame, SiteQuality())
    got = {(r.host, r.path): r for r in sites.collect()}
    def mean(r):
        host = (r.host_s + top * rate) / (r.host_n + top)
        return (r.s + low * host) / (r.n + low)
    assert mean(got["a", "good"]) > 0.95 and mean(got["b", "bad"]) < 0.05
    assert 0.2 < mean(got["a", "one"]) < mean(got["a", "good"])
    assert abs(mean(got["c", "mix"]) - rate) < 0.2


def test_classifier_on_awkward_rows(spark, docs, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, 0), (9, None, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int"
    )
    got = classify_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(r.kept in (True, False) for r in got)
    assert all(0 <= r.posterior <= 1 for r in got)
    assert keep_quality(docs, labels).columns == docs.columns
    assert keep_quality(docs, labels.limit(0)).count() == docs.count()  # nothing learned, nothing lost
    assert classify_quality(nothing, labels).count() == 0
