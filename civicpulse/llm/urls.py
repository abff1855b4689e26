"""URL filters: list rules first, boosted trees on lexical features for the rest.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits
decides. For other URLs gradient-boosted trees judge length, depth, digit ratio, entropy,
parameter counts and how often labelled URLs of the same host suffixes were unwanted
(smoothed towards the global rate and without the URL's own label). The trees are fitted
on a bounded sample of labelled URLs; suffix statistics are grouped sums over all of them.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.fixed_lists import UNWANTED_HOST_WORDS, URL_RULES
from civicpulse.llm.licenses import lowered
from civicpulse.session import broadcast_within, via_table

LEXICAL = [
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy",
    "host_entropy", "parameters", "query_length", "escapes", "longest_label",
]
SUFFIX_LEVELS = (1, 2, 3)


@dataclass(frozen=True)
class UrlTrees:
    """``training_rows`` bounds the sample of labelled URLs the trees are fitted on."""

    training_rows: int = 50_000
    rounds: int = 20
    depth: int = 4
    smoothing: float = 20.0
    block_from: float = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=URL_RULES) -> tuple[Column, Column]:
    """Longest rule that fits as ``host/path`` text, and its verdict; null if none does.

    ``rules`` is a list of (verdict, host, path); of equally long ones the first decides.
    """
    rule = verdict = F.lit(None).cast("string")
    # Later conditions end up outermost, so the longest rule is asked first.
    for says, name, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def lexical_values(url: str | None, host: str, path: str) -> list[float]:
    """Values of ``LEXICAL`` for one URL."""
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".") if host else []
    return [
        len(url), len(host), len(path), sum(1 for p in path.split("/") if p), len(labels),
        sum(c.isdigit() for c in url) / max(len(url), 1), host.count("-"), _entropy(url), _entropy(host),
        sum(1 for p in query.split("&") if p), len(query), len(url) - len(unquote(url)),
        max(map(len, labels), default=0),
    ]


def lexical_features(url: Column | str, host: Column | str, path: Column | str) -> Column:
    """Array of the values of ``LEXICAL``."""

    @F.pandas_udf("array<double>")
    def values(urls: pd.Series, hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([np.array(lexical_values(*x), float) for x in zip(urls, hosts, paths)])

    return values(url, host, path)


def word_labels(host: Column, words=UNWANTED_HOST_WORDS) -> Column:
    """Label of a URL by the words of its host: 1.0 if one is unwanted, else 0.0."""
    return F.exists(F.split(host, r"[^a-z0-9]+"), lambda w: w.isin(*words)).cast("double")


def _suffix(host: Column, level: int) -> Column:
    return F.substring_index(host, ".", -level)


def suffix_statistics(labelled: DataFrame) -> list[DataFrame]:
    """Per level: ``(s<level>, n<level>, u<level>)``, labelled and unwanted URLs of a suffix."""
    return [
        labelled.groupBy(_suffix(F.col("host"), k).alias(f"s{k}")).agg(
            F.count("*").alias(f"n{k}"), F.sum("label").alias(f"u{k}")
        )
        for k in SUFFIX_LEVELS
    ]


def with_features(rows: DataFrame, statistics: list[DataFrame], rate: float, settings: UrlTrees) -> DataFrame:
    """``rows`` (``url, host, path, label``; label null if unknown) with one column per feature."""
    for k, known in zip(SUFFIX_LEVELS, statistics):
        rows = rows.withColumn(f"s{k}", _suffix(F.col("host"), k)).join(broadcast_within(known), f"s{k}", "left")
        own = F.col("label").isNotNull().cast("int")
        n = F.greatest(F.coalesce(f"n{k}", F.lit(0)) - own, F.lit(0))
        unwanted = F.coalesce(f"u{k}", F.lit(0.0)) - F.coalesce("label", F.lit(0.0))
        rows = rows.withColumns(
            {
                f"suffix_rate_{k}": (unwanted + settings.smoothing * rate) / (n + settings.smoothing),
                f"suffix_count_{k}": F.log1p(n),
            }
        ).drop(f"s{k}", f"n{k}", f"u{k}")
    rows = rows.withColumn("lexical", lexical_features("url", "host", "path"))
    return rows.withColumns({name: F.col("lexical")[i] for i, name in enumerate(LEXICAL)}).drop("lexical")


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=URL_RULES,
    settings: UrlTrees = UrlTrees(),
) -> DataFrame:
    """``(id, host, path, rule, verdict, score)``: one row per row of ``pages``.

    ``labelled`` has ``url`` and ``label`` (0 or 1); without it the URLs of ``pages`` are
    labelled by the words of their hosts. With labels of one class only, that class is
    the method's verdict for all. Null URLs and URLs without ``://`` have empty host and
    path; repeated rows each come back; no pages give an empty table.
    """
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    if labelled is None:
        rows = rows.withColumn("label", F.when(F.col("host") != "", word_labels(F.col("host"))))
        known = rows.where("label IS NOT NULL").select("url", "host", "path", "label")
    else:
        rows = rows.withColumn("label", F.lit(None).cast("double"))
        known = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(
            "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")
        )
    totals = known.agg(F.count("*").alias("n"), F.sum("label").alias("unwanted")).first()
    rate = totals.unwanted / totals.n if totals.n else 0.0
    statistics = [via_table(s, "suffixes") for s in suffix_statistics(known)]
    names = [*LEXICAL, *[f"suffix_{what}_{k}" for k in SUFFIX_LEVELS for what in ("rate", "count")]]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    featured = with_features(rows, statistics, rate, settings)
    if 0 < rate < 1:
        share = min(1.0, settings.training_rows / totals.n)
        sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(share * 1_000_000))
        training = assembler.transform(with_features(sample, statistics, rate, settings)).select("label", "features")
        trees = GBTClassifier(maxIter=settings.rounds, maxDepth=settings.depth, seed=1).fit(via_table(training, "training"))
        scored = trees.transform(assembler.transform(featured)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = featured.withColumn("score", F.lit(float(rate)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("score") >= settings.block_from, "block").otherwise("allow")
    return scored.select(
        "id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_trees).alias("verdict"), "score"
    )
