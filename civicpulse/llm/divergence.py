"""Quality rules: divergence of a text's histograms from its language's reference.

One Python pass counts each text (``textstats``); all else is DataFrame work on the
small counts. A language's reference pools the histograms of its documents, then pools
anew those nearer than the median, twice, so that junk does not shape it. A text is
rejected if the Jensen-Shannon distance (base 2, 0 to 1) of its character classes or of
its common words exceeds a limit that eases for short texts, where chance alone moves a
histogram; texts below ``min_words`` fail the base rules before that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.fixed_lists import CHAR_CLASSES
from civicpulse.llm.rowkeys import MARK, key_columns, without
from civicpulse.llm.textstats import COUNTS_SCHEMA, COUNTS_TYPE, WORD_LIST, text_counts
from civicpulse.llm.words import by_slices
from civicpulse.session import broadcast_within, via_table


@dataclass(frozen=True)
class DivergenceLimits:
    """A distance passes up to ``limit + ease / n_words``."""

    min_words: int = 50
    max_repeat_percent: int = 50
    char_limit: float = 0.15
    char_ease: float = 8.0
    word_limit: float = 0.30
    word_ease: float = 10.0
    reference_words: int = 1000
    rounds: int = 2


def count_texts(text: Column) -> Column:
    """Struct of the counts of a text column."""

    @F.arrow_udf(COUNTS_SCHEMA)
    def counted(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda some: pa.array([text_counts(t) for t in some], COUNTS_TYPE))

    return counted(text)


def base_failed(counts: Column, limits: DivergenceLimits) -> Column:
    """Too few words, or too many inside repeated windows of three."""
    n = counts["n_words"]
    return (n < limits.min_words) | (100 * counts["n_repeat_words"] > limits.max_repeat_percent * n)


def _shares(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda s, x: s + x)
    return F.transform(hist, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def distances(hist: pd.Series, reference: pd.Series) -> pd.Series:
    """Jensen-Shannon distance of histograms from share arrays; null without a reference."""
    found = np.full(len(hist), np.nan)
    known = np.nonzero((hist.notna() & reference.notna()).to_numpy())[0]
    if len(known):
        p = np.stack(hist.iloc[known].to_numpy()).astype(float)
        q = np.stack(reference.iloc[known].to_numpy()).astype(float)
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1)
        middle = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
        found[known] = np.sqrt(np.maximum(terms.sum(axis=1), 0) / 2)
    return pd.Series(found)


def _distance(hist: Column, reference: Column) -> Column:
    @F.pandas_udf("double")
    def distance(hists: pd.Series, references: pd.Series) -> pd.Series:
        return distances(hists, references)

    return distance(hist, reference)


def _pooled(rows: DataFrame, *by: str) -> DataFrame:
    """Share arrays of summed histograms, summed slot by slot."""
    sizes = {"char_hist": len(CHAR_CLASSES), "word_hist": len(WORD_LIST) + 1}
    sums = [
        F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(name)
        for name, size in sizes.items()
    ]
    pooled = rows.groupBy(*by).agg(*sums, F.sum("n_words").alias("reference_words"))
    return pooled.select(
        *by, _shares(F.col("char_hist")).alias("char_ref"), _shares(F.col("word_hist")).alias("word_ref"),
        "reference_words",
    )


def _measured(rows: DataFrame, references: DataFrame, everything: DataFrame, limits: DivergenceLimits) -> DataFrame:
    """``rows`` with both distances; a thin language is held against all languages."""
    enough = F.col("reference_words") >= limits.reference_words
    whole = everything.select(
        F.col("char_ref").alias("char_all"), F.col("word_ref").alias("word_all")
    )
    joined = rows.join(broadcast_within(references), "reference_lang", "left").join(F.broadcast(whole), how="left")
    return joined.withColumns(
        {
            "char_distance": _distance(F.col("char_hist"), F.when(enough, F.col("char_ref")).otherwise(F.col("char_all"))),
            "word_distance": _distance(F.col("word_hist"), F.when(enough, F.col("word_ref")).otherwise(F.col("word_all"))),
        }
    ).drop("char_ref", "word_ref", "reference_words", "char_all", "word_all")


def language_references(counted: DataFrame, limits: DivergenceLimits) -> tuple[DataFrame, DataFrame]:
    """References by language, and one over all (a single row), from counted texts."""
    rows = counted.where(F.col("n_words") >= limits.min_words)
    references, everything = _pooled(rows, "reference_lang"), _pooled(rows)
    for _ in range(limits.rounds):
        references = via_table(references, "references")
        everything = via_table(everything, "reference")
        near = via_table(_measured(rows, references, everything, limits), "near")
        middle = near.groupBy("reference_lang").agg(
            F.percentile_approx("char_distance", 0.5).alias("char_middle"),
            F.percentile_approx("word_distance", 0.5).alias("word_middle"),
        )
        near = near.join(broadcast_within(via_table(middle, "middle")), "reference_lang")
        near = near.where("char_distance <= char_middle OR word_distance <= word_middle").select(
            "reference_lang", "n_words",
            F.when(F.col("char_distance") <= F.col("char_middle"), F.col("char_hist")).alias("char_hist"),
            F.when(F.col("word_distance") <= F.col("word_middle"), F.col("word_hist")).alias("word_hist"),
        )
        references, everything = _pooled(near, "reference_lang"), _pooled(near)
    return via_table(references, "references"), via_table(everything, "reference")


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    carry: list[str] | None = None,
    limits: DivergenceLimits = DivergenceLimits(),
) -> DataFrame:
    """One row per row of ``docs``: ``carry`` columns as ``c_<name>``, counts, distances, verdict.

    ``base_failed`` and ``kept`` are never null. Null and empty texts have no words and
    fail; a null language is one of its own; without documents the result is empty;
    repeated rows each come back.
    """
    counted = via_table(
        docs.select(
            *[F.col(c).alias(f"c_{c}") for c in (docs.columns if carry is None else carry)],
            F.coalesce(F.col(lang_col), F.lit("")).alias("reference_lang"),
            count_texts(F.col(text_col)).alias("counts"),
        ),
        "counted",
    )
    slim = counted.select("reference_lang", "counts.*")
    references, everything = language_references(slim, limits)
    rows = counted.select("*", "counts.*")
    judged = _measured(rows, references, everything, limits)
    n = F.greatest(F.col("n_words"), F.lit(1))
    far = (F.col("char_distance") > limits.char_limit + limits.char_ease / n) | (
        F.col("word_distance") > limits.word_limit + limits.word_ease / n
    )
    failed = base_failed(F.col("counts"), limits)
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & ~F.coalesce(far, F.lit(False))
    ).drop("counts")


def keep_by_rules(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **options
) -> DataFrame:
    """``docs`` without rejected rows; columns stay as they are.

    The verdict hangs on text and language alone, so rows are dropped by these and their id.
    """
    names = list(dict.fromkeys([id_col, lang_col]))
    keyed = docs.select(*key_columns(names, text_col), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    carry = [*[f"key_{n}" for n in names], MARK]
    judged = quality_rules(keyed, "__text", "__lang", carry, **options)
    rejected = judged.where("NOT kept").select(*[F.col(f"c_{c}").alias(c) for c in carry])
    return without(docs, rejected, text_col)
