"""Vocabulary and TF-IDF vectors (M4-M7)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.text import Tokenizer, ngrams, words
from civicpulse.operators.ranking import top_rows
from civicpulse.session import broadcast_within, via_table


TOKENS = "tokens"
SLICE_TERMS = 2_000_000


def with_tokens(df: DataFrame, text: str, tokenizer: Tokenizer = words) -> DataFrame:
    """M4: ``df`` with ``tokens`` in place of ``text``, written once for every later step.

    Counting, vocabulary and weights all start from the tokens; read from the shared folder
    they cost no second pass over the texts.
    """
    tokens = df.withColumn(TOKENS, tokenizer(F.lower(F.col(text))))
    return via_table(tokens.drop(text), "tokens")


def with_terms(
    df: DataFrame,
    text: str,
    tokenizer: Tokenizer = words,
    ngram_range: tuple[int, int] = fixed.NGRAM_RANGE,
) -> DataFrame:
    """M4, M5: add ``terms``; tokens are made once and shared by all n-gram sizes.

    Rows that have ``tokens`` already keep them.
    """
    tokens = F.col(TOKENS) if TOKENS in df.columns else tokenizer(F.lower(F.col(text)))
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("terms", ngrams(F.col("_tokens"), *ngram_range))
        .drop("_tokens")
    )


def token_counts(df: DataFrame, key: str, text: str, tokenizer: Tokenizer = words) -> DataFrame:
    """M4: number of tokens and of distinct tokens per text."""
    return df.withColumn("_tokens", tokenizer(F.lower(F.col(text)))).select(
        key,
        F.size("_tokens").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("_tokens")).cast("bigint").alias("n_distinct"),
    )


def _slices(lists: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of at most ``SLICE_TERMS`` terms, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        done = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, done + SLICE_TERMS, side="right")), at + 1)
        yield lists.slice(at, end - at)
        at = end


def _counted(low: int, high: int):
    names = ["term", "tf", "df"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in _slices(batch.column(0)):
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                found = lists.flatten().dictionary_encode(null_encoding="encode")
                tokens, ids = found.dictionary, found.indices.to_numpy().astype(np.int64)
                # Of the n-gram that begins at each place: its number among the distinct ones, and its text.
                texts, codes = tokens, ids
                for n in range(1, high + 1):
                    if n > 1:
                        ends = np.flatnonzero(rows[: len(codes) - 1] == rows[n - 1 :])
                        pairs = codes[ends] * len(tokens) + ids[ends + n - 1]
                        at = rows[ends]
                    else:
                        ends, pairs, at = np.arange(len(ids)), ids, rows
                    if not len(pairs):
                        break
                    order = np.argsort(pairs, kind="stable")  # texts stay in order within an n-gram
                    ranked, owner = pairs[order], at[order]
                    fresh = np.diff(ranked, prepend=-1) != 0
                    heads = np.flatnonzero(fresh)
                    if n > 1:
                        chosen = ranked[heads]
                        texts = pc.binary_join_element_wise(
                            texts.take(pa.array(chosen // len(tokens))), tokens.take(pa.array(chosen % len(tokens))), " "
                        )
                        if n < high:  # places that begin no n-gram of this size have none of a greater one
                            codes = np.zeros(len(ids) - n + 1, np.int64)
                            codes[ends[order]] = np.cumsum(fresh) - 1
                    else:
                        texts = texts.take(pa.array(ranked[heads]))
                        codes = np.empty(len(ids), np.int64)
                        codes[order] = np.cumsum(fresh) - 1
                    if n >= low:
                        first = fresh | (np.diff(owner, prepend=-1) != 0)
                        tf = np.diff(np.append(heads, len(ranked)))
                        df = np.add.reduceat(first, heads, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([texts, pa.array(tf), pa.array(df)], names)

    return counted


def term_statistics(df: DataFrame, terms: str = "terms", ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """Total count ``tf`` and document count ``df`` per term.

    With another ``ngram_range`` the terms are the n-grams of what ``terms`` holds, made of
    numbers and only spelled out once distinct. A task counts a bounded number of terms at a time
    in arrays; its sums are combined before the shuffle, which therefore carries distinct terms per
    task, never (text, term) pairs.
    """
    return (
        df.select(terms)
        .mapInArrow(_counted(*ngram_range), "term string, tf long, df long")
        .groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    )


def vocabulary(
    df: DataFrame,
    terms: str = "terms",
    min_df: int = fixed.MIN_DF,
    max_features: int = fixed.MAX_FEATURES,
    ngram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """M6: terms in at least ``min_df`` texts, the ``max_features`` most counted ones.

    Ties go to the smaller term. ``ngram_range`` as in :func:`term_statistics`.
    """
    frequent = term_statistics(df, terms, ngram_range).filter(F.col("df") >= min_df)
    return top_rows(frequent, [F.col("tf").desc(), F.col("term")], max_features)


@dataclass(frozen=True)
class TfidfModel:
    """M7: at most ``max_features`` terms with their weights, applied row by row in the JVM."""

    terms: list[str]
    idf: list[float]
    text: str
    tokenizer: Tokenizer = field(default=words, repr=False)
    ngram_range: tuple[int, int] = fixed.NGRAM_RANGE

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the L2-normalised TF-IDF vector. No shuffle."""
        counted = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="terms", outputCol="_counts"
        ).transform(with_terms(df, self.text, self.tokenizer, self.ngram_range))
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted"
        ).transform(counted)
        return (
            Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
            .transform(weighted)
            .drop("terms", "_counts", "_weighted")
        )

    def weights(self, df: DataFrame, key: str) -> DataFrame:
        """The same vectors in long form ``(key, term, weight)``, zeros left out."""
        vector = F.unwrap_udt(F.col("features"))
        cells = F.arrays_zip(
            vector["indices"].alias("index"), vector["values"].alias("weight")
        )
        names = df.sparkSession.createDataFrame(
            list(enumerate(self.terms)), "index int, term string"
        )
        return (
            self.transform(df)
            .select(key, F.inline(cells))
            .filter(F.col("weight") != 0)
            .join(broadcast_within(names), "index")
            .select(key, "term", "weight")
        )


def fit_tfidf(
    df: DataFrame,
    text: str,
    tokenizer: Tokenizer = words,
    ngram_range: tuple[int, int] = fixed.NGRAM_RANGE,
    min_df: int = fixed.MIN_DF,
    max_features: int = fixed.MAX_FEATURES,
) -> TfidfModel:
    """M6, M7: ``idf = ln((1 + n) / (1 + df)) + 1`` over the rows of ``df``."""
    n = df.count()
    chosen = vocabulary(
        with_terms(df, text, tokenizer, (1, 1)), "terms", min_df, max_features, ngram_range
    ).collect()
    return TfidfModel(
        [row.term for row in chosen],
        [math.log((1 + n) / (1 + row.df)) + 1 for row in chosen],
        text,
        tokenizer,
        ngram_range,
    )
