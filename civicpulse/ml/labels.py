"""Label lists and the hold-out split."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.parse import parse_set
from civicpulse.operators.shares import smallest


def labelled(df: DataFrame, text: str = "comment", labels: str = "type") -> DataFrame:
    """M1: rows with text and at least one label; adds ``labels array<string>``."""
    return (
        df.dropna(subset=[text, labels])
        .withColumn("labels", parse_set(labels, fixed.LABEL_STRIP_CHARS))
        .filter(F.size("labels") > 0)
    )


def label_classes(df: DataFrame, labels: str = "labels") -> list[str]:
    """M2: the sorted classes. One model is fitted for each, so the driver lists them."""
    rows = df.select(F.explode(labels).alias("label")).distinct().collect()
    return sorted(row.label for row in rows)


def binarize(classes: Sequence[str], labels: str = "labels") -> Column:
    """M2: 0/1 per class, in class order."""
    return F.transform(
        F.array(*[F.lit(c) for c in classes]),
        lambda c: F.array_contains(F.col(labels), c).cast("int"),
    )


def _place(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def in_test_set(
    key: str, fraction: float = fixed.TEST_FRACTION, seed: int = fixed.SPLIT_SEED
) -> Column:
    """M3: true for about ``fraction`` of the keys, the same ones in every run.

    The share is taken on a hash of key and seed, so neither file layout nor
    partitioning moves a row to the other side.
    """
    threshold = format(int(fraction * 2**32), "08x")
    return F.substring(_place(key, seed), 1, 8) < F.lit(threshold)


def in_exact_test_set(
    df: DataFrame, key: str, fraction: float = fixed.TEST_FRACTION, seed: int = fixed.SPLIT_SEED
) -> Column:
    """M3: true for exactly ``ceil(fraction * n)`` of the ``n`` rows of ``df``, whose keys differ.

    The rows with the smallest hashes; they stay the same however the rows are laid out.
    """
    n = df.count()
    # As fractions of whole numbers, so that 0.2 * 5 is 1.
    share = Fraction(str(fraction))
    return smallest(df, _place(key, seed), -(-n * share.numerator // share.denominator))


def split(df: DataFrame, key: str, **settings) -> tuple[DataFrame, DataFrame]:
    """M3: train and test rows."""
    test = in_test_set(key, **settings)
    return df.filter(~test), df.filter(test)


def exact_split(df: DataFrame, key: str, **settings) -> tuple[DataFrame, DataFrame]:
    """M3: train and test rows, the latter of exact number."""
    test = in_exact_test_set(df, key, **settings)
    return df.filter(~test), df.filter(test)
