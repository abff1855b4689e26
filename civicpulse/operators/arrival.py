"""First arrival per key over a finished set of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arrivals_per_key(
    df: DataFrame, key: str, order: Sequence[str] = ("seq",), copies: str = "copies"
) -> DataFrame:
    """One row per key, null included: its earliest row and how many there were.

    ``min_by`` combines before the shuffle, so a key holding a third of all
    rows sends one row per task instead of meeting in one window partition.
    """
    rest = F.struct(*[F.col(c) for c in df.columns if c != key])
    return (
        df.groupBy(key)
        .agg(
            F.min_by(rest, F.struct(*order)).alias("_first"),
            F.count("*").alias(copies),
        )
        .select(
            *[F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns],
            copies,
        )
    )


def first_arrivals(df: DataFrame, key: str, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the earliest row of every non-null key."""
    return arrivals_per_key(df.filter(F.col(key).isNotNull()), key, order).drop("copies")


def saved_tickets(
    df: DataFrame, key: str, located: Column, order: Sequence[str] = ("seq",)
) -> DataFrame:
    """De-duplicate first, then drop rows without coordinates.

    A first arrival without coordinates uses its id up: later copies stay out.
    """
    return first_arrivals(df.withColumn("_ok", located), key, order).filter("_ok").drop("_ok")


def ingest_counters(
    df: DataFrame, key: str, located: Column, order: Sequence[str] = ("seq",)
) -> DataFrame:
    """One row of ``saved, duplicates, missing_id, no_coords``."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min_by(located, F.struct(*order)).alias("ok"),
    )
    has_key = F.col(key).isNotNull()

    def total(col: Column) -> Column:
        return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")

    return per_key.agg(
        total(F.when(has_key & F.col("ok"), 1)).alias("saved"),
        total(F.when(has_key, F.col("n") - 1)).alias("duplicates"),
        total(F.when(~has_key, F.col("n"))).alias("missing_id"),
        total(F.when(has_key & ~F.col("ok"), 1)).alias("no_coords"),
    )
