"""Newest rows and largest groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.operators.filters import prune_months


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_rows(df: DataFrame, order: Sequence[Column], n: int, lanes: int = 256) -> DataFrame:
    """The first ``n`` rows in ``order``, for an ``n`` of thousands.

    A plain ordered limit sends up to ``n`` rows of every task to one reducer.
    Here tasks share ``lanes``: a task sends its first ``n`` rows to its lane,
    and only the lanes' first ``n`` meet at the end. The optimizer cuts each task's rows
    before that shuffle up to a threshold of its own, which is raised to ``n``.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < n:
        conf.set(GROUP_LIMIT, str(n))
    lane = Window.partitionBy("_lane").orderBy(*order)
    return (
        df.withColumn("_lane", F.spark_partition_id() % lanes)
        .withColumn("_rank", F.row_number().over(lane))
        .filter(F.col("_rank") <= n)
        .drop("_lane", "_rank")
        .orderBy(*order)
        .limit(n)
    )


def newest_n(
    df: DataFrame,
    n: int = fixed.MAX_POINTS,
    ts: str = "timestamp_dt",
    tiebreak: Sequence[str] = ("ticket_id",),
) -> DataFrame:
    """The ``n`` newest rows, null times last, ties by ``tiebreak``.

    Runs one small job first: rows per day, newest ``n`` days at most. It
    yields the day from which on there are ``n`` rows; the filter on it reaches
    the scan, so old files are never read in full.
    """
    cut = _newest_days_cut(df, n, ts)
    if cut is not None:
        df = df.filter(F.col(ts) >= F.lit(cut).cast(df.schema[ts].dataType))
        df = prune_months(df, ts, cut)
    return top_rows(df, [F.col(ts).desc_nulls_last(), *[F.col(c) for c in tiebreak]], n)


def _newest_days_cut(df: DataFrame, n: int, ts: str) -> str | None:
    """Latest day with at least ``n`` rows on or after it; None if there is none."""
    newest_days = (
        df.select(F.to_date(ts).alias("day"))
        .dropna()
        .groupBy("day")
        .agg(F.count("*").alias("n"))
        # Every day holds a row, so n days always suffice.
        .orderBy(F.col("day").desc())
        .limit(n)
    )
    running = F.sum("n").over(
        Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        newest_days.select(F.col("day").cast("string").alias("day"), running.alias("seen"))
        .filter(F.col("seen") >= n)
        .agg(F.max("day"))
        .first()[0]
    )


def newest_preview(df: DataFrame, seq: str, n: int = 6) -> DataFrame:
    """The ``n`` latest queued records."""
    return df.orderBy(F.col(seq).desc()).limit(n)


def top_groups(df: DataFrame, key: str, k: int = fixed.DASHBOARD_TOP) -> DataFrame:
    """A4, L2: the ``k`` most frequent values, ties by value."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), key)
        .limit(k)
    )


def top_tokens(
    df: DataFrame, tokens: str = "type_tokens", k: int = fixed.DASHBOARD_TOP
) -> DataFrame:
    """The ``k`` most frequent list elements."""
    return top_groups(df.select(F.explode(tokens).alias("token")), "token", k)


def ticket_listing(df: DataFrame) -> DataFrame:
    """K7, L4: the 8-column listing, newest first."""
    return df.select(*[c for c in fixed.LISTING_COLUMNS if c in df.columns]).orderBy(
        F.col("timestamp_dt").desc_nulls_last(), "ticket_id"
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """L3: a few rows to look at."""
    return df.limit(n)
