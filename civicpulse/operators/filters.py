"""Dashboard filters and their option lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.schemas import MONTH, MONTH_OF


@dataclass(frozen=True)
class TicketFilter:
    """Chosen values; an empty choice filters nothing.

    Values inside one field are alternatives, fields combine with AND. A date
    range with one end only is not applied.
    """

    types: Sequence[str] = ()
    states: Sequence[str] = ()
    districts: Sequence[str] = ()
    organizations: Sequence[str] = ()
    first_day: dt.date | None = None
    last_day: dt.date | None = None

    def raw(self, silver: DataFrame) -> DataFrame:
        """Conditions on the raw columns, which reach the scan; :meth:`apply` on gold keeps the same rows.

        A chosen label for missing values stands for null.
        """
        for column, chosen in self._choices():
            if chosen and column in silver.columns:
                label = fixed.UNKNOWN_LABELS.get(column)
                here = F.col(column).isin(list(chosen))
                silver = silver.filter(here | F.col(column).isNull() if label in chosen else here)
        if self.first_day and self.last_day:
            silver = silver.filter(between_days(MONTH_OF, self.first_day, self.last_day))
            silver = prune_months(silver, MONTH_OF, str(self.first_day), str(self.last_day))
        return silver

    def _choices(self) -> list[tuple[str, Sequence[str]]]:
        return [
            ("state", self.states),
            ("district", self.districts),
            ("organization", self.organizations),
        ]

    def apply(self, gold: DataFrame) -> DataFrame:
        if self.types:
            gold = gold.filter(has_any("type_tokens", self.types))
        for column, chosen in self._choices():
            if chosen:
                gold = gold.filter(F.col(column).isin(list(chosen)))
        if self.first_day and self.last_day:
            gold = gold.filter(between_days(MONTH_OF, self.first_day, self.last_day))
            gold = prune_months(gold, MONTH_OF, str(self.first_day), str(self.last_day))
        return gold


def has_any(tokens: str, wanted: Sequence[str]) -> Column:
    """The token list shares a value with ``wanted``."""
    return F.arrays_overlap(F.col(tokens), F.array(*[F.lit(w) for w in wanted]))


def between_days(ts: str, first_day: dt.date, last_day: dt.date) -> Column:
    """Both days included, as a range on the raw column so that it pushes down."""
    start = dt.datetime.combine(first_day, dt.time())
    end = dt.datetime.combine(last_day + dt.timedelta(days=1), dt.time())
    return (F.col(ts) >= F.lit(str(start)).cast("timestamp")) & (
        F.col(ts) < F.lit(str(end)).cast("timestamp")
    )


def prune_months(
    df: DataFrame, ts: str, first_day: str, last_day: str | None = None
) -> DataFrame:
    """Skip the silver folders outside a day range of ``ts``.

    Folders hold months of ``timestamp_dt``; a range over another column says
    nothing about them and skips none.
    """
    if ts == MONTH_OF and MONTH in df.columns:
        df = df.filter(F.col(MONTH) >= first_day[:7])
        if last_day is not None:
            df = df.filter(F.col(MONTH) <= last_day[:7])
    return df


def drop_unlocated(df: DataFrame) -> DataFrame:
    """rows without a position go (null or NaN); the null tests reach the scan."""
    for axis in ("latitude", "longitude"):
        df = df.filter(F.col(axis).isNotNull() & ~F.isnan(axis))
    return df


def token_options(df: DataFrame, tokens: str = "type_tokens") -> DataFrame:
    """Sorted distinct list elements as ``value``."""
    return df.select(F.explode(tokens).alias("value")).distinct().orderBy("value")


def filter_options(
    gold: DataFrame, fields: Sequence[str] = ("state", "district", "organization")
) -> DataFrame:
    """A12 + A13 in one scan: ``(field, value)`` for every filter."""
    pairs = F.concat(
        F.transform("type_tokens", lambda t: F.struct(F.lit("type").alias("field"), t.alias("value"))),
        F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
        ),
    )
    return (
        gold.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
        .orderBy("field", "value")
    )


def default_types(gold: DataFrame, n: int = fixed.DEFAULT_TYPE_CHOICES) -> DataFrame:
    """The first ``n`` type options, chosen at start."""
    return token_options(gold).limit(n)


def date_bounds(
    df: DataFrame,
    ts: str = "timestamp_dt",
    window_days: int = fixed.DEFAULT_WINDOW_DAYS,
    today: dt.date | None = None,
) -> DataFrame:
    """``min_date, max_date, default_start`` in one row."""
    no_max = F.current_date() if today is None else F.lit(today)
    days = df.agg(
        F.coalesce(F.to_date(F.min(ts)), F.lit(fixed.DEFAULT_MIN_DATE).cast("date")).alias(
            "min_date"
        ),
        F.coalesce(F.to_date(F.max(ts)), no_max).alias("max_date"),
    )
    return days.withColumn(
        "default_start", F.greatest("min_date", F.date_sub("max_date", window_days))
    )
