"""One-row summaries of the shown tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed


def kpi_summary(shown: DataFrame, done_state: str = fixed.DONE_STATE) -> DataFrame:
    """Count, closing rate in percent, mean reopenings, mean days.

    Rate and reopenings are 0 for an empty frame, days are null.
    """
    done = F.count_if(F.col("state") == done_state)
    return shown.agg(
        F.count("*").alias("tickets"),
        F.coalesce(F.try_divide(F.lit(100e0) * done, F.count("*")), F.lit(0e0)).alias(
            "resolution_rate"
        ),
        F.coalesce(F.avg("count_reopen"), F.lit(0e0)).alias("avg_reopen"),
        F.avg("resolution_days").alias("avg_resolution_days"),
    )


def fixed_digits(col: str | Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the double's exact value, ties to even.

    The scaled fraction is formed as an exact sum of two doubles: the fraction is split
    into halves of 26 bits, whose products with a power of ten are exact, and the
    error of their sum decides where the sum itself is a tie. Null stays null; for
    magnitudes from 2**52 on a double has no fraction.
    """
    value = F.col(col) if isinstance(col, str) else col
    size = F.abs(value)
    whole = F.floor(size)
    fraction = size - whole
    scale = float(10**digits)
    upper = F.floor(fraction * F.lit(float(1 << 26))) / F.lit(float(1 << 26))
    high, low = upper * F.lit(scale), (fraction - upper) * F.lit(scale)
    total = high + low
    error = low - (total - high)
    steps = F.floor(total)
    beyond = total - steps - F.lit(0.5)
    up = (
        F.when(beyond > 0, 1)
        .when(beyond < 0, 0)
        .when(error > 0, 1)
        .when(error < 0, 0)
        # A tie: to the even one of the two last digits.
        .otherwise((whole * 10**digits + steps) % 2)
    )
    scaled = whole * 10**digits + steps + up
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    rest = F.lpad((scaled % 10**digits).cast("string"), digits, "0")
    return F.concat(sign, F.floor(scaled / 10**digits).cast("string"), F.lit("."), rest)


def kpi_captions(kpi: DataFrame, *keys: str) -> DataFrame:
    """The same figures as display text with fixed digits, ``keys`` beside them."""
    return kpi.select(
        *keys,
        F.format_number("tickets", 0).alias("tickets"),
        F.concat(fixed_digits("resolution_rate", 1), F.lit("%")).alias("resolution_rate"),
        fixed_digits("avg_reopen", 2).alias("avg_reopen"),
        fixed_digits("avg_resolution_days", 1).alias("avg_resolution_days"),
    )


def map_center(
    shown: DataFrame,
    follow_data: bool = True,
    default: tuple[float, float] = fixed.DEFAULT_CENTER,
) -> DataFrame:
    """Mean position and zoom, or the fixed centre."""
    lat, lon = (F.lit(v) for v in default)
    if not follow_data:
        return shown.sparkSession.range(1).select(
            lat.alias("latitude"), lon.alias("longitude"), F.lit(11).alias("zoom")
        )
    return shown.agg(
        F.coalesce(F.avg("latitude"), lat).alias("latitude"),
        F.coalesce(F.avg("longitude"), lon).alias("longitude"),
    ).withColumn("zoom", F.lit(10))


def map_points(shown: DataFrame) -> DataFrame:
    """Position, fill colour and hover fields of each shown ticket."""
    return shown.select(*[c for c in fixed.MAP_COLUMNS if c in shown.columns])


def quality_checks(df: DataFrame) -> DataFrame:
    """Row count and unlocated rows in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("latitude").isNull()).alias("null_latitude"),
        F.count_if(F.col("longitude").isNull()).alias("null_longitude"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, non_null, nulls)`` from one aggregation."""
    counts = df.agg(
        F.count("*").alias("n"),
        *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(dtype).alias("dtype"),
                F.col(f"c{i}").alias("non_null"),
                (F.col("n") - F.col(f"c{i}")).alias("nulls"),
            )
            for i, (name, dtype) in enumerate(df.dtypes)
        ]
    )
    return counts.select(F.inline(rows))
