"""Daily series and the weekday-by-hour table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed


def daily_counts(
    df: DataFrame, ts: str = "timestamp_dt", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per day, 0 on empty days between first and last.

    Null times count nowhere. With ``keys`` each key gets its own series.
    """
    counts = (
        df.select(*keys, F.to_date(ts).alias("day"))
        .filter(F.col("day").isNotNull())
        .groupBy(*keys, "day")
        .agg(F.count("*").alias("n"))
    )
    # Each day also stands for the empty days up to the next one. The window sees
    # one row per day, so the calendar bounds it, not the number of rows.
    following = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    last_empty = F.coalesce(F.date_sub(following, 1), F.col("day"))
    stretch = F.posexplode(F.sequence("day", "last_empty", F.expr("interval 1 day")))
    return counts.withColumn("last_empty", last_empty).select(
        *keys, "n", stretch.alias("offset", "date")
    ).select(
        *keys,
        F.col("date").alias("day"),
        F.when(F.col("offset") == 0, F.col("n")).otherwise(0).alias("n"),
    )


def rolling_mean(
    daily: DataFrame, days: int = fixed.ROLLING_DAYS, keys: Sequence[str] = ()
) -> DataFrame:
    """Trailing mean over a gap-free series, null until the window is full.

    Each day's count is sent to the ``days`` days it belongs to and summed
    there, so a series without keys is not pulled into a single window task.
    """
    sent = daily.select(
        *keys, "day", "n", F.explode(F.array(*[F.lit(i) for i in range(days)])).alias("ahead")
    )
    own = F.when(F.col("ahead") == 0, F.col("n"))
    return (
        sent.groupBy(*keys, F.date_add("day", F.col("ahead")).alias("day"))
        .agg(
            F.sum(own).alias("n"),
            F.when(F.count("*") == days, F.sum("n") / F.lit(float(days))).alias("rolling_mean"),
        )
        # Days after the last one received counts but have none of their own.
        .filter(F.col("n").isNotNull())
    )


def weekday_hour_heatmap(
    df: DataFrame, ts: str = "timestamp_dt", counted: str = "ticket_id"
) -> DataFrame:
    """Monday..Sunday by hour 0..23, null where nothing happened."""
    seen = df.filter(F.col(ts).isNotNull()).select(
        F.date_format(ts, "EEEE").alias("day_of_week"),
        F.hour(ts).alias("hour"),
        F.col(counted).alias("counted"),
    )
    week = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in fixed.WEEKDAYS])).alias("day_of_week"),
        F.lit(None).cast("int").alias("hour"),
        F.lit(None).cast(df.schema[counted].dataType).alias("counted"),
    )
    table = (
        seen.unionByName(week)
        .groupBy("day_of_week")
        .pivot("hour", list(range(24)))
        .agg(F.count("counted"))
    )
    position = F.array_position(F.array(*[F.lit(d) for d in fixed.WEEKDAYS]), F.col("day_of_week"))
    return table.select(
        position.cast("int").alias("day_no"),
        "day_of_week",
        *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in range(24)],
    ).orderBy("day_no")


def daily_mean(
    df: DataFrame, ts: str, value: str, keys: Sequence[str], name: str = "avg_pm25_ug_m3"
) -> DataFrame:
    """Mean per key and day, days without any value left out."""
    return (
        df.groupBy(*keys, F.to_date(ts).alias("date"))
        .agg(F.avg(value).alias(name))
        .filter(F.col(name).isNotNull())
    )


def district_day_table(tickets: DataFrame, air: DataFrame) -> DataFrame:
    """Ticket count beside mean PM2.5 per district and day.

    Both sides are aggregated to the join key first, so a crowded district is
    one row per day by the time it is joined.
    """
    counts = tickets.groupBy("district", F.to_date("timestamp_dt").alias("date")).agg(
        F.count("*").alias("tickets")
    )
    means = air.groupBy("district", F.col("date").cast("date").alias("date")).agg(
        F.avg("avg_pm25_ug_m3").alias("avg_pm25_ug_m3")
    )
    return counts.join(means, ["district", "date"])


def district_day_correlation(table: DataFrame) -> DataFrame:
    """Pearson correlation per district over its days."""
    return table.groupBy("district").agg(
        F.count("*").alias("days"), F.corr("tickets", "avg_pm25_ug_m3").alias("correlation")
    )
