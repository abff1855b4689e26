"""Nested API payloads to daily air messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import schemas
from civicpulse.functions.parse import lenient_timestamp
from civicpulse.operators.timeseries import daily_mean


def _parts() -> tuple[Column, Column]:
    empty = F.array()
    return (
        F.coalesce(F.col("hourly.time"), empty.cast("array<string>")),
        F.coalesce(F.col("hourly.pm2_5"), empty.cast("array<double>")),
    )


def usable_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads whose two arrays are equally long; missing parts count as empty."""
    times, values = _parts()
    return payloads.filter(F.size(times) == F.size(values))


def rejected_payloads(payloads: DataFrame) -> DataFrame:
    """The others."""
    times, values = _parts()
    return payloads.filter(F.size(times) != F.size(values))


def hourly_readings(payloads: DataFrame) -> DataFrame:
    """One row per hour and payload."""
    times, values = _parts()
    return usable_payloads(payloads).select(
        "district",
        "latitude",
        "longitude",
        F.inline(F.arrays_zip(times.alias("time"), values.alias("pm25"))),
    )


def air_messages(payloads: DataFrame) -> DataFrame:
    """Daily mean per district; days with no value are left out."""
    hours = hourly_readings(payloads).withColumn("ts", lenient_timestamp("time"))
    means = daily_mean(
        hours.filter(F.col("ts").isNotNull()),
        "ts",
        "pm25",
        ["district", "latitude", "longitude"],
    )
    return means.withColumn("date", F.date_format("date", "yyyy-MM-dd")).select(
        *schemas.AIR_MESSAGE.fieldNames()
    )
