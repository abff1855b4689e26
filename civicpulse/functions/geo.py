"""Planar cells around a reference point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed

METRES_PER_DEGREE = 111320.0


def local_metres(
    latitude: Column, longitude: Column, origin: tuple[float, float] = fixed.DEFAULT_CENTER
) -> tuple[Column, Column]:
    """East and north distance from ``origin`` (equirectangular)."""
    lat0, lon0 = origin
    east = (longitude - F.lit(lon0)) * F.lit(METRES_PER_DEGREE * math.cos(math.radians(lat0)))
    north = (latitude - F.lit(lat0)) * F.lit(METRES_PER_DEGREE)
    return east, north


def with_hex_cell(df: DataFrame, east: Column, north: Column, radius: float) -> DataFrame:
    """Add ``q, r``: the pointy-top hexagon whose centre is nearest.

    Built column by column, so each step is computed once per row.
    """
    f, near, moved = F.col("_f"), F.col("_near"), F.col("_moved")
    return (
        df.withColumn(
            "_f",
            F.struct(
                ((F.lit(math.sqrt(3) / 3) * east - north / F.lit(3.0)) / F.lit(float(radius))).alias("q"),
                (F.lit(2.0 / 3.0) * north / F.lit(float(radius))).alias("r"),
            ),
        )
        # floor(x + 0.5): one rounding rule for either sign.
        .withColumn(
            "_near",
            F.struct(
                F.floor(f.q + F.lit(0.5)).cast("double").alias("q"),
                F.floor(f.r + F.lit(0.5)).cast("double").alias("r"),
                F.floor(-f.q - f.r + F.lit(0.5)).cast("double").alias("s"),
            ),
        )
        .withColumn(
            "_moved",
            F.struct(
                F.abs(near.q - f.q).alias("q"),
                F.abs(near.r - f.r).alias("r"),
                F.abs(near.s + f.q + f.r).alias("s"),
            ),
        )
        # Rounded cube coordinates must add to 0: the one that moved most follows.
        .withColumn(
            "q",
            F.when((moved.q > moved.r) & (moved.q > moved.s), -near.r - near.s)
            .otherwise(near.q)
            .cast("bigint"),
        )
        .withColumn(
            "r",
            F.when((moved.q > moved.r) & (moved.q > moved.s), near.r)
            .when(moved.r > moved.s, -near.q - near.s)
            .otherwise(near.r)
            .cast("bigint"),
        )
        .drop("_f", "_near", "_moved")
    )


def hex_center(q: Column, r: Column, radius: float) -> tuple[Column, Column]:
    """East and north of a hexagon's centre."""
    east = F.lit(float(radius) * math.sqrt(3)) * (q + r / F.lit(2.0))
    north = F.lit(float(radius) * 1.5) * r
    return east, north


def grid_cell(east: Column, north: Column, size: float) -> tuple[Column, Column]:
    """Square cell id."""
    return F.floor(east / F.lit(float(size))), F.floor(north / F.lit(float(size)))
