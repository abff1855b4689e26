"""Point density in map cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.geo import grid_cell, hex_center, local_metres, with_hex_cell

EQUATOR_M = 40_075_016.686


def hex_density(
    df: DataFrame,
    radius: float = fixed.HEX_RADIUS_M,
    origin: tuple[float, float] = fixed.DEFAULT_CENTER,
    elevation_range: tuple[float, float] = fixed.HEX_ELEVATION_RANGE,
    elevation_scale: float = fixed.HEX_ELEVATION_SCALE,
) -> DataFrame:
    """Points per hexagon; elevation rescales the counts linearly."""
    east, north = local_metres(F.col("latitude"), F.col("longitude"), origin)
    points = df.select(east.alias("e"), north.alias("n")).dropna()
    # Their range comes from the same shuffled counts, which the subqueries reuse.
    cells = (
        with_hex_cell(points, F.col("e"), F.col("n"), radius)
        .groupBy("q", "r")
        .agg(F.count("*").alias("n"))
    )
    low = cells.agg(F.min("n")).scalar()
    high = cells.agg(F.max("n")).scalar()
    base, top = (F.lit(float(e)) for e in elevation_range)
    share = F.coalesce(F.try_divide((F.col("n") - low).cast("double"), high - low), F.lit(0e0))
    east, north = hex_center(F.col("q"), F.col("r"), radius)
    return cells.select(
        "q",
        "r",
        east.alias("east_m"),
        north.alias("north_m"),
        "n",
        ((base + share * (top - base)) * F.lit(float(elevation_scale))).alias("elevation"),
    )


def grid_density(
    df: DataFrame,
    cell_m: float = 500.0,
    weight: Column | None = None,
    origin: tuple[float, float] = fixed.DEFAULT_CENTER,
) -> DataFrame:
    """Summed weight (1 per point unless given) per square cell."""
    x, y = grid_cell(*local_metres(F.col("latitude"), F.col("longitude"), origin), cell_m)
    one = F.lit(1e0) if weight is None else weight
    return (
        df.select(x.alias("x"), y.alias("y"), one.alias("w"))
        .dropna(subset=["x", "y"])
        .groupBy("x", "y")
        .agg(F.sum("w").alias("weight"))
    )


def pixel_metres(zoom: float, latitude: float) -> float:
    """Metres a screen pixel covers on a web map (256-pixel tiles) at a zoom and latitude."""
    return math.cos(math.radians(latitude)) * EQUATOR_M / (256 * 2**zoom)


def heat_surface(
    df: DataFrame,
    zoom: float = fixed.DEFAULT_ZOOM,
    radius_pixels: int = fixed.HEAT_RADIUS_PIXELS,
    cells_per_radius: int = 8,
    weight: Column | None = None,
    origin: tuple[float, float] = fixed.DEFAULT_CENTER,
) -> DataFrame:
    """``(x, y, heat)``: weights spread by a Gaussian of ``radius_pixels`` at a zoom.

    Points are summed per cell, a cell being a fixed part of the radius on screen; the kernel
    (deviation a third of the radius, cut at the radius along each axis, sums to one) is the
    product of one along x and one along y. So each pass sends a cell's sum to its
    neighbours along one axis and adds up: twice ``2 * cells_per_radius + 1`` rows a cell
    instead of the square of that, combined before the shuffle.
    """
    cell = pixel_metres(zoom, origin[0]) * radius_pixels / cells_per_radius
    heat = grid_density(df, cell, weight, origin).withColumnRenamed("weight", "heat")
    raw = [math.exp(-4.5 * (i / cells_per_radius) ** 2) for i in range(-cells_per_radius, cells_per_radius + 1)]
    steps = F.array(
        *[
            F.struct(F.lit(i - cells_per_radius).cast("bigint").alias("by"), F.lit(k / sum(raw)).alias("share"))
            for i, k in enumerate(raw)
        ]
    )
    for axis in ("x", "y"):
        other = "y" if axis == "x" else "x"
        heat = (
            heat.select(F.col(axis).alias("at"), other, "heat", F.explode(steps).alias("step"))
            .groupBy((F.col("at") + F.col("step.by")).alias(axis), other)
            .agg(F.sum(F.col("heat") * F.col("step.share")).alias("heat"))
        )
    return heat.select("x", "y", "heat")
