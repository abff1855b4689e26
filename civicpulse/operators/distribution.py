"""Histogram, density curve and exact median of one numeric column."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.session import via_table


def finished_within(
    gold: DataFrame,
    state: str = fixed.DONE_STATE,
    limit_days: float = fixed.RESOLUTION_LIMIT_DAYS,
) -> DataFrame:
    """Finished tickets with ``0 <= resolution_days < limit_days``."""
    days = F.col("resolution_days")
    return gold.filter((F.col("state") == state) & (days >= 0) & (days < limit_days))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their counts ``(v, n)``, written for several readers.

    The distributions below all take this frame, so the tickets are scanned
    once. Tickets are stamped to the second: sixty days hold at most 5.2 million
    distinct durations however many tickets there are.
    """
    counts = (
        df.select(F.col(value).cast("double").alias("v"))
        .dropna()
        .groupBy("v")
        .agg(F.count("*").alias("n"))
    )
    return via_table(counts, "values")


def histogram(counts: DataFrame, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from min to max, last one closed, empty ones 0."""
    span = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # All values equal: a unit-wide range around them.
    span = span.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    low, high = span.select("lo").scalar(), span.select("hi").scalar()
    placed = counts.select("v", "n", low.alias("lo"), high.alias("hi")).withColumn(
        "w", (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    )

    def edge(i: Column) -> Column:
        return F.col("lo") + i * F.col("w")

    guess = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1))
    # The quotient may round across an edge; the edge itself decides.
    step = (
        F.when(F.col("v") < edge(F.col("guess")), -1)
        .when((F.col("v") >= edge(F.col("guess") + 1)) & (F.col("guess") < bins - 1), 1)
        .otherwise(0)
    )
    filled = (
        placed.withColumn("guess", guess)
        .select((F.col("guess") + step).cast("int").alias("bin"), "n")
    )
    empty = span.filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return (
        filled.unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .select("bin", "n", low.alias("lo"), ((high - low) / F.lit(float(bins))).alias("w"))
        .select(
            "bin",
            edge(F.col("bin")).alias("left_edge"),
            edge(F.col("bin") + 1).alias("right_edge"),
            "n",
        )
    )


def density_curve(
    counts: DataFrame,
    points: int = fixed.KDE_POINTS,
    bins: int = fixed.HISTOGRAM_BINS,
) -> DataFrame:
    """Gaussian kernel density on ``points`` positions, scaled to histogram counts.

    Bandwidth is ``sd * n^(-1/5)``. Fewer than two distinct values have no curve.
    """
    v, n = F.col("v"), F.col("n")
    total = F.sum(n)
    mean = counts.agg((F.sum(v * n) / total).alias("mean")).scalar()
    spread = counts.agg(
        total.alias("total"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.sum(n * F.pow(v - mean, F.lit(2.0))).alias("ss"),
    ).filter(F.col("hi") > F.col("lo"))
    shape = spread.select(
        F.struct(
            F.col("lo"),
            ((F.col("hi") - F.col("lo")) / F.lit(float(points - 1))).alias("step"),
            (
                F.sqrt(F.col("ss") / (F.col("total") - 1))
                * F.pow(F.col("total").cast("double"), F.lit(-0.2))
            ).alias("h"),
            ((F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("w"),
        ).alias("shape")
    ).scalar()
    names = ["point", "x", "y"]

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, where, scale = np.zeros(points), None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column("s")[0].as_py()
            where = s["lo"] + np.arange(points) * s["step"]
            scale = s["w"] / (s["h"] * math.sqrt(2 * math.pi))
            values, counted = batch.column("v").to_numpy(), batch.column("n").to_numpy()
            for a in range(0, len(values), 1024):
                offset = (where - values[a : a + 1024, None]) / s["h"]
                total += counted[a : a + 1024] @ np.exp(-0.5 * offset * offset)
        if where is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(points), pa.int32()), pa.array(where), pa.array(total * scale)], names)

    # A task sends one sum per grid point, however many values it has.
    return (
        counts.select("v", "n", shape.alias("s"))
        .filter(F.col("s").isNotNull())
        .mapInArrow(masses, "point int, x double, y double")
        .groupBy("point", "x")
        .agg(F.sum("y").alias("y"))
    )


def binned_density_curve(
    counts: DataFrame,
    points: int = fixed.KDE_POINTS,
    bins: int = fixed.HISTOGRAM_BINS,
    cells: int = 1 << 15,
) -> DataFrame:
    """The density curve from sums on a fine grid instead of from every value.

    Each value is shared between its two neighbours on a grid of ``cells`` steps, in
    proportion to how near it lies; kernels are then summed over the grid alone. A kernel
    read by such interpolation is off by at most its second derivative times ``step**2 / 8``,
    so a point of the curve by at most ``total * w * (step / h)**2 / (8 * h * sqrt(2 * pi))``,
    ``h`` being the bandwidth and ``w`` the bar width: below 1e-6 of the highest possible
    value while the bandwidth spans 360 steps.
    """
    v, n = F.col("v"), F.col("n")
    total = F.sum(n)
    facts = counts.agg(
        total.alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"), (F.sum(v * n) / total).alias("mean")
    ).first()
    empty = "point int, x double, y double"
    if facts.total is None or not facts.hi > facts.lo:
        return counts.sparkSession.createDataFrame([], empty)
    squares = counts.agg(F.sum(n * F.pow(v - F.lit(facts.mean), F.lit(2.0)))).first()[0]
    h = math.sqrt(squares / (facts.total - 1)) * facts.total**-0.2
    width, step, at = (facts.hi - facts.lo) / bins, (facts.hi - facts.lo) / cells, (facts.hi - facts.lo) / (points - 1)
    place = (v - F.lit(facts.lo)) / F.lit(step)
    left = F.least(F.floor(place), F.lit(cells - 1))
    grid = (
        counts.select(n, place.alias("place"), left.alias("left"))
        .select(
            F.inline(
                F.array(
                    F.struct(F.col("left").alias("cell"), (n * (F.col("left") + 1 - F.col("place"))).alias("mass")),
                    F.struct((F.col("left") + 1).alias("cell"), (n * (F.col("place") - F.col("left"))).alias("mass")),
                )
            )
        )
        .groupBy("cell")
        .agg(F.sum("mass").alias("mass"))
    )
    # At most ``cells + 1`` rows, whatever the number of values.
    point = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    offset = (F.col("point") * F.lit(at) - F.col("cell") * F.lit(step)) / F.lit(h)
    return (
        grid.select("cell", "mass", point)
        .groupBy("point")
        .agg(F.sum(F.col("mass") * F.exp(F.lit(-0.5) * offset * offset)).alias("mass"))
        .select(
            "point", (F.lit(facts.lo) + F.col("point") * F.lit(at)).alias("x"),
            (F.col("mass") * F.lit(width / (h * math.sqrt(2 * math.pi)))).alias("y"),
        )
    )


def exact_median(
    counts: DataFrame, slices: int = 1024, window_rows: int = 100_000
) -> DataFrame:
    """A10: exact median without gathering the values anywhere.

    A bracket around the middle ranks is narrowed by histograms of ``slices`` rows until it holds at most
    ``window_rows`` distinct values, and only those are ranked.
    """
    v, n = F.col("v"), F.col("n")
    facts = counts.agg(F.min(v), F.max(v), F.sum(n), F.count("*")).first()
    lo, hi, total, distinct = facts
    below = 0
    if total is not None:
        first_rank, last_rank = (total + 1) // 2, total // 2 + 1
        while distinct > window_rows and hi > lo:
            width = (hi - lo) / slices
            if width == 0 or lo + width == lo:
                break
            piece = F.least(
                F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(slices - 1)
            ).alias("piece")
            pieces = (
                counts.filter(v.between(lo, hi))
                .groupBy(piece)
                .agg(
                    F.sum(n).alias("n"),
                    F.count("*").alias("distinct"),
                    F.min(v).alias("lo"),
                    F.max(v).alias("hi"),
                )
                .orderBy("piece")
                .collect()  # at most `slices` rows
            )
            hits = []
            seen = below
            for row in pieces:
                if seen + row.n >= first_rank and seen < last_rank:
                    hits.append((seen, row))
                seen += row.n
            if len(hits) > 1:
                # The middle falls between two pieces: their facing ends are the answer.
                return counts.filter(v.isin(hits[0][1].hi, hits[-1][1].lo)).agg(
                    F.avg("v").alias("median")
                )
            below, piece_row = hits[0]
            if piece_row.distinct == distinct:
                break
            lo, hi, distinct = piece_row.lo, piece_row.hi, piece_row.distinct
    else:
        first_rank = last_rank = 0
    upto = F.lit(below) + F.sum(n).over(
        Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counts.filter(v.between(lo, hi) if lo is not None else F.lit(False)).select(
        v, n, upto.alias("upto")
    )
    middle = ((F.col("upto") >= first_rank) & (F.col("upto") - n < first_rank)) | (
        (F.col("upto") >= last_rank) & (F.col("upto") - n < last_rank)
    )
    return ranked.filter(middle).agg(F.avg("v").alias("median"))


def approximate_median(df: DataFrame, value: str, accuracy: int = 10_000) -> DataFrame:
    """A10 in one pass with a bounded rank error of ``1 / accuracy``."""
    return df.agg(F.percentile_approx(value, 0.5, accuracy).alias("median"))
