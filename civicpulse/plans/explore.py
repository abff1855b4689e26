"""The exploratory charts' data over all gold tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from civicpulse import fixed_values as fixed
from civicpulse.operators.distribution import (
    density_curve,
    exact_median,
    finished_within,
    histogram,
    value_counts,
)
from civicpulse.operators.ranking import top_tokens
from civicpulse.operators.timeseries import daily_counts, rolling_mean, weekday_hour_heatmap


def explore(gold: DataFrame) -> dict[str, DataFrame]:
    """Top types, trend with moving mean, resolution times, weekday-by-hour table."""
    durations = value_counts(finished_within(gold), "resolution_days")
    return {
        "top_types": top_tokens(gold, k=fixed.EXPLORE_TOP),
        "trend": rolling_mean(daily_counts(gold)).orderBy("day"),
        "resolution_histogram": histogram(durations).orderBy("bin"),
        "resolution_curve": density_curve(durations).orderBy("point"),
        "resolution_median": exact_median(durations),
        "heatmap": weekday_hour_heatmap(gold),
    }
