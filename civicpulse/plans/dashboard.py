"""One dashboard request as a set of small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.operators.density import grid_density, hex_density
from civicpulse.operators.filters import TicketFilter
from civicpulse.operators.indicators import kpi_captions, kpi_summary, map_center, map_points
from civicpulse.operators.ranking import newest_n, ticket_listing, top_groups, top_tokens
from civicpulse.operators.timeseries import daily_counts


def dashboard(
    gold: DataFrame,
    chosen: TicketFilter = TicketFilter(),
    max_points: int = fixed.MAX_POINTS,
    follow_data: bool = False,
) -> dict[str, DataFrame]:
    """Filter, cap to the newest ``max_points``, then everything else from the cap.

    Only ``total_filtered`` sees all filtered rows. The capped frame is small
    and kept, so the table is read for the count and the cap alone;
    ``result["shown"].unpersist()`` frees it.
    """
    filtered = chosen.apply(gold)
    shown = newest_n(filtered, max_points).persist()
    kpi = kpi_summary(shown)
    return {
        "shown": shown,
        "total_filtered": filtered.agg(F.count("*").alias("total_filtered")),
        "kpi": kpi,
        "captions": kpi_captions(kpi),
        "top_types": top_tokens(shown),
        "top_districts": top_groups(shown, "district"),
        "daily": daily_counts(shown).orderBy("day"),
        "center": map_center(shown, follow_data),
        "points": map_points(shown),
        "hexagons": hex_density(shown),
        "heat": grid_density(shown),
        "listing": ticket_listing(shown),
    }
