"""Silver to the frame every statistic starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from civicpulse import fixed_values as fixed
from civicpulse.functions.parse import days_between, parse_set, reopen_count, state_color
from civicpulse.operators.filters import TicketFilter, drop_unlocated


def gold_tickets(
    silver: DataFrame, null_token: str | None = None, chosen: TicketFilter | None = None
) -> DataFrame:
    """Located tickets with labels for nulls, type tokens, colour and duration.

    ``chosen`` filters the raw columns first, so that its conditions reach the scan.
    """
    if chosen is not None:
        silver = chosen.raw(silver)
    labels = {c: label for c, label in fixed.UNKNOWN_LABELS.items() if c in silver.columns}
    return (
        drop_unlocated(silver)
        .na.fill(labels)
        .withColumns(
            {
                "count_reopen": reopen_count("count_reopen"),
                "type_tokens": parse_set("type", null_token=null_token),
                "state_color": state_color("state"),
                "resolution_days": days_between("timestamp_dt", "last_activity_dt"),
            }
        )
    )
