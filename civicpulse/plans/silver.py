"""Bronze to silver (P1-P4, J1, J2, C*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse import schemas
from civicpulse.functions.parse import (
    clean_text,
    lenient_int,
    parse_coords,
    parse_ticket_timestamp,
    pm25_band,
)
from civicpulse.operators.geography import dedup_geography, impute_coordinates


def silver_tickets(
    bronze: DataFrame, geography: DataFrame, province_pattern: str | None = None
) -> DataFrame:
    """Typed, cleaned, located tickets: the 17 silver columns, same rows as bronze."""
    parsed = bronze.withColumns(
        {
            "_raw": parse_coords("coords"),
            "comment": clean_text("comment"),
            "star": lenient_int("star"),
            "timestamp_dt": parse_ticket_timestamp("timestamp"),
            "last_activity_dt": parse_ticket_timestamp("last_activity"),
        }
    )
    located = impute_coordinates(
        parsed,
        dedup_geography(geography, province_pattern),
        F.col("_raw.latitude"),
        F.col("_raw.longitude"),
    )
    return located.select(*schemas.SILVER_TICKET.fieldNames())


def silver_air(bronze: DataFrame, null_band: str | None = fixed.PM25_TOP_BAND) -> DataFrame:
    """Bronze air with its band."""
    return bronze.withColumn("pm25_category", pm25_band("avg_pm25_ug_m3", null_band))
