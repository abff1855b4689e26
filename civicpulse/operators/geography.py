"""Geography dimension: de-duplication, imputation, target list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.parse import matches
from civicpulse.session import broadcast_within


def dedup_geography(geo: DataFrame, province_pattern: str | None = None) -> DataFrame:
    """One row per trimmed district, smallest ``(province, lat, lon)`` kept."""
    if province_pattern is not None:
        geo = geo.filter(matches("province", province_pattern))
    place = F.struct("province", "latitude", "longitude")
    return (
        geo.select(F.trim("district").alias("geo_district"), place.alias("place"))
        .groupBy("geo_district")
        .agg(F.min("place").alias("place"))
        .select(
            "geo_district",
            F.col("place.latitude").alias("geo_lat"),
            F.col("place.longitude").alias("geo_long"),
        )
    )


def impute_coordinates(
    tickets: DataFrame,
    geo: DataFrame,
    raw_latitude: Column,
    raw_longitude: Column,
    district: str = "district",
) -> DataFrame:
    """Fill each axis on its own from the district's centroid.

    ``geo`` is the output of :func:`dedup_geography`, so the row count stays.
    The dimension is broadcast only while its measured size is small.
    """
    joined = tickets.join(
        broadcast_within(geo), F.trim(tickets[district]) == geo["geo_district"], "left"
    )
    return joined.withColumns(
        {
            "latitude": F.coalesce(raw_latitude, F.col("geo_lat")),
            "longitude": F.coalesce(raw_longitude, F.col("geo_long")),
        }
    ).drop("geo_district", "geo_lat", "geo_long")


def target_locations(
    geo: DataFrame, province_pattern: str = fixed.PROVINCE_PATTERN
) -> DataFrame:
    """The districts to read air quality for, not de-duplicated."""
    return geo.filter(matches("province", province_pattern)).select(
        F.col("district").alias("name"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
    )


def attach_locations(payloads: DataFrame, locations: DataFrame) -> DataFrame:
    """Give each payload its place's name and position.

    Places may share a name, so payloads that know their position (``lat, lon``) are matched
    by it as well; each payload comes back once however often a place is listed. Without a
    position the name has to be unique.
    """
    place = [c for c in ("name", "lat", "lon") if c in payloads.columns]
    return payloads.join(broadcast_within(locations.distinct()), place).withColumnsRenamed(
        {"name": "district", "lat": "latitude", "lon": "longitude"}
    )
