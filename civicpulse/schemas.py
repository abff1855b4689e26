"""Explicit schemas: no scan ever needs an inference pass."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


TICKET_MESSAGE = T.StructType(
    _strings(
        [
            "ticket_id", "type", "organization", "comment", "photo", "photo_after", "coords", "address",
            "subdistrict", "district", "province", "timestamp", "state", "star", "count_reopen",
            "last_activity",
        ]
    )
)

BRONZE_TICKET = T.StructType(TICKET_MESSAGE.fields + _strings(["processing_time"]))

SILVER_TICKET = T.StructType(
    _strings(["ticket_id", "type", "organization", "comment", "photo", "photo_after"])
    + [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
    + _strings(["address", "province", "district", "subdistrict", "state"])
    + [T.StructField("star", T.IntegerType())]
    + _strings(["count_reopen"])
    + [
        T.StructField("timestamp_dt", T.TimestampType()),
        T.StructField("last_activity_dt", T.TimestampType()),
    ]
)

AIR_MESSAGE = T.StructType(
    _strings(["district", "date"])
    + [
        T.StructField("avg_pm25_ug_m3", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

BRONZE_AIR = T.StructType(
    [
        T.StructField("district", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("avg_pm25_ug_m3", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("processing_time", T.TimestampType()),
    ]
)

SILVER_AIR = T.StructType(BRONZE_AIR.fields + _strings(["pm25_category"]))

GEOGRAPHY = T.StructType(
    _strings(["province", "district"])
    + [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

AIR_PAYLOAD = T.StructType(
    [
        T.StructField("district", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    T.StructField("pm2_5", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
    ]
)

# Folder column of partitioned silver: the month of MONTH_OF as yyyy-MM.
MONTH = "ticket_month"
MONTH_OF = "timestamp_dt"

# One landed or queued message: its place in arrival order and its raw text.
STAGED_MESSAGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)
