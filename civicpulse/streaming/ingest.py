"""The two landing streams: tickets and air readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse import schemas
from civicpulse.streaming.arrival import first_arrivals_stream
from civicpulse.streaming.messages import CORRUPT, decode, records


def bronze_tickets(messages: DataFrame) -> DataFrame:
    """First arrivals with coordinates, as the 17 bronze columns.

    Counters are observed on the way: ``read`` (unreadable), ``arrived`` (messages,
    missing_id) and ``landed`` (first, saved); duplicates are messages - missing_id - first.
    Unreadable messages are only counted here; ``TicketLanding`` keeps them as well.
    """
    arrived = (
        records(
            decode(messages, schemas.TICKET_MESSAGE).observe(
                "read", F.count(CORRUPT).alias("unreadable")
            )
        )
        .select("ticket_id", "seq", "value")
        .observe(
            "arrived",
            F.count("*").alias("messages"),
            F.count_if(F.col("ticket_id").isNull()).alias("missing_id"),
        )
    )
    # Only id, place and raw text pass the stateful step; the text is decoded after it.
    first = records(
        decode(first_arrivals_stream(arrived), schemas.TICKET_MESSAGE)
    ).observe(
        "landed",
        F.count("*").alias("first"),
        F.count("coords").alias("saved"),
    )
    return (
        first.filter(F.col("coords").isNotNull())
        .withColumn("processing_time", now_text())
        .select(*schemas.BRONZE_TICKET.fieldNames())
    )


def bronze_air(messages: DataFrame) -> DataFrame:
    """Every reading, no de-duplication; ``AirLanding`` also keeps unreadable ones."""
    return (
        records(decode(messages, schemas.AIR_MESSAGE))
        .withColumn("processing_time", now_text())
        .select(*schemas.BRONZE_AIR.fieldNames())
    )


def counters(report: dict) -> dict:
    """The usual totals from a finished run's report."""
    arrived = report["counters"].get("arrived", {})
    landed = report["counters"].get("landed", {})
    messages = arrived.get("messages", 0)
    missing = arrived.get("missing_id", 0)
    first = landed.get("first", 0)
    return {
        "saved": landed.get("saved", 0),
        "duplicates": messages - missing - first,
        "missing_id": missing,
        "no_coords": first - landed.get("saved", 0),
        "unreadable": report["counters"].get("read", {}).get("unreadable", 0),
    }


def now_text():
    """ISO processing time."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
