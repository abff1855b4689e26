"""Message queries over finished sets: first arrivals, counters, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicpulse.operators import arrival, ranking
from civicpulse.streaming.messages import decode, records
from querybook.book import query

# Every tenth conversation has no id; a turn of anyone but the user has no position.
SQL_MESSAGES = """m AS (
  SELECT CASE WHEN conv_id % 10 <> 0 THEN conv_id END AS conv_id, turn, role, text,
    (conv_id + turn) % 3 <> 0 AS located FROM conversations),
firsts AS (SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role,
    arg_min(md5(text), turn) AS digest, arg_min(located, turn) AS located
  FROM m WHERE conv_id IS NOT NULL GROUP BY conv_id)"""


def messages(t):
    return t.conversations.select(
        F.when(F.col("conv_id") % 10 != 0, F.col("conv_id")).alias("conv_id"),
        "turn",
        "role",
        F.md5("text").alias("digest"),
        ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("located"),
    )


@query(
    "first_arrival",
    f"WITH {SQL_MESSAGES} SELECT conv_id, turn, role, digest FROM firsts WHERE located",
)
def first_arrival(t):
    return arrival.saved_tickets(messages(t), "conv_id", F.col("located"), ["turn"]).select(
        "conv_id", "turn", "role", "digest"
    )


@query(
    "ingest_counters",
    f"""WITH {SQL_MESSAGES}
    SELECT count(*) FILTER (located) AS saved,
      (SELECT count(conv_id) - count(DISTINCT conv_id) FROM m) AS duplicates,
      (SELECT count(*) FROM m WHERE conv_id IS NULL) AS missing_id,
      count(*) FILTER (NOT located) AS no_coords FROM firsts""",
)
def ingest_counters(t):
    return arrival.ingest_counters(messages(t), "conv_id", F.col("located"), ["turn"])


@query(
    "record_projection",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CAST(NULL AS VARCHAR) AS absent FROM events""",
)
def record_projection(t):
    schema = T.StructType(
        [T.StructField("k", T.IntegerType()), T.StructField("absent", T.StringType())]
    )
    incoming = t.events.select(F.col("event_id").alias("seq"), F.col("props").alias("value"))
    return records(decode(incoming, schema)).select(
        F.col("seq").alias("event_id"), "k", "absent"
    )


@query(
    "newest_preview",
    "SELECT event_id, event_type, props FROM events ORDER BY event_id DESC LIMIT 6",
)
def newest_preview(t):
    return ranking.newest_preview(t.events.select("event_id", "event_type", "props"), "event_id")
