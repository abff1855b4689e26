"""Streaming queries: the tables are staged as messages, streamed, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicpulse import schemas
from civicpulse.session import scratch_path
from civicpulse.sinks.files import as_messages, stage_messages
from civicpulse.sources.files import read_bronze_air
from civicpulse.streaming import ingest, sinks
from civicpulse.streaming.landing import AirLanding, TicketLanding
from civicpulse.streaming.messages import decode, quarantine, staged_stream
from querybook.book import query


def _run(t, staged, stream, sink=sinks.to_parquet, max_files=None):
    """Stage messages, run ``stream`` over them to the end, return the output folder."""
    base = scratch_path(t.spark, "stream")
    stage_messages(staged, f"{base}/in")
    query = sink(
        stream(staged_stream(t.spark, f"{base}/in", max_files)), f"{base}/out", f"{base}/state"
    )
    sinks.finish(query)
    return f"{base}/out"


def _ticket_messages(t):
    # Two messages share an id; the later one only counts where the first is absent.
    i = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    position = F.concat(
        F.lit("["), (100 + i % 2).cast("string"), F.lit(".5, 13."), (i % 10).cast("string"), F.lit("]")
    )
    rows = t.events.select(
        i.alias("seq"),
        F.when(i % 31 != 0, F.floor(i / 2).cast("string")).alias("ticket_id"),
        "event_type",
        F.when(i % 19 != 0, position).alias("coords"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("props").alias("comment"),
    )
    body = F.struct(
        "ticket_id", F.col("event_type").alias("type"), "coords", "timestamp", "comment",
        F.lit("unknown field").alias("extra"),
    )
    # to_json leaves null fields out: an absent key, which is what burns an id.
    return rows.select("seq", F.to_json(body).alias("value"))


# Messages are staged in this many files in order of seq, and read one file a micro-batch.
STAGED_FILES = 4


def _staged_in_order(t, staged):
    """Stage messages so that each file holds a range of ``seq`` and later ones come later."""
    base = scratch_path(t.spark, "stream")
    last = staged.agg(F.max("seq")).first()[0] or 0
    for i in range(STAGED_FILES):
        lane = F.floor(F.col("seq") * STAGED_FILES / (last + 1))
        stage_messages(staged.filter(lane == i).coalesce(1), f"{base}/in")
    return base


def _landed(t, staged):
    base = _staged_in_order(t, staged)
    landing = TicketLanding(f"{base}/tickets")
    report = sinks.finish(landing.start(staged_stream(t.spark, f"{base}/in", 1)))
    assert report["batches"] >= 3 or staged.count() < STAGED_FILES, report
    return landing


SQL_TICKET_MESSAGES = """m AS (SELECT event_id AS seq,
    CASE WHEN event_id % 31 <> 0 THEN CAST(event_id // 2 AS VARCHAR) END AS ticket_id,
    event_type AS type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, props AS comment,
    CASE WHEN event_id % 19 <> 0 THEN '[' || CAST(100 + event_id % 2 AS VARCHAR) || '.5, 13.'
      || CAST(event_id % 10 AS VARCHAR) || ']' END AS coords FROM events)"""


@query(
    "landing_counters",
    f"""WITH {SQL_TICKET_MESSAGES}, kept AS (SELECT * FROM m WHERE seq % 37 <> 0),
    f AS (SELECT * FROM kept WHERE ticket_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY seq) = 1)
    SELECT count(*) FILTER (coords IS NOT NULL) AS saved,
      (SELECT count(ticket_id) - count(DISTINCT ticket_id) FROM kept) AS duplicates,
      (SELECT count(*) FROM kept WHERE ticket_id IS NULL) AS missing_id,
      count(*) FILTER (coords IS NULL) AS no_coords,
      (SELECT count(*) FROM m WHERE seq % 37 = 0) AS unreadable FROM f""",
)
def landing_counters(t):
    # Every 37th message lost its last character.
    cut = F.expr("substr(value, 1, length(value) - 1)")
    staged = _ticket_messages(t).select(
        "seq", F.when(F.col("seq") % 37 == 0, cut).otherwise(F.col("value")).alias("value")
    )
    return _landed(t, staged).counters(t.spark)


@query(
    "stream_cadence",
    "SELECT count(*) AS records, true AS stamped FROM events",
)
def stream_cadence(t):
    """A run with a flush cadence stamps every record; it is stopped once all are in."""
    staged = t.events.select(
        F.col("event_id").alias("seq"),
        F.to_json(F.struct(F.col("event_type").alias("district"), F.lit(1.5).alias("avg_pm25_ug_m3"))).alias("value"),
    )
    base = scratch_path(t.spark, "stream")
    stage_messages(staged, f"{base}/in")
    landing = AirLanding(f"{base}/air")
    running = landing.start(staged_stream(t.spark, f"{base}/in"), every="1 second")
    running.processAllAvailable()
    running.stop()
    return landing.bronze(t.spark).agg(
        F.count("*").alias("records"), (F.count("processing_time") == F.count("*")).alias("stamped")
    )


@query(
    "stream_ticket_bronze",
    f"""WITH {SQL_TICKET_MESSAGES},
    f AS (SELECT * FROM m WHERE ticket_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY seq) = 1)
    SELECT ticket_id, type, comment, coords, timestamp FROM f WHERE coords IS NOT NULL""",
)
def stream_ticket_bronze(t):
    landing = _landed(t, _ticket_messages(t))
    return landing.bronze(t.spark).select("ticket_id", "type", "comment", "coords", "timestamp")


@query(
    "stream_first_arrival",
    """WITH m AS (SELECT conv_id, turn, role, md5(text) AS digest, (conv_id + turn) % 3 <> 0 AS located,
        conv_id * 1000 + turn AS seq FROM conversations WHERE conv_id % 10 <> 0)
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, role, digest FROM m
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq) = 1 AND located""",
)
def stream_first_arrival(t):
    """First turns through the ledger form, several micro-batches, no Python per key."""
    located = (F.col("conv_id") + F.col("turn")) % 3 != 0
    staged = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.to_json(
            F.struct(
                F.when(F.col("conv_id") % 10 != 0, F.col("conv_id").cast("string")).alias("ticket_id"),
                F.col("role").alias("type"),
                F.md5("text").alias("comment"),
                F.when(located, F.lit("13.7,100.5")).alias("coords"),
            )
        ).alias("value"),
    )
    return _landed(t, staged).bronze(t.spark).select(
        F.col("ticket_id").alias("conv_id"), F.col("type").alias("role"), F.col("comment").alias("digest")
    )


@query(
    "stream_bridge",
    "SELECT event_id AS seq, props AS value FROM events",
)
def stream_bridge(t):
    staged = t.events.select(F.col("event_id").alias("seq"), F.col("props").alias("value"))
    out = _run(t, staged, lambda stream: stream, sinks.to_json, max_files=2)
    return t.spark.read.schema(schemas.STAGED_MESSAGE).json(out)


@query(
    "stream_air_bronze",
    """SELECT 'D' || CAST(user_id % 50 AS VARCHAR) AS district,
      CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(avg(value / 7e0), 6) AS avg_pm25_ug_m3
    FROM events GROUP BY ALL""",
)
def stream_air_bronze(t):
    days = t.events.groupBy(
        F.concat(F.lit("D"), (F.col("user_id") % 50).cast("string")).alias("district"),
        F.to_date("ts").cast("string").alias("date"),
    ).agg(F.round(F.avg(F.col("value") / F.lit(7e0)), 6).alias("avg_pm25_ug_m3"))
    place = {"latitude": F.lit(13.7), "longitude": F.lit(100.5)}
    staged = as_messages(days.withColumns(place).withColumn("seq", F.xxhash64("district", "date")), "seq")
    out = _run(t, staged, ingest.bronze_air, sinks.to_csv)
    return read_bronze_air(t.spark, out).select(
        "district", F.col("date").cast("string").alias("date"), "avg_pm25_ug_m3"
    )


@query(
    "corrupt_quarantine",
    """SELECT event_id AS seq, substr(props, 1, length(props) - 1) AS value FROM events
    WHERE event_id % 10 = 0""",
)
def corrupt_quarantine(t):
    # Every tenth message lost its last character, every eleventh is no message.
    i, props = F.col("event_id"), F.col("props")
    staged = t.events.select(
        i.alias("seq"),
        F.when(i % 10 == 0, F.expr("substr(props, 1, length(props) - 1)"))
        .when(i % 11 == 0, "null")
        .otherwise(props)
        .alias("value"),
    )
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    out = _run(t, staged, lambda stream: quarantine(decode(stream, schema)))
    return t.spark.read.parquet(out)
