"""Registry, table access and the ticket-shaped view shared by all bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.plans.gold import gold_tickets
from civicpulse.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's parquet tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tickets(self, *extra: Column) -> DataFrame:
        return tickets(self.events, *extra)

    def gold(self) -> DataFrame:
        return gold_tickets(self.tickets())


def query(name: str, sql: str | None = None):
    """Register a binding ``f(tables) -> DataFrame`` under ``name``."""

    def register(bind: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return bind(Tables(tune(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return bind

    return register


def six(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that summation order does not show."""
    return df.select(
        *[
            F.round(c, 6).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def stamp(col: str) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(col)


def sql_stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f') AS {col}"


def tickets(events: DataFrame, *extra: Column) -> DataFrame:
    """Ticket-shaped rows from ``events``; nulls of every kind occur."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    states = F.array(*[F.lit(s) for s in fixed.STATE_COLORS])
    later = F.floor((F.col("value") - F.lit(5e0)) * F.lit(86400e0)) * 1_000_000
    return events.select(
        i.alias("ticket_id"),
        F.when(i % 13 == 0, F.lit(None).cast("string"))
        .when(i % 11 == 0, "{}")
        .otherwise(
            F.concat(F.lit("{"), "event_type", F.lit(", k"), (k % 7).cast("string"), F.lit("}"))
        )
        .alias("type"),
        F.when(i % 17 != 0, F.get(states, i % 5)).alias("state"),
        F.when(i % 23 != 0, F.concat(F.lit("D"), (F.col("user_id") % 50).cast("string"))).alias(
            "district"
        ),
        F.concat(F.lit("Org"), (F.col("user_id") % 7).cast("string")).alias("organization"),
        F.when(i % 29 != 0, ts).alias("timestamp_dt"),
        F.timestamp_micros(F.unix_micros(ts) + later).alias("last_activity_dt"),
        F.when(i % 7 != 0, (i % 4).cast("string")).alias("count_reopen"),
        F.when(
            i % 19 != 0, F.lit(13.5e0) + (i * 7919 % 1000) / F.lit(1e3) * F.lit(0.45e0)
        ).alias("latitude"),
        F.when(
            i % 19 != 0, F.lit(100.3e0) + (i * 104729 % 1000) / F.lit(1e3) * F.lit(0.6e0)
        ).alias("longitude"),
        *extra,
    )


_STATES = ", ".join(f"'{s}'" for s in fixed.STATE_COLORS)

SQL_TICKETS = f"""tickets AS (
  SELECT event_id AS ticket_id,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '{{}}'
      ELSE '{{' || event_type || ', k'
        || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) || '}}'
      END AS type,
    CASE WHEN event_id % 17 <> 0 THEN [{_STATES}][event_id % 5 + 1] END AS state,
    CASE WHEN event_id % 23 <> 0 THEN 'D' || CAST(user_id % 50 AS VARCHAR) END AS district,
    'Org' || CAST(user_id % 7 AS VARCHAR) AS organization,
    CASE WHEN event_id % 29 <> 0 THEN ts END AS timestamp_dt,
    ts + to_seconds(CAST(floor((value - 5e0) * 86400e0) AS BIGINT)) AS last_activity_dt,
    CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 4 AS VARCHAR) END AS count_reopen,
    CASE WHEN event_id % 19 <> 0
      THEN 13.5e0 + (event_id * 7919 % 1000) / 1e3 * 0.45e0 END AS latitude,
    CASE WHEN event_id % 19 <> 0
      THEN 100.3e0 + (event_id * 104729 % 1000) / 1e3 * 0.6e0 END AS longitude
  FROM events)"""


def sql_tokens(col: str, strip: str = "{} ") -> str:
    return (
        f"list_filter(list_transform(string_split(trim({col}, '{strip}'), ','), "
        "lambda t: trim(t)), lambda t: t <> '')"
    )


_LABELS = fixed.UNKNOWN_LABELS

SQL_GOLD = f"""{SQL_TICKETS}, gold AS (
  SELECT ticket_id, type, organization, timestamp_dt, last_activity_dt, latitude, longitude,
    coalesce(state, '{_LABELS["state"]}') AS state,
    coalesce(district, '{_LABELS["district"]}') AS district,
    coalesce(TRY_CAST(trunc(TRY_CAST(count_reopen AS DOUBLE)) AS INTEGER), 0) AS count_reopen,
    coalesce({sql_tokens("type")}, []) AS type_tokens,
    (epoch_us(last_activity_dt) - epoch_us(timestamp_dt)) / 86400e6 AS resolution_days
  FROM tickets WHERE latitude IS NOT NULL AND longitude IS NOT NULL)"""

SQL_SHOWN = f"""{SQL_GOLD}, shown AS (
  SELECT * FROM gold ORDER BY timestamp_dt DESC NULLS LAST, ticket_id
  LIMIT {fixed.MAX_POINTS})"""

SQL_FINISHED = f"""{SQL_GOLD}, finished AS (
  SELECT resolution_days AS v FROM gold
  WHERE state = '{fixed.DONE_STATE}' AND resolution_days >= 0
    AND resolution_days < {fixed.RESOLUTION_LIMIT_DAYS})"""

SQL_COLOR = "CASE state " + " ".join(
    f"WHEN '{s}' THEN '{','.join(map(str, c))}'" for s, c in fixed.STATE_COLORS.items()
) + f" ELSE '{','.join(map(str, fixed.OTHER_STATE_COLOR))}' END"
