"""Dashboard queries: filters, options, caps, figures, map."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.geo import METRES_PER_DEGREE
from civicpulse.operators import density, filters, indicators, ranking
from civicpulse.plans.dashboard import dashboard
from civicpulse.plans.gold import gold_tickets
from civicpulse.schemas import SILVER_TICKET
from civicpulse.session import scratch_path
from civicpulse.sinks.files import write_silver
from civicpulse.sources.files import read_silver
from querybook.book import (
    SQL_COLOR,
    SQL_GOLD,
    SQL_SHOWN,
    SQL_TICKETS,
    query,
    six,
    sql_stamp,
    stamp,
)


@query(
    "top_districts",
    f"""WITH {SQL_GOLD}
    SELECT district, count(*) AS n FROM gold GROUP BY district ORDER BY n DESC, district LIMIT 10""",
)
def top_districts(t):
    return ranking.top_groups(t.gold(), "district")


@query(
    "top_types",
    f"""WITH {SQL_GOLD}
    SELECT token, count(*) AS n FROM (SELECT unnest(type_tokens) AS token FROM gold)
    GROUP BY token ORDER BY n DESC, token LIMIT 15""",
)
def top_types(t):
    return ranking.top_tokens(t.gold(), k=fixed.EXPLORE_TOP)


@query(
    "gold_tickets",
    f"""WITH {SQL_GOLD}
    SELECT ticket_id, type, state, district, organization, {sql_stamp("timestamp_dt")},
      {sql_stamp("last_activity_dt")}, count_reopen, round(latitude, 6) AS latitude,
      round(longitude, 6) AS longitude, array_to_string(type_tokens, '|') AS type_tokens,
      {SQL_COLOR} AS state_color, round(resolution_days, 6) AS resolution_days FROM gold""",
)
def gold(t):
    return six(t.gold()).withColumns(
        {
            "timestamp_dt": stamp("timestamp_dt"),
            "last_activity_dt": stamp("last_activity_dt"),
            "type_tokens": F.array_join("type_tokens", "|"),
            "state_color": F.array_join(F.col("state_color").cast("array<string>"), ","),
        }
    )


@query(
    "type_overlap_filter",
    f"""WITH {SQL_GOLD}
    SELECT ticket_id, type FROM gold WHERE list_has_any(type_tokens, ['click', 'k3', 'none'])""",
)
def type_overlap_filter(t):
    return filters.TicketFilter(types=["click", "k3", "none"]).apply(t.gold()).select(
        "ticket_id", "type"
    )


@query(
    "filter_options",
    f"""WITH {SQL_GOLD}
    SELECT DISTINCT * FROM (
      SELECT 'type' AS field, unnest(type_tokens) AS value FROM gold
      UNION ALL SELECT 'state', state FROM gold
      UNION ALL SELECT 'district', district FROM gold
      UNION ALL SELECT 'organization', organization FROM gold) ORDER BY field, value""",
)
def filter_options(t):
    return filters.filter_options(t.gold())


@query(
    "date_bounds",
    f"""WITH {SQL_GOLD}
    SELECT CAST(lo AS VARCHAR) AS min_date, CAST(hi AS VARCHAR) AS max_date,
      CAST(greatest(lo, hi - 180) AS VARCHAR) AS default_start
    FROM (SELECT CAST(min(timestamp_dt) AS DATE) AS lo, CAST(max(timestamp_dt) AS DATE) AS hi
      FROM gold)""",
)
def date_bounds(t):
    bounds = filters.date_bounds(t.gold())
    return bounds.select(*[F.col(c).cast("string").alias(c) for c in bounds.columns])


_STATES = list(fixed.STATE_COLORS)[:3] + [fixed.UNKNOWN_LABELS["state"]]
_DISTRICTS = [f"D{i}" for i in range(0, 50, 2)] + [fixed.UNKNOWN_LABELS["district"]]
_ORGS = ["Org1", "Org2", "Org5"]


def _sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


@query(
    "dashboard_filter",
    f"""WITH {SQL_GOLD}
    SELECT ticket_id, state, district, organization, {sql_stamp("timestamp_dt")} FROM gold
    WHERE state IN ({_sql_list(_STATES)}) AND district IN ({_sql_list(_DISTRICTS)})
      AND organization IN ({_sql_list(_ORGS)})
      AND CAST(timestamp_dt AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def dashboard_filter(t):
    chosen = filters.TicketFilter(
        states=_STATES,
        districts=_DISTRICTS,
        organizations=_ORGS,
        first_day=dt.date(2024, 1, 5),
        last_day=dt.date(2024, 1, 20),
    )
    return chosen.apply(t.gold()).select(
        "ticket_id", "state", "district", "organization", stamp("timestamp_dt")
    )


def _shown(t):
    return ranking.newest_n(t.gold())


@query(
    "newest_n_silver",
    f"""WITH {SQL_TICKETS}
    SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, state,
      {sql_stamp("last_activity_dt")} FROM tickets
    ORDER BY last_activity_dt DESC NULLS LAST, CAST(ticket_id AS VARCHAR) LIMIT {fixed.MAX_POINTS}""",
)
def newest_n_silver(t):
    """Written by month of one date, ranked by the other: no folder may be skipped."""
    path = scratch_path(t.spark, "silver")
    write_silver(t.tickets().withColumn("ticket_id", F.col("ticket_id").cast("string")), path)
    silver = t.spark.read.parquet(path)
    return ranking.newest_n(silver, ts="last_activity_dt").select(
        "ticket_id", "state", stamp("last_activity_dt")
    )


@query(
    "silver_by_month",
    f"""WITH {SQL_TICKETS}
    SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, state, {sql_stamp("timestamp_dt")} FROM tickets
    WHERE CAST(timestamp_dt AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'
      AND latitude IS NOT NULL""",
)
def silver_by_month(t):
    """Silver written, read again with its schema, and filtered by date."""
    path = scratch_path(t.spark, "silver")
    tickets = t.tickets().withColumn("ticket_id", F.col("ticket_id").cast("string"))
    absent = {f.name: F.lit(None).cast(f.dataType) for f in SILVER_TICKET.fields if f.name not in tickets.columns}
    write_silver(tickets.withColumns(absent).select(*SILVER_TICKET.fieldNames()), path)
    chosen = filters.TicketFilter(first_day=dt.date(2024, 1, 10), last_day=dt.date(2024, 1, 12))
    silver = chosen.raw(read_silver(t.spark, path))
    return filters.drop_unlocated(silver).select("ticket_id", "state", stamp("timestamp_dt"))


@query(
    "kpi_captions",
    f"""WITH {SQL_GOLD}, k AS (
      SELECT district, count(*) AS n,
        100e0 * count(*) FILTER (state = '{fixed.DONE_STATE}') / count(*) AS r,
        avg(count_reopen) AS o, avg(event_id % 64) / 8e0 AS d
      FROM (SELECT gold.*, ticket_id AS event_id FROM gold) GROUP BY district)
    SELECT district, format('{{:,}}', n) AS tickets, format('{{:.1f}}', r) || '%' AS resolution_rate,
      format('{{:.2f}}', o) AS avg_reopen, format('{{:.1f}}', d) AS avg_resolution_days FROM k
    UNION ALL SELECT 'tie ' || v, '1,234', format('{{:.1f}}', v) || '%', format('{{:.2f}}', v), format('{{:.1f}}', v)
    FROM (SELECT CAST(unnest([6.25e0, 0.125e0, 2.25e0, 2.675e0, 0.05e0, 12.345e0, 99.95e0]) AS DOUBLE) AS v)""",
)
def kpi_captions(t):
    """Figures of every district, and ties."""
    figures = t.gold().groupBy("district").agg(
        F.count("*").alias("tickets"),
        (F.lit(100e0) * F.count_if(F.col("state") == fixed.DONE_STATE) / F.count("*")).alias("resolution_rate"),
        F.avg("count_reopen").alias("avg_reopen"),
        (F.avg(F.col("ticket_id") % 64) / F.lit(8e0)).alias("avg_resolution_days"),
    )
    ties = [6.25, 0.125, 2.25, 2.675, 0.05, 12.345, 99.95]
    tied = t.spark.createDataFrame(
        [(f"tie {v}", 1234, v, v, v) for v in ties],
        "district string, tickets bigint, resolution_rate double, avg_reopen double, avg_resolution_days double",
    )
    return indicators.kpi_captions(figures.unionByName(tied), "district")


SQL_CHOSEN = f"""{SQL_GOLD}, chosen AS (SELECT * FROM gold WHERE state IN ({_sql_list(_STATES)})
    AND CAST(timestamp_dt AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'),
  shown AS (SELECT * FROM chosen ORDER BY timestamp_dt DESC NULLS LAST, ticket_id
    LIMIT {fixed.MAX_POINTS})"""


def _dashboard(t, name):
    """One figure of a dashboard request: filtered, then capped to the newest rows."""
    chosen = filters.TicketFilter(
        states=_STATES, first_day=dt.date(2024, 1, 3), last_day=dt.date(2024, 1, 28)
    )
    return dashboard(gold_tickets(t.tickets(), chosen=chosen), chosen)[name]


@query(
    "dashboard_top_types",
    f"""WITH {SQL_CHOSEN} SELECT token, count(*) AS n FROM
    (SELECT unnest(type_tokens) AS token FROM shown) GROUP BY token ORDER BY n DESC, token LIMIT 10""",
)
def dashboard_top_types(t):
    return _dashboard(t, "top_types")


@query(
    "dashboard_top_districts",
    f"""WITH {SQL_CHOSEN} SELECT district, count(*) AS n FROM shown GROUP BY district
    ORDER BY n DESC, district LIMIT 10""",
)
def dashboard_top_districts(t):
    return _dashboard(t, "top_districts")


@query(
    "dashboard_daily",
    f"""WITH {SQL_CHOSEN}, days AS (SELECT CAST(timestamp_dt AS DATE) AS day, count(*) AS n FROM shown GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS day, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM (SELECT unnest(generate_series((SELECT min(day) FROM days), (SELECT max(day) FROM days),
      INTERVAL 1 DAY)) AS d) LEFT JOIN days ON days.day = CAST(d AS DATE)""",
)
def dashboard_daily(t):
    return _dashboard(t, "daily").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query(
    "dashboard_listing",
    f"""WITH {SQL_CHOSEN} SELECT ticket_id, type, organization, district, state,
      {sql_stamp("timestamp_dt")} FROM shown""",
)
def dashboard_listing(t):
    return _dashboard(t, "listing").withColumn("timestamp_dt", stamp("timestamp_dt"))


@query(
    "dashboard_total",
    f"WITH {SQL_CHOSEN} SELECT count(*) AS total_filtered FROM chosen",
)
def dashboard_total(t):
    return _dashboard(t, "total_filtered")


@query(
    "default_types",
    f"""WITH {SQL_GOLD} SELECT DISTINCT token AS value FROM (SELECT unnest(type_tokens) AS token FROM gold)
    ORDER BY value LIMIT {fixed.DEFAULT_TYPE_CHOICES}""",
)
def default_types(t):
    return filters.default_types(t.gold())


@query(
    "preview",
    "SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 5)",
)
def preview(t):
    """L3: which rows come first is not fixed, how many are shown is."""
    return ranking.preview(t.events).agg(F.count("*").alias("n"))


@query(
    "newest_n",
    f"WITH {SQL_SHOWN} SELECT ticket_id, {sql_stamp('timestamp_dt')}, state FROM shown",
)
def newest_n(t):
    return _shown(t).select("ticket_id", stamp("timestamp_dt"), "state")


@query(
    "ticket_listing",
    f"""WITH {SQL_GOLD}
    SELECT ticket_id, type, organization, district, state, {sql_stamp("timestamp_dt")} FROM gold""",
)
def ticket_listing(t):
    return ranking.ticket_listing(t.gold()).withColumn("timestamp_dt", stamp("timestamp_dt"))


@query(
    "kpi_summary",
    f"""WITH {SQL_SHOWN}
    SELECT count(*) AS tickets,
      round(coalesce(100e0 * count(*) FILTER (state = '{fixed.DONE_STATE}') / nullif(count(*), 0), 0), 6)
        AS resolution_rate,
      round(coalesce(avg(count_reopen), 0), 6) AS avg_reopen,
      round(avg(resolution_days), 6) AS avg_resolution_days FROM shown""",
)
def kpi_summary(t):
    return six(indicators.kpi_summary(_shown(t)))


@query(
    "map_center",
    f"""WITH {SQL_SHOWN}
    SELECT round(coalesce(avg(latitude), 13.7563), 6) AS latitude,
      round(coalesce(avg(longitude), 100.5018), 6) AS longitude, 10 AS zoom FROM shown""",
)
def map_center(t):
    return six(indicators.map_center(_shown(t)))


@query(
    "map_points",
    f"""WITH {SQL_SHOWN}
    SELECT round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
      {SQL_COLOR} AS state_color, ticket_id, type, state, organization, district FROM shown""",
)
def map_points(t):
    return six(indicators.map_points(_shown(t))).withColumn(
        "state_color", F.array_join(F.col("state_color").cast("array<string>"), ",")
    )


@query(
    "state_color",
    f"WITH {SQL_TICKETS} SELECT ticket_id, {SQL_COLOR} AS state_color FROM tickets",
)
def state_color(t):
    from civicpulse.functions.parse import state_color as color

    return t.tickets().select(
        "ticket_id",
        F.array_join(color("state").cast("array<string>"), ",").alias("state_color"),
    )


_LAT0, _LON0 = fixed.DEFAULT_CENTER
_EAST = f"((longitude - {_LON0!r}) * {METRES_PER_DEGREE * math.cos(math.radians(_LAT0))!r}::DOUBLE)"
_NORTH = f"((latitude - {_LAT0!r}) * {METRES_PER_DEGREE!r}::DOUBLE)"


@query(
    "hex_density",
    f"""WITH {SQL_TICKETS}, f AS (
      SELECT ({math.sqrt(3) / 3!r}::DOUBLE * {_EAST} - {_NORTH} / 3e0) / 200e0 AS fq,
        {2.0 / 3.0!r}::DOUBLE * {_NORTH} / 200e0 AS fr
      FROM tickets WHERE latitude IS NOT NULL),
    g AS (SELECT fq, fr, -fq - fr AS fs, floor(fq + 0.5e0) AS q, floor(fr + 0.5e0) AS r,
        floor(-fq - fr + 0.5e0) AS s FROM f),
    h AS (SELECT q, r, s, abs(q - fq) AS dq, abs(r - fr) AS dr, abs(s - fs) AS ds FROM g),
    cells AS (SELECT
        CAST(CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END AS BIGINT) AS q,
        CAST(CASE WHEN dq > dr AND dq > ds THEN r WHEN dr > ds THEN -q - s ELSE r END AS BIGINT) AS r
      FROM h),
    c AS (SELECT q, r, count(*) AS n FROM cells GROUP BY q, r),
    m AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
    SELECT q, r, round({200.0 * math.sqrt(3)!r}::DOUBLE * (q + r / 2e0), 6) AS east_m,
      round(300e0 * r, 6) AS north_m, n,
      round(CASE WHEN hi = lo THEN 0e0 ELSE (n - lo)::DOUBLE / (hi - lo) END * 1000e0 * 2e0, 6)
        AS elevation
    FROM c, m""",
)
def hex_density(t):
    return six(density.hex_density(t.tickets()))


@query(
    "grid_density",
    f"""WITH {SQL_TICKETS}
    SELECT CAST(floor({_EAST} / 500e0) AS BIGINT) AS x, CAST(floor({_NORTH} / 500e0) AS BIGINT) AS y,
      count(*)::DOUBLE AS weight FROM tickets WHERE latitude IS NOT NULL GROUP BY ALL""",
)
def grid_density(t):
    return six(density.grid_density(t.tickets()))


_HEAT_CELL = density.pixel_metres(fixed.DEFAULT_ZOOM, _LAT0) * fixed.HEAT_RADIUS_PIXELS / 4


@query(
    "heat_surface",
    f"""WITH {SQL_TICKETS}, cell AS (
      SELECT CAST(floor({_EAST} / {_HEAT_CELL!r}::DOUBLE) AS BIGINT) AS x,
        CAST(floor({_NORTH} / {_HEAT_CELL!r}::DOUBLE) AS BIGINT) AS y, count(*)::DOUBLE AS w
      FROM tickets WHERE latitude IS NOT NULL GROUP BY ALL),
    raw AS (SELECT i, exp(-4.5 * pow(i / 4e0, 2)) AS k FROM range(-4, 5) AS r(i)),
    kernel AS (SELECT i, k / (SELECT sum(k) FROM raw) AS k FROM raw)
    SELECT x + a.i AS x, y + b.i AS y, round(sum(w * a.k * b.k), 6) AS heat
    FROM cell, kernel a, kernel b GROUP BY 1, 2""",
)
def heat_surface(t):
    return six(density.heat_surface(t.tickets(), cells_per_radius=4))


@query(
    "quality_checks",
    f"""WITH {SQL_TICKETS} SELECT count(*) AS n_rows,
      count(*) FILTER (latitude IS NULL) AS null_latitude,
      count(*) FILTER (longitude IS NULL) AS null_longitude FROM tickets""",
)
def quality_checks(t):
    return indicators.quality_checks(t.tickets())


_PROFILED = [
    ("ticket_id", "bigint"),
    ("type", "string"),
    ("state", "string"),
    ("district", "string"),
    ("organization", "string"),
    ("timestamp_dt", "timestamp"),
    ("last_activity_dt", "timestamp"),
    ("count_reopen", "string"),
    ("latitude", "double"),
    ("longitude", "double"),
]


@query(
    "null_profile",
    f"WITH {SQL_TICKETS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{d}' AS dtype, count({c}) AS non_null, "
        f"count(*) - count({c}) AS nulls FROM tickets"
        for c, d in _PROFILED
    ),
)
def null_profile(t):
    return indicators.null_profile(t.tickets())
