"""Chart queries: series, distributions, air quality, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.parse import days_between, pm25_band
from civicpulse.operators import distribution, geography, payloads, timeseries
from querybook.book import SQL_FINISHED, SQL_GOLD, SQL_TICKETS, query, six


def _dated(df, column="day"):
    return six(df).withColumn(column, F.col(column).cast("string"))


@query(
    "daily_counts",
    f"""WITH {SQL_GOLD}, c AS (SELECT CAST(timestamp_dt AS DATE) AS day, count(*) AS n FROM gold
      WHERE timestamp_dt IS NOT NULL GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
      FROM (SELECT CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi FROM c))
    SELECT CAST(s.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (day)""",
)
def daily_counts(t):
    return _dated(timeseries.daily_counts(t.gold()))


@query(
    "rolling_7d",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
    s AS (SELECT user_id,
        CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
      FROM (SELECT user_id, CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi
        FROM c GROUP BY user_id)),
    d AS (SELECT user_id, day, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (user_id, day))
    SELECT user_id, CAST(day AS VARCHAR) AS day, n,
      CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS rolling_mean
    FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_7d(t):
    daily = timeseries.daily_counts(t.events, "ts", ["user_id"])
    return _dated(timeseries.rolling_mean(daily, keys=["user_id"]))


@query(
    "weekday_hour_heatmap",
    f"""WITH {SQL_GOLD}, w AS (SELECT * FROM (VALUES """
    + ", ".join(f"({i}, '{d}')" for i, d in enumerate(fixed.WEEKDAYS, 1))
    + """) AS x(day_no, day_of_week))
    SELECT day_no, day_of_week, """
    + ", ".join(
        f"nullif(count(ticket_id) FILTER (hour(timestamp_dt) = {h}), 0) AS h{h:02d}"
        for h in range(24)
    )
    + """ FROM w LEFT JOIN gold ON dayname(timestamp_dt) = day_of_week
    GROUP BY day_no, day_of_week""",
)
def weekday_hour_heatmap(t):
    return timeseries.weekday_hour_heatmap(t.gold())


@query(
    "resolution_days",
    f"""WITH {SQL_TICKETS} SELECT ticket_id,
      round((epoch_us(last_activity_dt) - epoch_us(timestamp_dt)) / 86400e6, 6) AS resolution_days
    FROM tickets""",
)
def resolution_days(t):
    days = days_between("timestamp_dt", "last_activity_dt")
    return six(t.tickets().select("ticket_id", days.alias("resolution_days")))


def _durations(t):
    return distribution.value_counts(distribution.finished_within(t.gold()), "resolution_days")


@query(
    "resolution_median",
    f"WITH {SQL_FINISHED} SELECT round(median(v), 6) AS median FROM finished",
)
def resolution_median(t):
    return six(distribution.exact_median(_durations(t)))


@query(
    "resolution_histogram",
    f"""WITH {SQL_FINISHED},
    b AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
        CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM finished),
    p AS (SELECT v, lo, (hi - lo) / 30e0 AS w,
        least(floor((v - lo) / ((hi - lo) / 30e0)), 29) AS g FROM finished, b),
    c AS (SELECT CAST(g + CASE WHEN v < lo + g * w THEN -1
          WHEN v >= lo + (g + 1) * w AND g < 29 THEN 1 ELSE 0 END AS INTEGER) AS bin,
        count(*) AS n FROM p GROUP BY 1),
    s AS (SELECT CAST(unnest(range(30)) AS INTEGER) AS bin)
    SELECT bin, round(lo + bin * ((hi - lo) / 30e0), 6) AS left_edge,
      round(lo + (bin + 1) * ((hi - lo) / 30e0), 6) AS right_edge, coalesce(n, 0) AS n
    FROM s LEFT JOIN c USING (bin), b""",
)
def resolution_histogram(t):
    return six(distribution.histogram(_durations(t)))


@query(
    "resolution_kde",
    f"""WITH {SQL_FINISHED},
    m AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n,
        stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS h FROM finished),
    g AS (SELECT CAST(unnest(range(200)) AS INTEGER) AS point)
    SELECT point, round(any_value(lo + point * ((hi - lo) / 199e0)), 6) AS x,
      round(sum(exp(-0.5 * pow((lo + point * ((hi - lo) / 199e0) - v) / h, 2)))
        * any_value((hi - lo) / 30e0) / (any_value(h) * sqrt(2 * pi())), 6) AS y
    FROM finished, m, g GROUP BY point""",
)
def resolution_kde(t):
    return six(distribution.density_curve(_durations(t)))


@query(
    "resolution_kde_binned",
    f"""WITH {SQL_FINISHED},
    m AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n,
        stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS h FROM finished),
    p AS (SELECT (v - lo) / ((hi - lo) / 4096e0) AS place,
        least(floor((v - lo) / ((hi - lo) / 4096e0)), 4095) AS cell FROM finished, m),
    c AS (SELECT cell, sum(mass) AS mass FROM (
        SELECT cell, cell + 1 - place AS mass FROM p UNION ALL SELECT cell + 1, place - cell FROM p)
      GROUP BY cell),
    g AS (SELECT CAST(unnest(range(200)) AS INTEGER) AS point)
    SELECT point, round(any_value(lo + point * ((hi - lo) / 199e0)), 6) AS x,
      round(sum(mass * exp(-0.5 * pow((point * ((hi - lo) / 199e0) - cell * ((hi - lo) / 4096e0)) / h, 2)))
        * any_value((hi - lo) / 30e0) / (any_value(h) * sqrt(2 * pi())), 6) AS y
    FROM c, m, g GROUP BY point""",
)
def resolution_kde_binned(t):
    return six(distribution.binned_density_curve(_durations(t), cells=4096))


@query(
    "payload_daily_mean",
    """WITH hours AS (
      SELECT 'D' || CAST(user_id % 25 AS VARCHAR) AS district, ts + to_hours(o) AS ts,
        CASE WHEN o = 0 THEN value / 7e0 WHEN o = 7 AND event_id % 3 <> 0 THEN value / 3e0 END AS v
      FROM events, (VALUES (0), (7), (30)) AS x(o) WHERE event_id % 10 <> 0),
    daily AS (SELECT district, strftime(ts, '%Y-%m-%d') AS date, avg(v) AS m
      FROM hours GROUP BY ALL HAVING avg(v) IS NOT NULL)
    SELECT district, date, round(m, 6) AS avg_pm25_ug_m3,
      round(13e0 + n_nationkey / 1e2, 6) AS latitude,
      round(100e0 + n_nationkey / 1e2, 6) AS longitude
    FROM daily JOIN nation ON district = 'D' || CAST(n_nationkey AS VARCHAR)""",
)
def payload_daily_mean(t):
    # Every event is one response: three hours, some values missing, and every
    # tenth response with arrays of different length.
    ts, value, i = F.col("ts").cast("timestamp"), F.col("value"), F.col("event_id")
    hours = [F.date_format(ts + F.expr(f"interval {h} hours"), "yyyy-MM-dd'T'HH:mm") for h in (0, 7, 30)]
    nothing = F.lit(None).cast("double")
    values = [value / F.lit(7e0), F.when(i % 3 != 0, value / F.lit(3e0)), nothing]
    responses = t.events.select(
        F.concat(F.lit("D"), (F.col("user_id") % 25).cast("string")).alias("name"),
        F.struct(
            F.array(*hours).alias("time"),
            F.when(i % 10 == 0, F.array(value)).otherwise(F.array(*values)).alias("pm2_5"),
        ).alias("hourly"),
    )
    key = F.col("n_nationkey")
    places = t.nation.select(
        F.concat(F.lit("D"), key.cast("string")).alias("name"),
        (F.lit(13e0) + key / F.lit(1e2)).alias("lat"),
        (F.lit(100e0) + key / F.lit(1e2)).alias("lon"),
    )
    return six(payloads.air_messages(geography.attach_locations(responses, places)))


@query(
    "pm25_band",
    """WITH d AS (SELECT 'D' || CAST(user_id % 50 AS VARCHAR) AS district,
        CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
        avg(CASE WHEN event_id % 4 <> 0 THEN value * 22 / 7e0 END) AS m FROM events GROUP BY ALL)
    SELECT district, date, round(m, 6) AS avg_pm25_ug_m3,
      CASE WHEN m <= 25 THEN 'Very Good' WHEN m <= 37 THEN 'Good' WHEN m <= 50 THEN 'Moderate'
        WHEN m <= 90 THEN 'Unhealthy for Sensitive' ELSE 'Unhealthy' END AS pm25_category
    FROM d""",
)
def pm25(t):
    days = t.events.groupBy(
        F.concat(F.lit("D"), (F.col("user_id") % 50).cast("string")).alias("district"),
        F.to_date("ts").cast("string").alias("date"),
    ).agg(F.avg(F.when(F.col("event_id") % 4 != 0, F.col("value") * 22 / F.lit(7e0))).alias("avg_pm25_ug_m3"))
    return six(days.withColumn("pm25_category", pm25_band("avg_pm25_ug_m3")))


@query(
    "district_day_corr",
    f"""WITH {SQL_TICKETS},
    c AS (SELECT district, CAST(timestamp_dt AS DATE) AS date, count(*) AS n FROM tickets GROUP BY ALL),
    a AS (SELECT 'D' || CAST(user_id % 50 AS VARCHAR) AS district, CAST(ts AS DATE) AS date,
        avg(value) AS m FROM events GROUP BY ALL)
    SELECT district, count(*) AS days, round(corr(n, m), 6) AS correlation
    FROM c JOIN a USING (district, date) GROUP BY district""",
)
def district_day_corr(t):
    air = timeseries.daily_mean(
        t.events.withColumn(
            "district", F.concat(F.lit("D"), (F.col("user_id") % 50).cast("string"))
        ),
        "ts",
        "value",
        ["district"],
    )
    table = timeseries.district_day_table(t.tickets(), air)
    return six(timeseries.district_day_correlation(table))
