"""Queries that land data as files first and read it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicpulse.ml import labels
from civicpulse.operators import geography, payloads, timeseries
from civicpulse.session import scratch_path
from civicpulse.sinks.files import export_single_csv, write_csv_parts
from civicpulse.sources.files import read_geography, read_payloads, read_seed, read_silver
from querybook.book import SQL_GOLD, query, six


@query(
    "single_csv_export",
    """SELECT doc_id, lang, length(text) AS n_chars, md5(text) AS digest FROM documents""",
)
def single_csv_export(t):
    """K5, K6: exported as a file per task (one file for all would be written by one), read back with every character."""
    path = scratch_path(t.spark, "export")
    write_csv_parts(t.documents.select("doc_id", "lang", "text").hint("rebalance"), path)
    back = t.spark.read.schema("doc_id bigint, lang string, text string").csv(
        path, header=True, quote='"', escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return back.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "seed_csv",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events",
)
def seed_csv(t):
    """S3: every column as text, numbered in file order."""
    path = f"{scratch_path(t.spark, 'seed')}.csv"
    columns = ["event_id", "event_type", "props"]
    export_single_csv(t.events.select(*columns), path)
    seed = read_seed(t.spark, path, columns)
    return seed.dropDuplicates(["seq"]).select(*columns)


@query(
    "missing_files",
    "SELECT count(*) AS tickets, 0::BIGINT AS places, 0::BIGINT AS silver FROM events",
)
def missing_files(t):
    """A missing path is an empty frame of its schema, not a failure."""
    gone = scratch_path(t.spark, "gone")
    n = F.count("*")
    places = read_geography(t.spark, f"{gone}.csv").agg(n.alias("places"))
    silver = read_silver(t.spark, gone).agg(n.alias("silver"))
    return t.events.agg(n.alias("tickets")).crossJoin(places).crossJoin(silver)


@query(
    "payload_files",
    """WITH hours AS (
      SELECT user_id % 25 AS k, event_id, ts + to_hours(o) AS ts,
        CASE WHEN o = 0 THEN value / 7e0 WHEN event_id % 3 <> 0 THEN value / 3e0 END AS v
      FROM events, (VALUES (0), (7)) AS x(o)),
    place AS (SELECT n_nationkey AS k, n_nationkey // 2 AS name FROM nation WHERE n_nationkey % 5 <> 0),
    daily AS (SELECT k, strftime(ts, '%Y-%m-%d') AS date, avg(v) AS m FROM hours GROUP BY ALL HAVING avg(v) IS NOT NULL)
    SELECT 'P' || CAST(name AS VARCHAR) AS district, date, round(m, 6) AS avg_pm25_ug_m3,
      round(13e0 + k / 1e2, 6) AS latitude, round(100e0 + k / 1e2, 6) AS longitude
    FROM daily JOIN place USING (k)""",
)
def payload_files(t):
    """Responses landed as JSON, read with their schema, matched to homonymous places."""
    key = F.col("n_nationkey")
    # Two places share each name; every fifth is outside the province.
    places = t.nation.select(
        F.when(key % 5 != 0, "Bangkok").otherwise("Other").alias("province"),
        F.concat(F.lit("P"), F.floor(key / 2).cast("string")).alias("district"),
        (F.lit(13e0) + key / F.lit(1e2)).alias("latitude"),
        (F.lit(100e0) + key / F.lit(1e2)).alias("longitude"),
    )
    ts, value, i = F.col("ts").cast("timestamp"), F.col("value"), F.col("event_id")
    user = F.col("user_id") % 25
    hours = [F.date_format(ts + F.expr(f"interval {h} hours"), "yyyy-MM-dd'T'HH:mm") for h in (0, 7)]
    path = scratch_path(t.spark, "payloads")
    t.events.select(
        F.concat(F.lit("P"), F.floor(user / 2).cast("string")).alias("district"),
        (F.lit(13e0) + user / F.lit(1e2)).alias("latitude"),
        (F.lit(100e0) + user / F.lit(1e2)).alias("longitude"),
        F.struct(
            F.array(*hours).alias("time"),
            F.array(value / F.lit(7e0), F.when(i % 3 != 0, value / F.lit(3e0))).alias("pm2_5"),
        ).alias("hourly"),
    ).write.option("ignoreNullFields", "false").json(path)
    landed = read_payloads(t.spark, path, one_per_file=False)
    located = geography.attach_locations(
        landed.withColumnsRenamed({"district": "name", "latitude": "lat", "longitude": "lon"}),
        geography.target_locations(places),
    )
    return six(payloads.air_messages(located))


@query(
    "rolling_7d_all",
    f"""WITH {SQL_GOLD}, days AS (SELECT CAST(timestamp_dt AS DATE) AS day, count(*) AS n FROM gold
      WHERE timestamp_dt IS NOT NULL GROUP BY 1),
    filled AS (SELECT CAST(d AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(
      (SELECT min(day) FROM days), (SELECT max(day) FROM days), INTERVAL 1 DAY)) AS d)
      LEFT JOIN days ON days.day = CAST(d AS DATE))
    SELECT strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n, round(CASE WHEN count(*) OVER w = 7
      THEN avg(n) OVER w END, 6) AS rolling_mean FROM filled
    WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_7d_all(t):
    """W1 over all tickets, without a key."""
    series = timeseries.rolling_mean(timeseries.daily_counts(t.gold()))
    return six(series.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "rolling_mean"))


@query(
    "text_and_labels",
    """SELECT d.doc_id, md5(text) AS digest, quality + toxic AS n_labels FROM documents d JOIN labels USING (doc_id)
    WHERE quality + toxic > 0""",
)
def text_and_labels(t):
    """P5: the two columns a model is trained on."""
    flags = F.concat_ws(", ", F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    tickets = t.documents.join(t.labels, "doc_id").withColumn("type", F.concat(F.lit("{"), flags, F.lit("}")))
    rows = labels.labelled(tickets.select("doc_id", "text", "type"), "text")
    return rows.select("doc_id", F.md5("text").alias("digest"), F.size("labels").alias("n_labels"))
