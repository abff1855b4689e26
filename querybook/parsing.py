"""Parsing, cleaning, geography and silver queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicpulse import schemas
from civicpulse.functions import parse
from civicpulse.operators import geography
from civicpulse.plans.silver import silver_tickets as to_silver
from civicpulse.session import scratch_path, via_table
from civicpulse.sinks.files import as_messages, write_csv_parts
from civicpulse.sources.files import read_csv
from querybook.book import SQL_TICKETS, query, six, sql_stamp, sql_tokens, stamp


@query(
    "type_tokens",
    f"""WITH {SQL_TICKETS} SELECT ticket_id,
      coalesce(array_to_string({sql_tokens("type")}, '|'), '') AS tokens,
      coalesce(array_to_string({sql_tokens("type")}, '|'), 'nan') AS tokens_nan,
      coalesce(array_to_string({sql_tokens("' ' || type", "{}")}, '|'), '') AS label_tokens
    FROM tickets""",
)
def type_tokens(t):
    padded = F.concat(F.lit(" "), "type")
    return t.tickets().select(
        "ticket_id",
        F.array_join(parse.parse_set("type"), "|").alias("tokens"),
        F.array_join(parse.parse_set("type", null_token="nan"), "|").alias("tokens_nan"),
        F.array_join(parse.parse_set(padded, "{}"), "|").alias("label_tokens"),
    )


@query(
    "coords_parse",
    """WITH c AS (SELECT event_id, CASE event_id % 8
        WHEN 0 THEN '[' || lon || ', ' || lat || ']' WHEN 1 THEN lon || ',' || lat
        WHEN 2 THEN lon WHEN 3 THEN 'x,y' WHEN 4 THEN '' WHEN 5 THEN NULL
        WHEN 6 THEN ' ' || lon || ' , nan' ELSE 'abc, ' || lat END AS coords
      FROM (SELECT event_id, CAST(90 + event_id % 20 AS VARCHAR) || '.25' AS lon,
          CAST(5 + event_id % 15 AS VARCHAR) || '.5' AS lat FROM events)),
    p AS (SELECT event_id, string_split(regexp_replace(coords, '[\\[\\]]', '', 'g'), ',') AS s FROM c),
    d AS (SELECT event_id, TRY_CAST(trim(s[1]) AS DOUBLE) AS lon, TRY_CAST(trim(s[2]) AS DOUBLE) AS lat
      FROM p)
    SELECT event_id, CASE WHEN NOT isnan(lon) THEN lon END AS longitude,
      CASE WHEN NOT isnan(lat) THEN lat END AS latitude FROM d""",
)
def coords_parse(t):
    i = F.col("event_id")
    lon = F.concat((90 + i % 20).cast("string"), F.lit(".25"))
    lat = F.concat((5 + i % 15).cast("string"), F.lit(".5"))
    case = i % 8
    coords = (
        F.when(case == 0, F.concat(F.lit("["), lon, F.lit(", "), lat, F.lit("]")))
        .when(case == 1, F.concat(lon, F.lit(","), lat))
        .when(case == 2, lon)
        .when(case == 3, "x,y")
        .when(case == 4, "")
        .when(case == 6, F.concat(F.lit(" "), lon, F.lit(" , nan")))
        .when(case == 7, F.concat(F.lit("abc, "), lat))
    )
    return t.events.select("event_id", parse.parse_coords(coords).alias("p")).select(
        "event_id", "p.longitude", "p.latitude"
    )


@query(
    "ts_parse",
    """WITH x AS (SELECT event_id, CASE event_id % 4
        WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+00'
        WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'bad' END AS ticket,
      CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M')
        WHEN 1 THEN 'n/a ' || strftime(ts, '%Y') END AS iso FROM events)
    SELECT event_id, strftime(try_strptime(substr(ticket, 1, 19), '%Y-%m-%d %H:%M:%S'),
        '%Y-%m-%d %H:%M:%S.%f') AS ticket_ts,
      strftime(try_strptime(iso, '%Y-%m-%dT%H:%M'), '%Y-%m-%d %H:%M:%S.%f') AS iso_ts FROM x""",
)
def ts_parse(t):
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    ticket = (
        F.when(
            i % 4 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))
        )
        .when(i % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(i % 4 == 2, "bad")
    )
    iso = F.when(i % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).when(
        i % 3 == 1, F.concat(F.lit("n/a "), F.date_format(ts, "yyyy"))
    )
    return t.events.select(
        "event_id",
        parse.parse_ticket_timestamp(ticket).alias("ticket_ts"),
        parse.lenient_timestamp(iso).alias("iso_ts"),
    ).withColumns({"ticket_ts": stamp("ticket_ts"), "iso_ts": stamp("iso_ts")})


@query(
    "lenient_int",
    """WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id % 5 AS VARCHAR)
        WHEN 1 THEN CAST(event_id % 5 AS VARCHAR) || '.0' WHEN 2 THEN '4.7' WHEN 3 THEN ''
        WHEN 4 THEN 'x' END AS star FROM events)
    SELECT event_id, TRY_CAST(trunc(TRY_CAST(star AS DOUBLE)) AS INTEGER) AS star,
      coalesce(TRY_CAST(trunc(TRY_CAST(star AS DOUBLE)) AS INTEGER), 0) AS count_reopen FROM x""",
)
def lenient_int(t):
    i = F.col("event_id")
    digit = (i % 5).cast("string")
    star = (
        F.when(i % 6 == 0, digit)
        .when(i % 6 == 1, F.concat(digit, F.lit(".0")))
        .when(i % 6 == 2, "4.7")
        .when(i % 6 == 3, "")
        .when(i % 6 == 4, "x")
    )
    return t.events.select(
        "event_id",
        parse.lenient_int(star).alias("star"),
        parse.reopen_count(star).alias("count_reopen"),
    )


_SQL_CLEAN = (
    "trim(regexp_replace(regexp_replace({0}, '[\\n\\r\\t]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query(
    "text_clean",
    f"""WITH c AS (SELECT doc_id, {_SQL_CLEAN.format("text")} AS cleaned FROM documents)
    SELECT doc_id, length(cleaned) AS n_chars, md5(cleaned) AS digest FROM c""",
)
def text_clean(t):
    cleaned = t.documents.select("doc_id", parse.clean_text("text").alias("cleaned"))
    return cleaned.select(
        "doc_id",
        F.length("cleaned").cast("bigint").alias("n_chars"),
        F.md5("cleaned").alias("digest"),
    )


@query(
    "regex_filter",
    """SELECT doc_id, lang FROM documents
    WHERE coalesce(regexp_matches(nullif(text, ''), '(?i)ÉAU|ing the'), false)""",
)
def regex_filter(t):
    return t.documents.filter(parse.matches(F.nullif("text", F.lit("")), "ÉAU|ing the")).select(
        "doc_id", "lang"
    )


@query(
    "geo_dedup",
    """WITH g AS (SELECT n_name AS province,
        ' ' || c_mktsegment || '-' || CAST(c_custkey % 40 AS VARCHAR)
          || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END AS district,
        c_acctbal / 1e3 AS latitude, c_acctbal / 1e2 AS longitude
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
    k AS (SELECT trim(district) AS geo_district, arg_min((latitude, longitude),
        (province, latitude, longitude)) AS p FROM g GROUP BY 1)
    SELECT geo_district, round(p[1], 6) AS geo_lat, round(p[2], 6) AS geo_long FROM k""",
)
def geo_dedup(t):
    key = F.col("c_custkey")
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("province"),
        F.concat(
            F.lit(" "),
            "c_mktsegment",
            F.lit("-"),
            (key % 40).cast("string"),
            F.when(key % 2 == 0, " ").otherwise(""),
        ).alias("district"),
        (F.col("c_acctbal") / F.lit(1e3)).alias("latitude"),
        (F.col("c_acctbal") / F.lit(1e2)).alias("longitude"),
    )
    return six(geography.dedup_geography(places))


@query(
    "geo_impute",
    f"""WITH {SQL_TICKETS},
    g AS (SELECT district, avg(latitude) AS glat, avg(longitude) AS glon FROM tickets
      WHERE district IS NOT NULL GROUP BY district)
    SELECT ticket_id, t.district, round(coalesce(latitude, glat), 6) AS latitude,
      round(coalesce(CASE WHEN ticket_id % 31 <> 0 THEN longitude END, glon), 6) AS longitude
    FROM tickets t LEFT JOIN g ON trim(t.district) = g.district""",
)
def geo_impute(t):
    tickets = t.tickets()
    # One centroid per district, computed from the located tickets.
    centroids = (
        tickets.filter(F.col("district").isNotNull())
        .groupBy("district")
        .agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
        .withColumn("province", F.lit(None).cast("string"))
    )
    raw = tickets.select(
        "ticket_id",
        "district",
        F.col("latitude").alias("raw_lat"),
        F.when(F.col("ticket_id") % 31 != 0, F.col("longitude")).alias("raw_long"),
    )
    # Derived from the tickets themselves: written once, then measured and joined.
    places = via_table(geography.dedup_geography(centroids), "places")
    filled = geography.impute_coordinates(raw, places, F.col("raw_lat"), F.col("raw_long"))
    return six(filled.select("ticket_id", "district", "latitude", "longitude"))


@query(
    "silver_tickets",
    f"""WITH {SQL_TICKETS}, g AS (SELECT 'D' || CAST(n_nationkey AS VARCHAR) AS geo,
        13e0 + n_nationkey / 1e2 AS glat, 100e0 + n_nationkey / 1e2 AS glon FROM nation)
    SELECT CAST(t.ticket_id AS VARCHAR) AS ticket_id, type, organization,
      'event ' || e.event_type || ' of user ' || CAST(e.user_id AS VARCHAR) AS comment,
      CASE WHEN t.ticket_id % 3 = 0 THEN 13e0 + t.ticket_id % 7 / 8e0 ELSE glat END AS latitude,
      CASE WHEN t.ticket_id % 3 < 2 THEN 100e0 + t.ticket_id % 5 / 4e0 ELSE glon END AS longitude,
      district, state, CASE WHEN t.ticket_id % 6 < 4 THEN CAST(t.ticket_id % 6 AS INTEGER) END AS star,
      count_reopen, {sql_stamp("timestamp_dt").replace("(timestamp_dt", "(date_trunc('second', timestamp_dt)")},
      {sql_stamp("last_activity_dt").replace("(last_activity_dt", "(date_trunc('second', last_activity_dt)")},
      CAST(NULL AS VARCHAR) AS photo, CAST(NULL AS VARCHAR) AS photo_after, CAST(NULL AS VARCHAR) AS address,
      CAST(NULL AS VARCHAR) AS subdistrict, CAST(NULL AS VARCHAR) AS province
    FROM tickets t JOIN events e ON t.ticket_id = e.event_id LEFT JOIN g ON trim(district) = geo""",
)
def silver_tickets(t):
    i = F.col("event_id")
    lon = F.format_string("%.2f", F.lit(100e0) + i % 5 / F.lit(4e0))
    lat = F.format_string("%.3f", F.lit(13e0) + i % 7 / F.lit(8e0))
    extra = [
        F.concat(
            F.lit(" event\n\t"), "event_type", F.lit("  of\r\nuser "), F.col("user_id").cast("string")
        ).alias("comment"),
        F.when(i % 3 == 0, F.concat(F.lit("["), lon, F.lit(", "), lat, F.lit("]")))
        .when(i % 3 == 1, lon)
        .alias("coords"),
        F.when(i % 6 < 4, F.concat((i % 6).cast("string"), F.lit(".0"))).otherwise("x").alias("star"),
    ]
    text = {c: F.lit(None).cast("string") for c in ["photo", "photo_after", "address", "subdistrict", "province"]}
    bronze = (
        t.tickets(*extra)
        .withColumns(
            {
                **text,
                "ticket_id": F.col("ticket_id").cast("string"),
                "timestamp": F.concat(
                    F.date_format("timestamp_dt", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00")
                ),
                "last_activity": F.date_format("last_activity_dt", "yyyy-MM-dd HH:mm:ss"),
                "processing_time": F.lit(None).cast("string"),
            }
        )
        .select(*schemas.BRONZE_TICKET.fieldNames())
    )
    key = F.col("n_nationkey")
    places = t.nation.select(
        F.col("n_name").alias("province"),
        F.concat(F.lit("D"), key.cast("string"), F.lit(" ")).alias("district"),
        (F.lit(13e0) + key / F.lit(1e2)).alias("latitude"),
        (F.lit(100e0) + key / F.lit(1e2)).alias("longitude"),
    )
    return to_silver(bronze, places).select(
        "ticket_id", "type", "organization", "comment", "latitude", "longitude", "district",
        "state", "star", "count_reopen", stamp("timestamp_dt"), stamp("last_activity_dt"),
        "photo", "photo_after", "address", "subdistrict", "province",
    )


@query(
    "json_encode",
    """SELECT event_id AS seq, CAST(to_json({event_id: event_id,
      event_type: CASE WHEN event_id % 13 <> 0 THEN event_type ELSE '' END,
      user_id: CASE WHEN event_id % 17 <> 0 THEN user_id END, value: value, props: props}) AS VARCHAR)
      AS value FROM events""",
)
def json_encode(t):
    i = F.col("event_id")
    rows = t.events.select(
        i.alias("seq"),
        "event_id",
        F.when(i % 13 != 0, F.col("event_type")).alias("event_type"),
        F.when(i % 17 != 0, F.col("user_id")).alias("user_id"),
        "value",
        "props",
    )
    return as_messages(rows, "seq")


@query(
    "csv_round_trip",
    """SELECT doc_id, lang, source, length(text) AS n_chars, md5(text) AS digest FROM documents""",
)
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    write_csv_parts(t.documents, path)
    back = read_csv(
        t.spark, path, t.documents.schema,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return back.select(
        "doc_id",
        "lang",
        "source",
        F.length("text").cast("bigint").alias("n_chars"),
        F.md5("text").alias("digest"),
    )
