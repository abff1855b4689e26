"""Readers and writers."""

import datetime as dt
import json

import pytest
from helpers import column, plan_text
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse import schemas
from civicpulse.operators.filters import TicketFilter
from civicpulse.operators.ranking import newest_n, newest_preview, preview
from civicpulse.plans.gold import gold_tickets
from civicpulse.plans.silver import silver_air, silver_tickets
from civicpulse.session import shared_folder, via_table
from civicpulse.sinks.files import (
    UTF8_BOM,
    as_messages,
    export_single_csv,
    stage_messages,
    write_csv_parts,
    write_silver,
)
from civicpulse.sources import files

ODD_TEXTS = ['plain', ' edge ', 'a,b', 'say "hi"', 'two\nlines', 'cr\r\nlf', 'ไทย', "\\back"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, text string")


def read_back(spark, path, schema):
    return files.read_csv(
        spark, path, schema, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def test_csv_parts_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "parts")
    write_csv_parts(odd.repartition(3), path)
    back = read_back(spark, path, odd.schema)
    assert sorted(column(back, "id", "text")) == list(enumerate(ODD_TEXTS))


@pytest.mark.parametrize("bom", [False, True])
def test_single_file_export(spark, odd, tmp_path, bom):
    path = tmp_path / "new folder" / "out.csv"
    for _ in range(2):  # the second run replaces the first
        export_single_csv(odd.repartition(3), str(path), bom=bom)
    assert path.is_file()
    assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == ["out.csv"]
    assert path.read_bytes().startswith(UTF8_BOM) is bom
    back = read_back(spark, str(path), odd.schema)
    assert sorted(column(back, "id", "text")) == list(enumerate(ODD_TEXTS))


def test_missing_files_give_empty_frames(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert files.read_geography(spark, gone).count() == 0
    assert files.read_silver(spark, gone).schema == schemas.SILVER_TICKET
    assert files.read_silver(spark, gone + ".csv").count() == 0


def test_geography_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("id,district,longitude,province,latitude\n1, Bang Rak ,100.5,P,13.7\n2,x,bad,P,\n")
    rows = column(files.read_geography(spark, str(path)), "district", "latitude", "longitude")
    # surrounding blanks are trimmed later, as keys
    assert [(d.strip(), la, lo) for d, la, lo in rows] == [("Bang Rak", 13.7, 100.5), ("x", None, None)]


def test_seed_rows_keep_file_order(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text("a,b\n" + "".join(f"{i},\n" for i in range(500)))
    seed = files.read_seed(spark, str(path), ["a", "b"])
    assert column(seed.orderBy("seq"), "a") == [str(i) for i in range(500)]
    messages = as_messages(seed, "seq")
    assert json.loads(messages.orderBy("seq").first().value) == {"a": "0", "b": ""}
    newest = newest_preview(messages, "seq")
    assert [json.loads(v)["a"] for v in column(newest, "value")] == [str(i) for i in range(499, 493, -1)]
    assert preview(seed).count() == 5


def test_messages_are_appended(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "ก", None)], "seq bigint, a string, b string")
    for _ in range(2):
        stage_messages(as_messages(rows, "seq"), path)
    staged = spark.read.schema(schemas.STAGED_MESSAGE).json(path)
    assert column(staged, "value") == ['{"a":"ก","b":""}'] * 2


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{\n "district": "a", "latitude": 1, "hourly": {"time": ["2024-01-01T00:00"],\n "pm2_5": [null]}}'
    )
    (tmp_path / "b.json").write_text('{"district": "b"}')
    rows = files.read_payloads(spark, str(tmp_path)).orderBy("district").collect()
    assert (rows[0].hourly.time, rows[0].hourly.pm2_5, rows[1].hourly) == (
        ["2024-01-01T00:00"], [None], None,
    )


def bronze_row(**values):
    return tuple(values.get(f.name) for f in schemas.BRONZE_TICKET.fields)


def test_silver_job_end_to_end(spark, tmp_path):
    bronze = spark.createDataFrame(
        [
            bronze_row(ticket_id="1", coords="[100.5, 13.7]", comment="a\n b", star="4.0",
                       timestamp="2024-01-31 12:00:00.5+00", district="d", count_reopen="2"),
            bronze_row(ticket_id="2", coords="", district=" d ", timestamp="2024-02-01 00:00:00"),
            bronze_row(ticket_id="3", district="?", timestamp="bad"),
        ],
        schemas.BRONZE_TICKET,
    )
    geo = spark.createDataFrame([("P", "d ", 1.0, 2.0)], schemas.GEOGRAPHY)
    csv = str(tmp_path / "bronze")
    write_csv_parts(bronze, csv)
    silver = silver_tickets(files.read_bronze_tickets(spark, csv), geo)
    assert silver.schema == schemas.SILVER_TICKET
    assert silver.count() == bronze.count()
    parquet = str(tmp_path / "silver")
    write_silver(silver, parquet)
    back = files.read_silver(spark, parquet).orderBy("ticket_id")
    assert column(back, "ticket_id", "latitude", "longitude", "comment", "star", "count_reopen") == [
        ("1", 13.7, 100.5, "a b", 4, "2"), ("2", 1.0, 2.0, None, None, None),
        ("3", None, None, None, None, None),
    ]
    assert {p.name for p in (tmp_path / "silver").glob("ticket_month=*")} == {
        "ticket_month=2024-01", "ticket_month=2024-02",
        "ticket_month=__HIVE_DEFAULT_PARTITION__",
    }
    single = str(tmp_path / "silver.csv")
    export_single_csv(silver, single)
    again = files.read_silver(spark, single).orderBy("ticket_id")
    assert again.collect() == [
        r for r in back.select(*schemas.SILVER_TICKET.fieldNames()).collect()
    ]


def test_silver_air(spark):
    df = spark.createDataFrame([("d", 30.0), ("d", None)], "district string, avg_pm25_ug_m3 double")
    assert column(silver_air(df), "pm25_category") == ["Good", "Unhealthy"]


def test_via_table_uses_the_named_folder(spark, odd):
    folder = shared_folder(spark)
    df = via_table(odd.withColumn("x", F.col("id") + 1))
    assert column(df.orderBy("id"), "x") == list(range(1, len(ODD_TEXTS) + 1))
    assert all(folder.removeprefix("file:") in f for f in df.inputFiles())


SILVER_ROWS = [
    ("1", "2024-01-05 10:00:00", "2024-05-01 00:00:00"),
    ("2", "2024-02-05 10:00:00", "2024-02-06 00:00:00"),
    ("3", "2024-03-05 10:00:00", "2024-03-06 00:00:00"),
    ("4", None, "2024-04-01 00:00:00"),
]


@pytest.fixture
def by_month(spark, tmp_path):
    rows = spark.createDataFrame(SILVER_ROWS, "ticket_id string, a string, b string").select(
        "ticket_id", F.col("a").cast("timestamp").alias("timestamp_dt"),
        F.col("b").cast("timestamp").alias("last_activity_dt"), F.lit("s").alias("state"),
    )
    write_silver(rows, str(tmp_path / "silver"))
    return spark.read.parquet(str(tmp_path / "silver"))


@pytest.mark.parametrize(
    ("ts", "newest"), [("last_activity_dt", ["1", "4"]), ("timestamp_dt", ["3", "2"])]
)
def test_newest_rows_by_either_date(by_month, ts, newest):
    assert column(newest_n(by_month, 2, ts=ts), "ticket_id") == newest


def test_date_filter_prunes_by_its_own_column_only(by_month):
    chosen = TicketFilter(first_day=dt.date(2024, 2, 1), last_day=dt.date(2024, 3, 31))
    for kept in (chosen.apply(by_month), chosen.raw(by_month)):
        assert sorted(column(kept, "ticket_id")) == ["2", "3"]
        assert "PartitionFilters: [isnotnull(ticket_month" in plan_text(kept)


def test_choices_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "flat")
    spark.createDataFrame(
        [("1", None, "D1", 1.0, 2.0), ("2", "x", "D1", None, 2.0), ("3", "x", None, 1.0, float("nan")), ("4", "x", "D1", 1.0, 2.0)],
        "ticket_id string, state string, district string, latitude double, longitude double",
    ).selectExpr("*", "'{a}' AS type", "null AS count_reopen", "timestamp '2024-01-01' AS timestamp_dt",
                 "timestamp '2024-01-02' AS last_activity_dt", "'o' AS organization").drop("void").withColumn(
        "count_reopen", F.lit(None).cast("string")).write.parquet(path)
    label = fixed.UNKNOWN_LABELS["state"]
    chosen = TicketFilter(states=["x", label], districts=["D1"])
    gold = gold_tickets(spark.read.parquet(path), chosen=chosen)

    def pushed(df):  # plans show the first few conditions only
        return plan_text(df).split("PushedFilters: ")[1].split("ReadSchema")[0]

    located = pushed(gold_tickets(spark.read.parquet(path)))
    assert "IsNotNull(latitude)" in located and "IsNotNull(longitude)" in located
    assert "IsNull(state)" in pushed(gold) and "EqualTo(district,D1)" in pushed(gold)
    assert sorted(column(chosen.apply(gold), "ticket_id")) == ["1", "4"]
    assert chosen.apply(gold_tickets(spark.read.parquet(path))).exceptAll(chosen.apply(gold)).isEmpty()
