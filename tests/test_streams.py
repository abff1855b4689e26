"""Streams give what the finished set gives, however it is cut into batches."""

import json

import pytest
from helpers import column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicpulse.operators import arrival
from civicpulse.sinks.files import stage_messages
from civicpulse.sources.files import read_bronze_air, read_bronze_tickets
from civicpulse.streaming import ingest, sinks
from civicpulse.streaming.arrival import first_arrivals_stream, recent_arrivals_stream
from civicpulse.streaming.landing import AirLanding, TicketLanding
from civicpulse.streaming.ledger import IdLedger
from civicpulse.streaming.messages import decode, quarantine, records, staged_stream

# (seq, text): burned id A, blank ids, missing ids, non-messages, one hot id.
MESSAGES = [
    json.dumps({"ticket_id": "A", "coords": None}),
    json.dumps({"ticket_id": "B", "coords": "1,2", "comment": "first", "extra": 1}),
    json.dumps({"ticket_id": "A", "coords": "1,2"}),
    "",
    "null",
    '{"ticket_id": "broken',
    json.dumps({"ticket_id": "B", "coords": "3,4", "comment": "second"}),
    json.dumps({"coords": "1,2"}),
    json.dumps({"ticket_id": "", "coords": "", "comment": "blank"}),
    json.dumps({"ticket_id": "", "coords": "9,9"}),
    json.dumps({"ticket_id": "C", "coords": "5,6", "star": 4}),
] + [json.dumps({"ticket_id": "HOT", "coords": f"{i},0"}) for i in range(40)]

SAVED = {("B", "1,2"), ("", None), ("C", "5,6"), ("HOT", "0,0")}
TOTALS = {"saved": 4, "duplicates": 42, "missing_id": 1, "no_coords": 1, "unreadable": 1}
LANDED = {(k, v or "") for k, v in SAVED}
BROKEN = [(5, MESSAGES[5])]


def stage(spark, path, start, stop):
    rows = [(i, MESSAGES[i]) for i in range(start, stop)]
    frame = spark.createDataFrame(rows, "seq bigint, value string").orderBy(F.col("seq").desc())
    stage_messages(frame.coalesce(1), path)


def stage_all(spark, path, pieces):
    cuts = [len(MESSAGES) * i // pieces for i in range(pieces + 1)]
    for a, b in zip(cuts, cuts[1:]):
        stage(spark, path, a, b)


@pytest.mark.parametrize("pieces", [1, 4])
def test_ticket_stream(spark, tmp_path, pieces):
    base = str(tmp_path)
    stage_all(spark, f"{base}/in", pieces)
    stream = ingest.bronze_tickets(staged_stream(spark, f"{base}/in", 1))
    report = sinks.finish(sinks.to_csv(stream, f"{base}/out", f"{base}/state"))
    bronze = read_bronze_tickets(spark, f"{base}/out")
    assert set(column(bronze, "ticket_id", "coords")) == {
        (k or None, v) for k, v in SAVED
    }  # CSV cannot tell a blank from a null
    assert bronze.filter("processing_time is null").count() == 0
    assert ingest.counters(report) == TOTALS
    assert report["records"] == len(MESSAGES)


@pytest.mark.parametrize("pieces", [1, 4])
def test_ticket_landing(spark, tmp_path, pieces):
    base = str(tmp_path)
    stage_all(spark, f"{base}/in", pieces)
    landing = TicketLanding(f"{base}/out")
    sinks.finish(landing.start(staged_stream(spark, f"{base}/in", 1)))
    assert set(column(landing.bronze(spark), "ticket_id", "coords")) == LANDED
    assert landing.counters(spark).first().asDict() == TOTALS
    assert column(landing.quarantined(spark), "seq", "value") == BROKEN


def test_no_batch_is_forgotten(spark, tmp_path):
    """More micro-batches than a query remembers: totals are whole all the same."""
    for i in range(120):
        (tmp_path / "in").mkdir(exist_ok=True)
        text = json.dumps({"seq": i, "value": json.dumps({"ticket_id": str(i % 60), "coords": "1,2"})})
        (tmp_path / "in" / f"part-{i:03}.json").write_text(text + "\n")
    base = str(tmp_path)
    stream = decode(staged_stream(spark, f"{base}/in", 1), ingest.schemas.TICKET_MESSAGE)
    query = sinks.to_json(stream, f"{base}/out", f"{base}/state")
    report = sinks.finish(query)
    assert report["records"] == report["batches"] == 120
    assert len(query.recentProgress) < 120


def test_ledger_is_read_where_the_batch_needs_it(spark, tmp_path):
    landing = TicketLanding(str(tmp_path / "out"))
    schema = ingest.schemas.TICKET_MESSAGE

    def batch(ids):
        rows = [(i, json.dumps({"ticket_id": t, "coords": "1,2"})) for i, t in enumerate(ids)]
        return decode(spark.createDataFrame(rows, "seq bigint, value string"), schema)

    landing._land(batch([f"t{i}" for i in range(500)]), 0)
    ids = arrival.arrivals_per_key(records(batch(["t7"])), "ticket_id")
    known = landing.ledger.known(ids, 1)
    files = {f.split("bucket=")[1].split("/")[0] for f in known.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) == 1 and "t7" in column(known, "ticket_id")
    landing._land(batch(["t7", "new"]), 1)
    assert landing.bronze(spark).count() == 501


def ledger_files(folder):
    return [p for p in folder.rglob("part-*.parquet") if ".blooms" not in str(p)]


def test_ledger_stays_small_and_forgets_nothing(spark, tmp_path):
    ledger, seen = IdLedger(str(tmp_path), buckets=2, fan=3), set()
    for n in range(30):
        ids = {f"t{i}" for i in range(7 * n, 7 * n + 20)} | {f"t{n}"}
        frame = spark.createDataFrame([(i,) for i in ids], "ticket_id string")
        known = {r.ticket_id for r in frame.join(ledger.known(frame, n), "ticket_id").collect()}
        assert known == ids & seen
        ledger.add(frame.where(~F.col("ticket_id").isin(list(known))), n)
        seen |= ids
        # Fewer than ``fan`` runs a level, and those a merge has just replaced.
        levels = 1 + max(r.level for r in ledger.runs(spark, n + 1))
        assert len(ledger_files(tmp_path)) <= 2 * (levels * 2 + 3 * levels)
    assert len(ledger.runs(spark, 99)) <= 2 * 4
    held = [i for r in ledger.runs(spark, 99) for i in column(spark.read.parquet(f"{tmp_path}/{r.name}"), "ticket_id")]
    assert sorted(held) == sorted(seen)


def test_bloom_filters_spare_the_runs_that_lack_the_ids(spark, tmp_path):
    ledger = IdLedger(str(tmp_path), buckets=1, fan=2)
    for n in range(4):
        ledger.add(spark.range(5000).select(F.concat(F.lit(f"{n}-"), "id").alias("ticket_id")), n)
    (run,) = ledger.runs(spark, 4)
    assert run.level == 2
    other = spark.range(200).select(F.concat(F.lit("x"), "id").alias("ticket_id"))
    keyed = other.withColumn("bucket", ledger.bucket())
    hits = sum(bool(ledger._may_hold(keyed.where(F.col("ticket_id") == f"x{i}"), [run], [0])) for i in range(6))
    assert hits <= 2
    for key in ("0-0", "3-4999"):
        asked = spark.createDataFrame([(key,)], "ticket_id string")
        assert key in column(ledger.known(asked, 4), "ticket_id")


def test_a_merge_that_breaks_off_is_repeated(spark, tmp_path, monkeypatch):
    def frame(a, b):
        return spark.range(a, b).select(F.col("id").cast("string").alias("ticket_id"))

    ledger = IdLedger(str(tmp_path), buckets=2, fan=2)
    ledger.add(frame(0, 50), 0)
    for broken in ("_write_blooms", "_write_manifest"):
        monkeypatch.setattr(IdLedger, broken, lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.add(frame(50, 90), 1)
        monkeypatch.undo()
        assert {r.ticket_id for r in ledger.known(frame(0, 90), 1).collect()} == {str(i) for i in range(50)}
    ledger.add(frame(50, 90), 1)
    ledger.add(frame(50, 90), 1)  # a batch that had been finished already
    (run,) = ledger.runs(spark, 2)
    assert run.level == 1 and spark.read.parquet(f"{tmp_path}/{run.name}").count() == 90


def test_air_landing_keeps_what_it_cannot_read(spark, tmp_path):
    base = str(tmp_path)
    good = json.dumps({"district": "d", "date": "2024-01-01", "avg_pm25_ug_m3": 1.5})
    rows = [(0, good), (1, good), (2, good[:-1]), (3, "null")]
    stage_messages(spark.createDataFrame(rows, "seq bigint, value string"), f"{base}/in")
    landing = AirLanding(f"{base}/out")
    sinks.finish(landing.start(staged_stream(spark, f"{base}/in")))
    assert landing.bronze(spark).count() == 2 and landing.bronze(spark).filter("processing_time is null").count() == 0
    assert column(landing.quarantined(spark), "seq", "value") == [(2, good[:-1])]


def test_landing_goes_on_after_a_stop_and_repeats_a_batch(spark, tmp_path):
    base = str(tmp_path)
    landing = TicketLanding(f"{base}/out")
    half = 8
    stage(spark, f"{base}/in", 0, half)
    sinks.finish(landing.start(staged_stream(spark, f"{base}/in")))
    stage(spark, f"{base}/in", half, len(MESSAGES))
    sinks.finish(landing.start(staged_stream(spark, f"{base}/in")))
    want = sorted(column(landing.bronze(spark), "ticket_id", "coords"), key=str)
    assert set(want) == LANDED
    # A driver lost after writing repeats its last batch: nothing is doubled.
    rows = [(i, MESSAGES[i]) for i in range(half, len(MESSAGES))]
    batch = decode(spark.createDataFrame(rows, "seq bigint, value string"), ingest.schemas.TICKET_MESSAGE)
    landing._land(batch, 1)
    assert sorted(column(landing.bronze(spark), "ticket_id", "coords"), key=str) == want
    assert landing.counters(spark).first().asDict() == TOTALS


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    base = str(tmp_path)
    for a, b in ((0, 3), (3, len(MESSAGES))):
        stage(spark, f"{base}/in", a, b)
        stream = ingest.bronze_tickets(staged_stream(spark, f"{base}/in"))
        sinks.finish(sinks.to_csv(stream, f"{base}/out", f"{base}/state"))
    bronze = read_bronze_tickets(spark, f"{base}/out")
    assert set(column(bronze, "ticket_id", "coords")) == {(k or None, v) for k, v in SAVED}


@pytest.mark.parametrize("pieces", [1, 3])
def test_stream_equals_batch_on_conversations(spark, tmp_path, pieces):
    base = str(tmp_path)
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(
        "conv_id", F.col("turn").alias("seq"), "role"
    )
    want = sorted(column(arrival.first_arrivals(rows, "conv_id"), "conv_id", "seq", "role"))
    top = rows.agg(F.max("seq")).first()[0] + 1
    for i in range(pieces):
        part = rows.filter((F.col("seq") >= top * i // pieces) & (F.col("seq") < top * (i + 1) // pieces))
        stage_messages(
            part.select("seq", F.to_json(F.struct("conv_id", "role")).alias("value")).coalesce(1),
            f"{base}/in",
        )
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("role", T.StringType())])
    stream = records(decode(staged_stream(spark, f"{base}/in", 1), schema)).drop("value")
    out = first_arrivals_stream(stream, "conv_id")
    sinks.finish(sinks.to_parquet(out, f"{base}/out", f"{base}/state"))
    got = column(spark.read.parquet(f"{base}/out"), "conv_id", "seq", "role")
    assert sorted(got) == want


def test_bounded_state_variant(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame(
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02"), (None, "2024-01-01 00:00:02")],
        "ticket_id string, t string",
    ).select("ticket_id", F.col("t").cast("timestamp").alias("t")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("ticket_id string, t timestamp").parquet(f"{base}/in")
    out = recent_arrivals_stream(stream, "t", "1 hour")
    sinks.finish(sinks.to_parquet(out, f"{base}/out", f"{base}/state"))
    assert sorted(column(spark.read.parquet(f"{base}/out"), "ticket_id")) == ["a", "b"]


def test_air_stream_keeps_duplicates(spark, tmp_path):
    base = str(tmp_path)
    text = json.dumps(
        {"district": "d", "date": "2024-01-01", "avg_pm25_ug_m3": 1.5, "latitude": 1, "longitude": 2}
    )
    rows = spark.createDataFrame([(1, text), (2, text), (3, "null"), (4, "[")], "seq bigint, value string")
    stage_messages(rows, f"{base}/in")
    stream = ingest.bronze_air(staged_stream(spark, f"{base}/in"))
    sinks.finish(sinks.to_csv(stream, f"{base}/out", f"{base}/state"))
    bronze = read_bronze_air(spark, f"{base}/out")
    assert column(bronze, "district", "avg_pm25_ug_m3") == [("d", 1.5)] * 2
    assert bronze.filter("date is null or processing_time is null").count() == 0


def test_quarantine_and_bridge(spark, tmp_path):
    base = str(tmp_path)
    stage_all(spark, f"{base}/in", 2)
    source = staged_stream(spark, f"{base}/in")
    bad = quarantine(decode(source, ingest.schemas.TICKET_MESSAGE))
    sinks.finish(sinks.to_parquet(bad, f"{base}/bad", f"{base}/bad-state"))
    assert column(spark.read.parquet(f"{base}/bad"), "seq", "value") == [(5, MESSAGES[5])]
    report = sinks.finish(sinks.to_json(source, f"{base}/copy", f"{base}/copy-state"))
    copied = spark.read.schema("seq bigint, value string").json(f"{base}/copy").orderBy("seq")
    assert column(copied, "seq", "value") == list(enumerate(MESSAGES))
    assert report["records"] == len(MESSAGES) and report["records_per_second"] > 0


def test_decoding_rules(spark):
    rows = [(1, "[1]"), (2, "5"), (3, " null "), (4, '{"k": "7", "x": 1}'), (5, "{}")]
    schema = T.StructType([T.StructField("k", T.StringType())])
    decoded = decode(spark.createDataFrame(rows, "seq bigint, value string"), schema)
    assert column(records(decoded).orderBy("seq"), "seq", "k") == [(4, "7"), (5, None)]
    assert column(quarantine(decoded).orderBy("seq"), "seq") == [1, 2]
