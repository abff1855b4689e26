"""Filters, series, distributions, densities: edge rows, invariants, plans."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from helpers import column, plan_text
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.operators import (
    arrival,
    density,
    distribution,
    filters,
    geography,
    indicators,
    payloads,
    ranking,
    timeseries,
)
from civicpulse.plans.dashboard import dashboard
from civicpulse.plans.explore import explore
from civicpulse.plans.gold import gold_tickets
from civicpulse.schemas import AIR_PAYLOAD, GEOGRAPHY, SILVER_TICKET
from querybook.book import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def gold(spark):
    return Tables(spark, SMALL).gold().withColumn("comment", F.lit("c")).withColumn(
        "subdistrict", F.lit("s")
    ).persist()


def silver_row(**values):
    return tuple(values.get(f.name) for f in SILVER_TICKET.fields)


def stamps(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "ticket_id int, t string").select(
        "ticket_id", F.col("t").cast("timestamp").alias("timestamp_dt")
    )


# -- gold and filters ---------------------------------------------------------------


def test_gold_defaults(spark):
    rows = [
        silver_row(ticket_id="a", latitude=1.0, longitude=2.0, count_reopen="1.0"),
        silver_row(ticket_id="b", latitude=None, longitude=2.0),
        silver_row(ticket_id="c", latitude=float("nan"), longitude=2.0),
    ]
    gold = gold_tickets(spark.createDataFrame(rows, SILVER_TICKET)).collect()
    assert [r.ticket_id for r in gold] == ["a"]
    assert {c: gold[0][c] for c in fixed.UNKNOWN_LABELS} == fixed.UNKNOWN_LABELS
    assert gold[0].count_reopen == 1
    assert gold[0].type_tokens == []
    assert gold[0].resolution_days is None


def test_empty_choice_keeps_all(gold):
    assert filters.TicketFilter().apply(gold).count() == gold.count()
    half = filters.TicketFilter(first_day=dt.date(2024, 1, 5))
    assert half.apply(gold).count() == gold.count()


def test_date_range_ends(spark):
    df = stamps(
        spark,
        ["2024-01-01 00:00:00", "2024-01-02 23:59:59", "2024-01-03 00:00:00", None],
    )
    kept = df.filter(
        filters.between_days("timestamp_dt", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    )
    assert column(kept, "ticket_id") == [0, 1]


def test_date_filter_reaches_the_scan(spark):
    events = Tables(spark, SMALL).events
    plan = plan_text(
        events.filter(filters.between_days("ts", dt.date(2024, 1, 5), dt.date(2024, 1, 6)))
    )
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan or (
        "GreaterThanOrEqual" in plan and "LessThan" in plan
    )


@pytest.mark.parametrize("span, start_back", [(400, 180), (30, 30)])
def test_default_window(spark, span, start_back):
    last = dt.datetime(2024, 6, 1)
    df = stamps(spark, [str(last - dt.timedelta(days=span)), str(last)])
    row = filters.date_bounds(df).first()
    assert row.max_date - row.default_start == dt.timedelta(days=start_back)


def test_date_bounds_without_times(spark):
    row = filters.date_bounds(stamps(spark, [None]), today=dt.date(2025, 1, 1)).first()
    assert (row.min_date, row.max_date) == (dt.date(2021, 1, 1), dt.date(2025, 1, 1))


def test_default_types_are_the_first_options(gold):
    options = column(filters.token_options(gold), "value")
    assert options == sorted(options)
    assert column(filters.default_types(gold), "value") == options[:5]


# -- ranking ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 100, 100_000])
def test_newest_n_equals_a_full_sort(gold, n):
    want = sorted(
        column(gold, "timestamp_dt", "ticket_id"),
        key=lambda r: (r[0] is None, -(r[0].timestamp() if r[0] else 0), r[1]),
    )[:n]
    assert column(ranking.newest_n(gold, n), "timestamp_dt", "ticket_id") == want


def test_newest_n_with_one_crowded_instant(spark):
    df = stamps(spark, ["2024-01-01 00:00:00"] * 500 + ["2024-01-02 00:00:00"] * 3 + [None])
    newest = ranking.newest_n(df.repartition(8), 10)
    assert column(newest, "ticket_id") == [500, 501, 502, 0, 1, 2, 3, 4, 5, 6]


def test_newest_n_cuts_before_its_shuffle(gold):
    plan = plan_text(ranking.newest_n(gold, 5000))
    assert plan.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan


def test_newest_n_filter_reaches_the_scan(spark):
    events = Tables(spark, SMALL).events
    plan = plan_text(ranking.newest_n(events, 10, "ts", ["event_id"]))
    assert "GreaterThanOrEqual(ts," in plan


def test_month_folders_are_skipped(spark, tmp_path):
    from civicpulse.sinks.files import write_silver
    from civicpulse.sources.files import read_silver

    rows = [
        silver_row(ticket_id=str(m), latitude=1.0, longitude=2.0, timestamp_dt=dt.datetime(2024, m, 5))
        for m in (1, 2, 3)
    ] + [silver_row(ticket_id="x", latitude=1.0, longitude=2.0)]
    path = str(tmp_path / "silver")
    write_silver(spark.createDataFrame(rows, SILVER_TICKET), path)
    gold = gold_tickets(read_silver(spark, path))
    assert gold.count() == 4
    day = dt.date(2024, 2, 5)
    february = filters.TicketFilter(first_day=day, last_day=day).apply(gold)
    assert column(february, "ticket_id") == ["2"]
    newest = ranking.newest_n(gold, 1)
    assert column(newest, "ticket_id") == ["3"]
    for df in (february, newest):
        assert "PartitionFilters: [isnotnull(ticket_month" in plan_text(df)
    assert column(ranking.newest_n(gold, 4), "ticket_id") == ["3", "2", "1", "x"]


# -- arrivals -----------------------------------------------------------------------


def test_burned_missing_and_blank_ids(spark):
    rows = [
        (1, "A", None), (2, "A", "1,2"),          # burned
        (3, None, "1,2"), (4, None, None),        # missing
        (5, "", "1,2"), (6, "", "3,4"),           # blank is an id
        (7, "B", "5,6"),
    ]
    df = spark.createDataFrame(rows, "seq bigint, id string, coords string").repartition(4)
    located = F.col("coords").isNotNull()
    kept = arrival.saved_tickets(df, "id", located).orderBy("seq")
    assert column(kept, "id", "coords") == [("", "1,2"), ("B", "5,6")]
    assert arrival.ingest_counters(df, "id", located).first().asDict() == {
        "saved": 2, "duplicates": 2, "missing_id": 2, "no_coords": 1,
    }


def test_counters_of_nothing(spark):
    df = spark.createDataFrame([], "seq bigint, id string, coords string")
    row = arrival.ingest_counters(df, "id", F.col("coords").isNotNull()).first()
    assert set(row.asDict().values()) == {0}


# -- geography ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(
        [
            ("P2", "Bang Rak", 2.0, 20.0),
            ("P1", " Bang Rak ", 1.0, 10.0),
            ("P1", "Sathon", 3.0, 30.0),
        ],
        GEOGRAPHY,
    )


def test_geography_keeps_the_smallest(places):
    rows = column(geography.dedup_geography(places), "geo_district", "geo_lat")
    assert sorted(rows) == [("Bang Rak", 1.0), ("Sathon", 3.0)]


def test_axes_are_filled_independently(spark, places):
    rows = [(1, " Bang Rak ", None, 5.0), (2, "Sathon", 4.0, None), (3, "?", None, None), (4, None, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, district string, la double, lo double")
    out = geography.impute_coordinates(
        df, geography.dedup_geography(places), F.col("la"), F.col("lo")
    )
    assert sorted(column(out, "id", "latitude", "longitude")) == [
        (1, 1.0, 5.0), (2, 4.0, 30.0), (3, None, None), (4, None, 1.0),
    ]
    assert "BroadcastHashJoin" in plan_text(out)


def test_a_large_dimension_is_not_broadcast(spark, places):
    from civicpulse.session import broadcast_within

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bounds, expected in (({}, True), ({"max_rows": 2}, False), ({"max_bytes": 10}, False)):
            joined = places.join(broadcast_within(places.select("district"), **bounds), "district")
            assert ("BroadcastHashJoin" in plan_text(joined)) is expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_target_locations_are_not_deduplicated(spark):
    df = spark.createDataFrame(
        [("Bangkok", "a", 1.0, 2.0), ("bangkok", "a", 1.0, 2.0), (None, "b", 1.0, 2.0)], GEOGRAPHY
    )
    assert column(geography.target_locations(df), "name") == ["a", "a"]


def test_payload_nulls_and_lengths(spark):
    def payload(name, times, values):
        return (name, 1.0, 2.0, (times, values))

    df = spark.createDataFrame(
        [
            payload("a", ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-02T00:00"], [1.0, None, None]),
            payload("b", ["2024-01-01T00:00", "2024-01-01T01:00"], [1.0]),
            payload("c", None, None),
        ],
        AIR_PAYLOAD,
    )
    assert column(payloads.air_messages(df), "district", "date", "avg_pm25_ug_m3") == [
        ("a", "2024-01-01", 1.0)
    ]
    assert column(payloads.rejected_payloads(df), "district") == ["b"]


# -- series -------------------------------------------------------------------------


def test_gap_day_is_zero(spark):
    df = stamps(spark, ["2024-01-01 05:00:00", "2024-01-03 06:00:00", None])
    assert column(timeseries.daily_counts(df).orderBy("day"), "n") == [1, 0, 1]


def test_daily_counts_sum_to_dated_rows(gold):
    total = timeseries.daily_counts(gold).agg(F.sum("n")).first()[0]
    assert total == gold.filter("timestamp_dt is not null").count()


def test_empty_series(gold):
    assert timeseries.daily_counts(gold.limit(0)).count() == 0
    assert timeseries.rolling_mean(timeseries.daily_counts(gold.limit(0))).count() == 0


def test_rolling_needs_a_full_window(spark):
    start = dt.date(2024, 1, 1)
    df = spark.createDataFrame(
        [(start + dt.timedelta(days=i), i + 1) for i in range(8)], "day date, n bigint"
    )
    rolled = timeseries.rolling_mean(df).orderBy("day")
    assert column(rolled, "n") == list(range(1, 9))
    assert column(rolled, "rolling_mean") == [None] * 6 + [4.0, 5.0]


def test_heatmap_shape(spark):
    table = timeseries.weekday_hour_heatmap(stamps(spark, ["2024-01-01 05:30:00", None])).collect()
    assert [r.day_of_week for r in table] == fixed.WEEKDAYS
    cells = {(r.day_of_week, h): r[f"h{h:02d}"] for r in table for h in range(24)}
    assert cells.pop(("Monday", 5)) == 1
    assert set(cells.values()) == {None}


# -- distributions ------------------------------------------------------------------


def values(spark, numbers):
    df = spark.createDataFrame([(float(x),) for x in numbers], "x double")
    return distribution.value_counts(df.repartition(4), "x")


def test_resolution_filter_bounds(spark):
    df = spark.createDataFrame(
        [(fixed.DONE_STATE, x) for x in (-1.0, 0.0, 59.9, 60.0, None)] + [("x", 1.0)],
        "state string, resolution_days double",
    )
    assert column(distribution.finished_within(df), "resolution_days") == [0.0, 59.9]


def test_histogram_equals_numpy(spark):
    rng = random.Random(7)
    data = [rng.random() * 60 for _ in range(500)] + [i * 2.0 for i in range(31)]
    counts, edges = np.histogram(data, bins=30)
    rows = distribution.histogram(values(spark, data)).orderBy("bin").collect()
    assert [r.n for r in rows] == counts.tolist()
    assert np.allclose([r.left_edge for r in rows], edges[:-1])
    assert np.allclose([r.right_edge for r in rows], edges[1:])


def test_histogram_of_one_value_and_of_none(spark):
    rows = distribution.histogram(values(spark, [5, 5])).orderBy("bin").collect()
    assert (rows[0].left_edge, rows[-1].right_edge) == (4.5, 5.5)
    assert [r.n for r in rows] == np.histogram([5, 5], bins=30)[0].tolist()
    assert distribution.histogram(values(spark, [])).count() == 0


def test_density_curve_equals_the_formula(spark):
    rng = random.Random(3)
    data = np.array([rng.gauss(20, 5) for _ in range(300)] + [20.0] * 50)
    h = data.std(ddof=1) * len(data) ** -0.2
    grid = np.linspace(data.min(), data.max(), 200)
    density_values = np.exp(-0.5 * ((grid[:, None] - data) / h) ** 2).sum(1) / (
        len(data) * h * np.sqrt(2 * np.pi)
    )
    want = density_values * len(data) * (data.max() - data.min()) / 30
    rows = distribution.density_curve(values(spark, data)).orderBy("point").collect()
    assert np.allclose([r.x for r in rows], grid)
    assert np.allclose([r.y for r in rows], want)


def test_no_curve_for_equal_values(spark):
    assert distribution.density_curve(values(spark, [3, 3, 3])).count() == 0
    assert distribution.density_curve(values(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_median_by_narrowing(spark, seed):
    rng = random.Random(seed)
    shapes = [
        [rng.random() for _ in range(1001)],
        [rng.random() for _ in range(1000)],
        [rng.randint(0, 3) for _ in range(500)] + [rng.random() * 1e-6 for _ in range(400)],
        [0.0 + rng.random() for _ in range(300)] + [1e9 + rng.random() for _ in range(300)],
        [5.0] * 700 + [rng.random() for _ in range(300)],
        [rng.lognormvariate(0, 8) for _ in range(999)],
    ]
    data = shapes[seed]
    found = distribution.exact_median(values(spark, data), slices=8, window_rows=16).first().median
    assert found == pytest.approx(statistics.median(data), rel=1e-12)


def test_median_of_none(spark):
    assert distribution.exact_median(values(spark, [])).first().median is None


def test_approximate_median(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    assert distribution.approximate_median(df, "x").first().median == 50.0


# -- map ----------------------------------------------------------------------------


def test_hexagons_hold_all_points_and_are_nearest(spark, gold):
    cells = density.hex_density(gold)
    assert cells.agg(F.sum("n")).first()[0] == gold.count()
    from civicpulse.functions.geo import with_hex_cell

    rng = random.Random(5)
    points = [(rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)) for _ in range(300)]
    df = spark.createDataFrame(points, "e double, n double")
    for row in with_hex_cell(df, F.col("e"), F.col("n"), 200).collect():
        def distance(dq, dr):
            a, b = row.q + dq, row.r + dr
            return np.hypot(200 * np.sqrt(3) * (a + b / 2) - row.e, 300 * b - row.n)
        own = distance(0, 0)
        around = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]
        assert all(own <= distance(*d) + 1e-9 for d in around)


def test_elevation_range(gold):
    low, high = density.hex_density(gold, radius=20_000).agg(
        F.min("elevation"), F.max("elevation")
    ).first()
    assert (low, high) == (0.0, 2000.0)


def test_grid_weights(gold):
    assert density.grid_density(gold).agg(F.sum("weight")).first()[0] == gold.count()
    double = density.grid_density(gold, weight=F.lit(2.0))
    assert double.agg(F.sum("weight")).first()[0] == 2 * gold.count()


def test_fixed_centre(gold):
    row = indicators.map_center(gold, follow_data=False).first()
    assert (row.latitude, row.longitude, row.zoom) == (*fixed.DEFAULT_CENTER, 11)


# -- whole requests -----------------------------------------------------------------


def test_dashboard_statistics_use_the_capped_rows(gold):
    result = dashboard(gold, max_points=50)
    assert result["total_filtered"].first()[0] == gold.count()
    assert result["kpi"].first().tickets == 50
    assert result["listing"].count() == 50
    assert result["points"].count() == 50
    assert result["heat"].agg(F.sum("weight")).first()[0] == 50
    assert result["captions"].first().resolution_rate.endswith("%")
    result["shown"].unpersist()


def test_dashboard_of_nothing(gold):
    result = dashboard(gold, filters.TicketFilter(states=["none such"]), follow_data=True)
    kpi = result["kpi"].first()
    assert (kpi.tickets, kpi.resolution_rate, kpi.avg_reopen, kpi.avg_resolution_days) == (0, 0, 0, None)
    center = result["center"].first()
    assert (center.latitude, center.longitude) == fixed.DEFAULT_CENTER
    for name in ("daily", "top_types", "top_districts", "points", "hexagons", "heat", "listing"):
        assert result[name].count() == 0


def test_exploration(gold):
    result = explore(gold)
    assert result["resolution_histogram"].agg(F.sum("n")).first()[0] == (
        distribution.finished_within(gold).count()
    )
    assert result["heatmap"].count() == 7
    assert result["trend"].count() > 0


@pytest.mark.parametrize("name", ["gold_tickets", "top_types", "silver_tickets", "ngrams", "tfidf_weights"])
def test_no_python_in_the_plan(spark, name):
    import __spark_entry__ as contract

    plan = plan_text(contract.queries()[name](spark, SMALL))
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
