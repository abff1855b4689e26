"""Edge rows of the parsing functions."""

import datetime as dt

import pytest
from helpers import column
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions import parse


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression("x").alias("y")).first().y


@pytest.mark.parametrize(
    "text, expected",
    [
        ("100.5,13.7", (100.5, 13.7)),
        ("[100.5, 13.7]", (100.5, 13.7)),
        ("100.5", (100.5, None)),
        ("x,y", (None, None)),
        ("", (None, None)),
        (None, (None, None)),
        ("nan, 13", (None, 13.0)),
        ("1,2,3", (1.0, 2.0)),
    ],
)
def test_coords(spark, text, expected):
    assert tuple(one(spark, text, parse.parse_coords)) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("5", 5), ("4.0", 4), ("4.7", 4), ("", None), ("x", None), (None, None), ("9e99", None)],
)
def test_lenient_int(spark, text, expected):
    assert one(spark, text, parse.lenient_int) == expected
    assert one(spark, text, parse.reopen_count) == (expected or 0)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2021-09-03 12:51:09.453003+00", dt.datetime(2021, 9, 3, 12, 51, 9)),
        ("2021-09-03 12:51:09", dt.datetime(2021, 9, 3, 12, 51, 9)),
        ("bad", None),
        (None, None),
    ],
)
def test_ticket_timestamp(spark, text, expected):
    assert one(spark, text, parse.parse_ticket_timestamp) == expected


def test_clean_text(spark):
    assert one(spark, "a\n\tb \r\n c", parse.clean_text) == "a b c"
    assert one(spark, None, parse.clean_text) is None


@pytest.mark.parametrize(
    "text, gold, labels",
    [
        ("{a, b,,}", ["a", "b"], ["a", "b"]),
        ("{}", [], []),
        ("a", ["a"], ["a"]),
        (None, [], []),
        (" {a}", ["a"], ["{a"]),
        ("{ a　,b }", ["a", "b"], ["a", "b"]),
        ("{ , }", [], []),
    ],
)
def test_set_text(spark, text, gold, labels):
    assert one(spark, text, parse.parse_set) == gold
    assert one(spark, text, lambda c: parse.parse_set(c, fixed.LABEL_STRIP_CHARS)) == labels


def test_null_set_token(spark):
    assert one(spark, None, lambda c: parse.parse_set(c, null_token="nan")) == ["nan"]


@pytest.mark.parametrize(
    "value, band",
    [
        (25.0, "Very Good"),
        (25.01, "Good"),
        (37.0, "Good"),
        (50.0, "Moderate"),
        (90.0, "Unhealthy for Sensitive"),
        (90.01, "Unhealthy"),
        (None, "Unhealthy"),
    ],
)
def test_band(spark, value, band):
    assert one(spark, value, parse.pm25_band, "double") == band


def test_band_of_null_can_be_null(spark):
    assert one(spark, None, lambda c: parse.pm25_band(c, null_band=None), "double") is None


def test_state_color(spark):
    for state, rgba in fixed.STATE_COLORS.items():
        assert one(spark, state, parse.state_color) == rgba
    assert one(spark, "other", parse.state_color) == fixed.OTHER_STATE_COLOR
    assert one(spark, None, parse.state_color) == fixed.OTHER_STATE_COLOR


def test_province_pattern(spark):
    df = spark.createDataFrame([("BANGKOK",), ("กรุงเทพมหานคร",), ("x",), (None,)], "p string")
    matched = df.select(parse.matches("p", fixed.PROVINCE_PATTERN).alias("m"))
    assert column(matched, "m") == [True, True, False, False]


def test_days_between_may_be_negative(spark):
    df = spark.sql(
        "select timestamp '2024-01-02 00:00:00' as a, timestamp '2024-01-01 12:00:00' as b"
    )
    assert df.select(parse.days_between("a", "b").alias("d")).first().d == -0.5
    assert df.select(parse.days_between("a", F.lit(None)).alias("d")).first().d is None
