"""Lenient parsing and cleaning of raw text columns.

ANSI mode stays on: everything that may fail uses a ``try_`` form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed

# The characters Unicode-aware stripping takes as white space. A character set
# needs no regular expression per token.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_double(col: Column | str) -> Column:
    """C4: text to double; junk and NaN become null."""
    number = F.trim(_column(col).cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def lenient_int(col: Column | str) -> Column:
    """Text to int, fractions cut; junk becomes null."""
    return _column(col).cast("string").try_cast("double").try_cast("int")


def reopen_count(col: Column | str) -> Column:
    """Lenient int with 0 for anything unreadable."""
    return F.coalesce(lenient_int(col), F.lit(0))


def parse_coords(col: Column | str) -> Column:
    """``"lon,lat"`` or ``"[lon, lat]"`` to ``struct<longitude, latitude>``."""
    parts = F.split(F.translate(_column(col), "[]", ""), ",")
    return F.struct(
        clean_double(F.get(parts, F.lit(0))).alias("longitude"),
        clean_double(F.get(parts, F.lit(1))).alias("latitude"),
    )


def parse_ticket_timestamp(col: Column | str) -> Column:
    """Keep second precision, cut fraction and offset, null on junk."""
    text = F.substring(_column(col), 1, fixed.TICKET_TIMESTAMP_CHARS)
    return F.try_to_timestamp(text, F.lit(fixed.TICKET_TIMESTAMP_FORMAT))


def lenient_timestamp(col: Column | str) -> Column:
    """C11: ISO-like text to timestamp, null on junk."""
    return F.try_to_timestamp(_column(col))


def clean_text(col: Column | str) -> Column:
    """Line breaks, tabs and runs of space to one blank, trimmed."""
    return F.trim(F.regexp_replace(_column(col), r"\s+", " "))


def parse_set(
    col: Column | str,
    strip_chars: str = fixed.TYPE_STRIP_CHARS,
    null_token: str | None = None,
) -> Column:
    """``"{a, b}"`` to ``[a, b]``; empty tokens drop out.

    Null text gives an empty array, or ``[null_token]`` where one is named (N9).
    Model labels strip braces only: ``strip_chars="{}"`` (N10).
    """
    inner = F.btrim(_column(col), F.lit(strip_chars))
    tokens = F.filter(
        F.transform(F.split(inner, ","), lambda t: F.btrim(t, F.lit(_SPACES))),
        lambda t: t != "",
    )
    if_null = F.array().cast("array<string>") if null_token is None else F.array(F.lit(null_token))
    return F.coalesce(tokens, if_null)


def state_color(
    col: Column | str,
    colors: Mapping[str, Sequence[int]] = fixed.STATE_COLORS,
    default: Sequence[int] = tuple(fixed.OTHER_STATE_COLOR),
) -> Column:
    """Map lookup with a default."""

    def rgba(values: Sequence[int]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    pairs = [part for key, values in colors.items() for part in (F.lit(key), rgba(values))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _column(col)), rgba(default))


def pm25_band(col: Column | str, null_band: str | None = fixed.PM25_TOP_BAND) -> Column:
    """Band by inclusive upper bound; null falls into ``null_band``."""
    value = _column(col)
    band = F.when(value.isNull(), F.lit(null_band))
    for bound, name in fixed.PM25_BANDS:
        band = band.when(value <= bound, name)
    return band.otherwise(fixed.PM25_TOP_BAND)


def days_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in days as a double; negative where end is earlier."""
    micros = F.unix_micros(_column(end).cast("timestamp")) - F.unix_micros(
        _column(start).cast("timestamp")
    )
    return micros / F.lit(86400e6)


def matches(col: Column | str, pattern: str) -> Column:
    """case-insensitive regex search; null text is no match."""
    return F.coalesce(_column(col).rlike(f"(?iu){pattern}"), F.lit(False))
