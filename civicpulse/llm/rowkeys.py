"""Dropping rows of a table of texts by small keys, so that texts are moved as little as possible.

A row's key is some of its columns and the hash of its text. Keys of rows to drop are
gathered in a narrow table; the rows themselves are filtered by an anti-join, which
scans the texts once and shuffles them only where the keys are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.session import broadcast_within, via_table

MARK = "mark"
MOST_KEYS = 1_000_000


def text_mark(text: Column | str) -> Column:
    """Hash of a text, by which rows that agree in their other keys are told apart."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def _same(rows: DataFrame, keys: DataFrame, text_col: str) -> Column:
    """Null-safe equality of all key columns."""
    same = text_mark(rows[text_col]) == keys[MARK]
    for name in keys.columns:
        if name != MARK:
            same = same & rows[name.removeprefix("key_")].eqNullSafe(keys[name])
    return same


def key_columns(names: list[str], text_col: str) -> list[Column]:
    """Key of a row: ``key_<name>`` of each column, and the mark of its text."""
    return [*[F.col(n).alias(f"key_{n}") for n in names], text_mark(text_col).alias(MARK)]


def without(rows: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """``rows`` whose key is not among ``keys``."""
    held = broadcast_within(via_table(keys.distinct(), "dropped"), max_rows=MOST_KEYS)
    return rows.join(held, _same(rows, held, text_col), "left_anti")


def once_each(rows: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """One row for each of ``keys``, of rows that repeat them."""
    held = broadcast_within(via_table(keys.distinct(), "repeated"), max_rows=MOST_KEYS)
    names = [n.removeprefix("key_") for n in keys.columns if n != MARK]
    found = rows.join(held, _same(rows, held, text_col), "left_semi").withColumn("__mark", text_mark(text_col))
    return found.dropDuplicates([*names, "__mark"]).drop("__mark")
