"""Plan inspection shared by tests."""

from __future__ import annotations


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def column(df, *values):
    """Rows of ``df`` as a list of tuples or single values."""
    rows = [tuple(row[v] for v in values) for row in df.collect()]
    return [row[0] for row in rows] if len(values) == 1 else rows
