"""The package's operators bound to the driver's tables, each with its SQL twin.

A query is registered with :func:`book.query`; its SQL, where there is one, runs
on the same tables in DuckDB and must give the same rows.
"""

from querybook import arrivals, charts, dashboard, landed, parsing, streams, texts  # noqa: F401
from querybook.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
