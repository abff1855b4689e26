"""Parts of exact size without a global sort: the smallest hashes, found by narrowing histograms (M3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 4


def smallest(df: DataFrame, place: Column, count: int, most: int = 100_000) -> Column:
    """Condition on ``df`` that holds for exactly the ``count`` smallest of the hex strings ``place``.

    ``place`` are lower-case hex strings of one length, no two equal. Each pass counts the
    rows by the next :data:`DIGITS` digits below the prefix in which the bound lies (at most
    65,536 rows to the driver), until no more than ``most`` are left there to be ranked.
    """
    if count <= 0:
        return F.lit(False)
    prefix, below = "", 0
    while True:
        inside = df.where(F.startswith(place, F.lit(prefix))) if prefix else df
        pieces = inside.groupBy(F.substring(place, len(prefix) + 1, DIGITS).alias("piece")).count().orderBy("piece").collect()
        for row in pieces:
            if below + row["count"] >= count:
                break
            below += row["count"]
        else:
            return F.lit(True)  # there are no more rows than wanted
        prefix += row.piece
        if row["count"] <= most:
            break
    last = df.where(F.startswith(place, F.lit(prefix))).select(place.alias("p")).orderBy("p").limit(count - below)
    return place <= F.lit(last.agg(F.max("p")).first()[0])
