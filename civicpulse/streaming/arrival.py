"""First arrival per key over an endless stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals_stream(
    df: DataFrame, key: str = "ticket_id", order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Emit each non-null key once, with the earliest row of the batch that first has it.

    State is one flag per key, kept in RocksDB (a setting of ``tune``) so that it outgrows
    memory safely. Before the shuffle each Arrow batch is reduced to one row per key,
    so a key that floods the stream costs a row per batch, and what still
    meets in one group is read chunk by chunk.
    """
    by = list(order)

    # Nested so that workers get the code itself, whatever is installed there.
    def earliest(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 1:
            return rows
        return rows.sort_values(by, kind="stable").drop_duplicates(key)

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield earliest(rows)

    def claim(_key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            for _ in chunks:
                pass
            return
        best = None
        for rows in chunks:
            best = earliest(rows if best is None else pd.concat([best, rows]))
        state.update((True,))
        yield best

    return (
        df.filter(F.col(key).isNotNull())
        .mapInPandas(reduce_batches, df.schema)
        .groupBy(key)
        .applyInPandasWithState(claim, df.schema, "seen boolean", "append", "NoTimeout")
    )


def recent_arrivals_stream(
    df: DataFrame, event_time: str, delay: str, key: str = "ticket_id"
) -> DataFrame:
    """T3 with bounded state: keys are forgotten ``delay`` behind the newest event.

    Which copy inside one micro-batch survives is not fixed.
    """
    return (
        df.filter(F.col(key).isNotNull())
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark([key])
    )
