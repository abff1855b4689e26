"""Stream sinks and run control."""

from __future__ import annotations

import threading
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from civicpulse.fixed_values import EXACT_CSV

# How long to wait for the last events of a run that has ended.
EVENTS_WITHIN_S = 60


class ProgressTotals(StreamingQueryListener):
    """Sums over every micro-batch of every run; a query itself remembers the last hundred only."""

    def __init__(self):
        self.totals: dict[str, dict] = {}
        self.ended = threading.Condition()
        self.over: set[str] = set()

    def _total(self, run) -> dict:
        return self.totals.setdefault(
            str(run), {"rows": 0, "millis": 0, "batches": 0, "counters": {}, "last": None}
        )

    def onQueryStarted(self, event) -> None:
        self._total(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        total = self._total(progress.runId)
        # A session known by two Python objects reports each event twice, one after the other.
        event_id = (progress.batchId, progress.timestamp)
        if total["last"] == event_id:
            return
        total["last"] = event_id
        total["rows"] += progress.numInputRows
        total["millis"] += progress.durationMs.get("triggerExecution", 0)
        total["batches"] += progress.numInputRows > 0
        for name, row in progress.observedMetrics.items():
            counted = total["counters"].setdefault(name, {})
            for field, value in row.asDict().items():
                counted[field] = counted.get(field, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.over.add(str(event.runId))
            self.ended.notify_all()

    def wait_for(self, run: str) -> None:
        with self.ended:
            if not self.ended.wait_for(lambda: run in self.over, EVENTS_WITHIN_S):
                raise TimeoutError(f"run {run} reported no end")


_TOTALS = ProgressTotals()
_WATCHED: WeakSet[SparkSession] = WeakSet()


def progress_totals(spark: SparkSession) -> ProgressTotals:
    """The listener that all runs report to, added to a session on first use."""
    if spark not in _WATCHED:
        _WATCHED.add(spark)
        spark.streams.addListener(_TOTALS)
    return _TOTALS


def writer(df: DataFrame, checkpoint: str, every: str | None):
    progress_totals(df.sparkSession)
    out = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    # Without a cadence, take what is there and stop.
    return out.trigger(processingTime=every) if every else out.trigger(availableNow=True)


def to_csv(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """K4: append to a folder of quoted CSV files, exactly once per record."""
    return writer(df, checkpoint, every).format("csv").options(**EXACT_CSV).start(path)


def to_parquet(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """K4: the same to parquet, which later scans can split and prune."""
    return writer(df, checkpoint, every).format("parquet").start(path)


def to_json(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """T5, K3: pass ``(seq, value)`` messages on unchanged."""
    return (
        writer(df.select("seq", "value"), checkpoint, every).format("json").start(path)
    )


def to_kafka(
    df: DataFrame,
    servers: str,
    topic: str,
    checkpoint: str,
    key: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """K3: publish ``value``, keyed by a column so that copies of a key keep their order."""
    columns = ["value"] if key is None else [F.col(key).cast("string").alias("key"), "value"]
    return (
        writer(df.select(*columns), checkpoint, every)
        .format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .start()
    )


def finish(query: StreamingQuery) -> dict:
    """Wait for a bounded run to end and report it."""
    query.awaitTermination()
    _TOTALS.wait_for(str(query.runId))
    return throughput(query)


def throughput(query: StreamingQuery) -> dict:
    """Input records, seconds, records per second, and observed counters so far.

    Sums over all micro-batches of a query started through this module.
    """
    total = _TOTALS.totals.get(str(query.runId))
    if total is None:
        raise ValueError("the query was not started through this module")
    seconds = total["millis"] / 1000
    return {
        "records": total["rows"],
        "batches": total["batches"],
        "seconds": seconds,
        "records_per_second": total["rows"] / seconds if seconds else 0.0,
        "counters": total["counters"],
    }
