"""Landing large drains of ticket messages without per-key Python state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from civicpulse import schemas
from civicpulse.operators.arrival import arrivals_per_key
from civicpulse.sources.files import or_empty
from civicpulse.streaming.ingest import now_text
from civicpulse.streaming.ledger import IdLedger
from civicpulse.streaming.messages import decode, quarantine, records
from civicpulse.streaming.sinks import writer

COUNTED = ["saved", "duplicates", "missing_id", "no_coords", "unreadable"]
COUNTERS = ", ".join(f"{name} bigint" for name in [*COUNTED, "batch"])
QUARANTINE = "seq bigint, value string, batch bigint"


class _Landing:
    """What both landings share: unreadable messages are kept and counted in the same batch."""

    folder: str

    def quarantined(self, spark: SparkSession) -> DataFrame:
        """Unreadable messages as ``(seq, value)``."""
        path = f"{self.folder}/quarantine"
        found = or_empty(
            spark, lambda: spark.read.schema(QUARANTINE).parquet(path), T.StructType.fromDDL(QUARANTINE)
        )
        return found.select("seq", "value")

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")


@dataclass(frozen=True)
class TicketLanding(_Landing):
    """Bronze tickets below ``folder``, with a ledger of every id ever seen.

    Each micro-batch is reduced to one row per id, marked by a join with the
    ledger, and what is new is written as bronze and added to the ledger.
    Both sides of that join hold an id once, so no id is hot in it.
    Every write goes to a folder named after the batch and replaces it, and a
    batch reads the ledger of earlier batches only: a repeated batch, after a
    lost driver, writes the same rows again.

    The ledger merges its runs as batches go on and asks Bloom filters which of them to open
    (:class:`civicpulse.streaming.ledger.IdLedger`), so a small batch does not scan every id
    ever seen, and files stay few.
    """

    folder: str
    buckets: int = 64
    fan: int = 8

    @property
    def ledger(self) -> IdLedger:
        return IdLedger(f"{self.folder}/ledger", self.buckets, self.fan)

    def start(self, messages: DataFrame, every: str | None = None) -> StreamingQuery:
        incoming = decode(messages, schemas.TICKET_MESSAGE)
        return writer(incoming, f"{self.folder}/checkpoint", every).foreachBatch(self._land).start()

    def bronze(self, spark: SparkSession) -> DataFrame:
        """The 17 bronze columns, all text."""
        path = f"{self.folder}/bronze"
        return or_empty(
            spark, lambda: spark.read.schema(schemas.BRONZE_TICKET).parquet(path), schemas.BRONZE_TICKET
        ).select(*schemas.BRONZE_TICKET.fieldNames())

    def counters(self, spark: SparkSession) -> DataFrame:
        """One row of :data:`COUNTED` over all batches."""
        return spark.read.schema(COUNTERS).parquet(f"{self.folder}/counters").agg(
            *[F.sum(c).alias(c) for c in COUNTED]
        )

    def _land(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        per_id = arrivals_per_key(records(batch), "ticket_id").persist()
        ids = per_id.join(self.ledger.known(per_id, batch_id), "ticket_id", "left")
        fresh = ids.filter(F.col("ticket_id").isNotNull() & F.col("known").isNull())
        bronze = fresh.filter(F.col("coords").isNotNull()).withColumn("processing_time", now_text())
        self._write(bronze.select(*schemas.BRONZE_TICKET.fieldNames()), "bronze", batch_id)
        self.ledger.add(fresh, batch_id)
        broken = quarantine(batch)
        self._write(broken, "quarantine", batch_id)
        # One row each: the batch's totals beside the count of what could not be read.
        counted = _totals(ids).join(F.broadcast(broken.agg(F.count("*").alias("unreadable"))))
        self._write(counted.select(*COUNTED), "counters", batch_id)
        per_id.unpersist()
        batch.unpersist()


@dataclass(frozen=True)
class AirLanding(_Landing):
    """Bronze air readings below ``folder``, every one, and what could not be read."""

    folder: str

    def start(self, messages: DataFrame, every: str | None = None) -> StreamingQuery:
        incoming = decode(messages, schemas.AIR_MESSAGE)
        return writer(incoming, f"{self.folder}/checkpoint", every).foreachBatch(self._land).start()

    def bronze(self, spark: SparkSession) -> DataFrame:
        path = f"{self.folder}/bronze"
        return or_empty(
            spark, lambda: spark.read.schema(schemas.BRONZE_AIR).parquet(path), schemas.BRONZE_AIR
        ).select(*schemas.BRONZE_AIR.fieldNames())

    def _land(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        read = records(batch).select(
            *[
                F.col(f.name).try_cast(f.dataType).alias(f.name)
                if f.name != "processing_time"
                else F.current_timestamp().alias(f.name)
                for f in schemas.BRONZE_AIR.fields
            ]
        )
        self._write(read, "bronze", batch_id)
        self._write(quarantine(batch), "quarantine", batch_id)
        batch.unpersist()


def _totals(ids: DataFrame) -> DataFrame:
    """The batch's counters from its per-id rows."""
    has_id, is_new = F.col("ticket_id").isNotNull(), F.col("known").isNull()
    has_coords = F.col("coords").isNotNull()

    def total(col: Column) -> Column:
        return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")

    return ids.agg(
        total(F.when(has_id & is_new & has_coords, 1)).alias("saved"),
        total(F.when(has_id, F.col("copies") - F.when(is_new, 1).otherwise(0))).alias("duplicates"),
        total(F.when(~has_id, F.col("copies"))).alias("missing_id"),
        total(F.when(has_id & is_new & ~has_coords, 1)).alias("no_coords"),
    )
