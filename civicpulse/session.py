"""Session settings and the few helpers that touch cluster state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings every job relies on.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# What is held at once where whole texts pass through many stages of one session: bytes of a
# batch that goes to a Python worker, rows of a batch that a scan reads.
BATCH_BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session built elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Apply the bounds of batches; they shape memory, never results."""
    for key, value in BATCH_BOUNDS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "civicpulse", master: str | None = None, **settings) -> SparkSession:
    """A session with the package's settings; extra settings are given as ``{key: value}``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where a session names none (single-machine tests) is one made, until Python ends.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if named:
        return named
    if not alone:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="civicpulse-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def via_table(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(
    df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20
) -> DataFrame:
    """Mark ``df`` for broadcast only if a measured size proves it small.

    Above either bound the frame comes back unmarked, so the join shuffles and
    adaptive execution splits skewed partitions.
    """
    size = df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b"),
    ).first()
    return F.broadcast(df) if size.n <= max_rows and size.b <= max_bytes else df
