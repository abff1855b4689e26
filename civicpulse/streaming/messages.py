"""Message sources and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicpulse import schemas

CORRUPT = "_corrupt_record"


def staged_stream(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """The landing folder as a stream of ``(seq, value)``, oldest file first.

    ``max_files`` bounds one micro-batch, as a fixed pull size would.
    """
    reader = spark.readStream.schema(schemas.STAGED_MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_offsets: int | None = None,
    **options: str,
) -> DataFrame:
    """A topic from its earliest offset as ``(seq, value)``.

    ``seq`` is the offset: arrival order holds within a partition, so producers
    key their messages by ticket id (see :func:`civicpulse.streaming.sinks.to_kafka`).
    Needs Spark's Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("offset").alias("seq"), F.col("value").cast("string").alias("value")
    )


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """``seq``, raw ``value``, the record's fields, and a mark where it is no record.

    Absent fields are null, unknown ones are dropped. Empty messages and JSON
    ``null`` are not messages at all and leave the stream here.
    """
    wanted = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    body = F.from_json(
        "value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    text = F.trim("value")
    return (
        messages.filter((text != "") & (text != "null"))
        .select("seq", "value", body.alias("body"))
        .select("seq", "value", "body.*")
    )


def records(decoded: DataFrame) -> DataFrame:
    """The readable messages."""
    return decoded.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantine(decoded: DataFrame) -> DataFrame:
    """The unreadable messages as ``(seq, value)``."""
    return decoded.filter(F.col(CORRUPT).isNotNull()).select("seq", "value")
