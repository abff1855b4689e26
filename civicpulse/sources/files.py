"""Batch readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicpulse import schemas

QUOTED_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}

# Texts a lenient re-read takes as null.
NULL_TEXTS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, **options
) -> DataFrame:
    """Quoted CSV with line breaks inside values.

    A multi-line file is read by one task, so large CSV sets should be many
    files; pass ``multiLine=False`` for files known to hold one record a line,
    which are split.
    """
    return spark.read.schema(schema).options(**{**QUOTED_CSV, **options}).csv(path)


def read_seed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S3: every column of one file as text; ``seq`` numbers the rows in file order.

    ``seq`` is the byte where a row's split starts plus its row number there. A
    row is longer than a byte, so numbers never run into the next split.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    row_in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return read_csv(spark, path, schema).withColumn(
        "seq", F.col("_metadata.file_block_start") + row_in_task
    )


def read_bronze_tickets(spark: SparkSession, path: str) -> DataFrame:
    """The 17 bronze columns, all text."""
    return read_csv(spark, path, schemas.BRONZE_TICKET)


def read_bronze_air(spark: SparkSession, path: str) -> DataFrame:
    """Bronze air readings, typed."""
    return read_csv(spark, path, schemas.BRONZE_AIR)


def read_geography(spark: SparkSession, path: str) -> DataFrame:
    """The geography dimension; an empty frame if the file is missing.

    Columns are matched by header name, so the file may carry others.
    """
    return or_empty(
        spark,
        lambda: _by_header(spark, path, schemas.GEOGRAPHY),
        schemas.GEOGRAPHY,
    )


def _by_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    raw = spark.read.options(**QUOTED_CSV).csv(path)
    return raw.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_silver(
    spark: SparkSession, path: str, schema: T.StructType = schemas.SILVER_TICKET
) -> DataFrame:
    """Silver parquet, or the single-file CSV export; empty if missing."""
    if path.endswith(".csv"):
        return or_empty(spark, lambda: _reread_csv(spark, path, schema), schema)
    return or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


def _reread_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = read_csv(spark, path, text)
    return raw.select(
        *[
            F.when(~F.col(f.name).isin(NULL_TEXTS), F.col(f.name))
            .try_cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def read_payloads(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Landed API responses, one JSON document per file or one per line."""
    return spark.read.schema(schemas.AIR_PAYLOAD).json(path, multiLine=one_per_file)


def or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    """The read, or an empty frame of ``schema`` when the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
