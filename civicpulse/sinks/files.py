"""Batch writers (K1, K2, K5, K6)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.fixed_values import EXACT_CSV
from civicpulse.schemas import MONTH, MONTH_OF

UTF8_BOM = b"\xef\xbb\xbf"


def json_message(columns: Sequence[str]) -> Column:
    """K1: a row as JSON text, null fields written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def as_messages(df: DataFrame, seq: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(seq, value)`` with nulls in text columns turned into blanks."""
    columns = columns or [c for c in df.columns if c != seq]
    body = df.select(F.col(seq).cast("bigint").alias("_seq"), *columns).na.fill(
        "", subset=list(columns)
    )
    return body.select(F.col("_seq").alias("seq"), json_message(columns).alias("value"))


def stage_messages(messages: DataFrame, path: str) -> None:
    """K2: append ``(seq, value)`` rows to the landing folder as JSON lines."""
    messages.select("seq", "value").write.mode("append").json(path)


def write_silver(df: DataFrame, path: str, by_month: bool = True) -> None:
    """Silver as parquet, in one folder per month of ``timestamp_dt`` unless told otherwise.

    The rebalance hint evens out file sizes: small months share a task, a month
    holding most rows is split over several.
    """
    if not by_month:
        df.write.mode("overwrite").parquet(path)
        return
    dated = df.withColumn(MONTH, F.date_format(MONTH_OF, "yyyy-MM"))
    dated.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(path)


def write_csv_parts(df: DataFrame, path: str) -> None:
    """Quoted CSV, one file per task, each with a header."""
    df.write.mode("overwrite").options(**EXACT_CSV).csv(path)


def export_single_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """K5, K6: one CSV file at ``path``, of any size, replacing an older one.

    One file is written by one task; for large results prefer :func:`write_csv_parts`,
    a folder of parts. The part is renamed to ``path``; only a byte order mark, which has
    to stand before it, needs a copy.
    """
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    target = jpath(path)
    fs = target.getFileSystem(conf)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    write_csv_parts(df.coalesce(1), folder)
    parts = fs.globStatus(jpath(f"{folder}/part-*.csv"))
    if fs.exists(target):
        fs.delete(target, True)
    if bom:
        out = fs.create(target, True)
        out.write(bytearray(UTF8_BOM))
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(parts[0].getPath()), out, conf, True)
    else:
        fs.rename(parts[0].getPath(), target)
    fs.delete(jpath(folder), True)
