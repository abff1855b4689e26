"""The corpus pipeline: each stage calls one operator on all its predecessor kept.

Stages hand on the columns of ``documents``; the last returns the packed pieces. ``run``
writes every stage's result as Parquet below the shared folder and reads it again, so
a stage that fails is repeated from its predecessor's table.

All stages share the executors, and neither a JVM's heap nor a Python worker gives back what a
stage once took. So each stage bounds the batches in which texts are read and handed over;
its result is lazy, so the bounds hold on for whoever writes it. ``run`` takes them back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from civicpulse.llm.divergence import keep_by_rules
from civicpulse.llm.packing import pack_documents
from civicpulse.llm.positional import drop_contaminated
from civicpulse.llm.simhash import drop_near_duplicates
from civicpulse.llm.site_quality import keep_quality
from civicpulse.session import BATCH_BOUNDS, bound_batches, via_table

# Words that a packing worker remembers, beside what earlier stages left in the executor.
PACKING_WORDS = 100_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_bounded_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bound_batches(spark), docs, sf_dir)

    return bounded


@in_bounded_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_bounded_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_by_rules(docs)


@in_bounded_batches
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=4, max_distance=4)


@in_bounded_batches
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_bounded_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, most_words=PACKING_WORDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

# Fitted models, SimHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = {key: spark.conf.get(key) for key in BATCH_BOUNDS}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            docs = via_table(stage(spark, docs, sf_dir), name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return docs
