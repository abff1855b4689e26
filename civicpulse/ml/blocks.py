"""Training rows in blocks: many sparse rows in one record, read by numpy without copies.

Iterative fits read their rows dozens of times. As blocks a pass moves a few large binaries to
each Python worker instead of a vector object per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civicpulse.ml.labels import binarize
from civicpulse.session import scratch_path

BLOCK_ROWS = 8192
BLOCK_CELLS = 1 << 17
BLOCK_SCHEMA = "block long, sizes binary, indices binary, values binary, targets binary"


@dataclass(frozen=True)
class Block:
    """``rows`` sparse rows: ``sizes`` cells each, and ``targets`` (rows x classes, 0 or 1)."""

    number: int
    sizes: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    targets: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The row of each cell."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Rows times ``weights`` (features x classes)."""
        out = np.zeros((len(self.sizes), weights.shape[1]))
        filled = self.sizes > 0
        if filled.any():
            heads = (np.cumsum(self.sizes) - self.sizes)[filled]
            # A class at a time: sums along one axis are several times faster than of narrow rows.
            for k in range(weights.shape[1]):
                out[filled, k] = np.add.reduceat(self.values * np.ascontiguousarray(weights[:, k])[self.indices], heads)
        return out


@cache
def parsed(schema: str) -> StructType:
    """A schema as a type, so that a short pass need not have the JVM read its text anew."""
    return StructType.fromDDL(schema)


def vector_cells(vector: Column) -> tuple[Column, Column]:
    """Indices and values of a vector column."""
    raw = F.unwrap_udt(vector)
    every = F.transform(raw["values"], lambda v, i: i)
    return F.when(raw["type"] == 1, every).otherwise(raw["indices"]), raw["values"]


def _blocked(n_classes: int):
    def made(number: int, sizes: list, indices: list, values: list, targets: list) -> pa.RecordBatch:
        arrays = [np.concatenate(sizes), np.concatenate(indices), np.concatenate(values), np.concatenate(targets)]
        kinds = ["<i4", "<i4", "<f8", "u1"]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, kinds)]],
            ["block", "sizes", "indices", "values", "targets"],
        )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, ([], [], [], []), 0
        for batch in batches:
            indices, values, targets = (pa.concat_arrays([batch.column(i)]) for i in range(3))
            sizes = np.diff(indices.offsets.to_numpy())
            ends = np.cumsum(sizes)
            a = 0
            while a < len(sizes):
                # Whole rows up to either bound, one row at least.
                done = ends[a - 1] if a else 0
                b = min(int(np.searchsorted(ends, done + BLOCK_CELLS - count, side="right")), a + BLOCK_ROWS, len(sizes))
                b = max(b, a + 1)
                held[0].append(sizes[a:b])
                held[1].append(indices.values.to_numpy()[done : ends[b - 1]])
                held[2].append(values.values.to_numpy()[done : ends[b - 1]])
                held[3].append(targets.values.to_numpy()[a * n_classes : b * n_classes])
                count += int(ends[b - 1] - done)
                a = b
                if count >= BLOCK_CELLS or sum(map(len, held[0])) >= BLOCK_ROWS or b < len(sizes):
                    yield made(number, *held)
                    number, held, count = number + 1, ([], [], [], []), 0
        if held[0]:
            yield made(number, *held)

    return blocked


def to_blocks(rows: DataFrame, classes: Sequence[str], features: str = "features", labels: str = "labels") -> DataFrame:
    """Rows as blocks, in scan order; no shuffle. Block numbers are unique."""
    indices, values = vector_cells(F.col(features))
    flat = rows.select(
        indices.alias("indices"), values.alias("values"), binarize(classes, labels).cast("array<tinyint>").alias("targets")
    )
    return flat.mapInArrow(_blocked(len(classes)), BLOCK_SCHEMA)


def read_blocks(batches: Iterator[pa.RecordBatch], n_classes: int) -> Iterator[Block]:
    """The blocks of a task's record batches."""
    for batch in batches:
        for number, *cells in zip(*batch.columns):
            sizes, indices, values, targets = (
                np.frombuffer(c.as_buffer(), k) for c, k in zip(cells, ["<i4", "<i4", "<f8", "u1"])
            )
            yield Block(number.as_py(), sizes, indices, values, targets.reshape(-1, n_classes))


def class_counts(blocks: DataFrame, n_classes: int) -> tuple[int, np.ndarray]:
    """Rows, and how many of them bear each class; one pass, one small row per task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(n_classes, np.int64), 0
        for batch in batches:
            for cells in batch.column(0):
                targets = np.frombuffer(cells.as_buffer(), "u1").reshape(-1, n_classes)
                total += targets.sum(axis=0, dtype=np.int64)
                n += len(targets)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(n_classes)]), pa.array([n, *total])], ["label", "n"])

    rows = blocks.select("targets").mapInArrow(counted, "label long, n long").groupBy("label").agg(F.sum("n").alias("n")).collect()
    found = {r.label: r.n for r in rows}
    return found.get(-1, 0), np.array([found.get(k, 0) for k in range(n_classes)], np.int64)


def settled(blocks: DataFrame, purpose: str) -> DataFrame:
    """``blocks`` as a table, read by a session of its own that plans many short passes quickly.

    Run-time replanning is off there; the caller's session keeps its settings.
    """
    path = scratch_path(blocks.sparkSession, purpose)
    blocks.write.parquet(path)
    quick = blocks.sparkSession.newSession()
    quick.conf.set("spark.sql.adaptive.enabled", "false")
    quick.conf.set("spark.sql.shuffle.partitions", blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = quick.read.schema(blocks.schema).parquet(path)
    # Few files would leave most cores idle in every pass; the blocks are dealt out once.
    cores = quick.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def feature_count(rows: DataFrame, features: str) -> int:
    """Length of the feature vectors; 0 without rows."""
    first = rows.select(F.unwrap_udt(features).alias("x")).select(
        F.coalesce("x.size", F.size("x.values")).alias("n")
    ).first()
    return first.n if first else 0
