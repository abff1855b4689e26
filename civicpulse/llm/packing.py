"""Packing by best-fit decreasing into windows of one length.

A document's ids are first cut into full windows; what is left over goes, longest first,
to the open window with the least room that still holds it, found by a segment tree over
remaining capacities. A task takes its documents in batches of a bounded number of tokens
and keeps its open windows from batch to batch, so memory does not grow with the partition
and no shuffle is needed; windows are numbered through afterwards from one count per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.llm.tokens import MOST_WORDS, encoder
from civicpulse.session import via_table

END_ID = 2
WINDOW = 4096
BATCH_TOKENS = 4_000_000
# Pieces that a task hands back at once: 8 MB of ids at most.
HANDED = 512
PIECES_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "task long, place long, offset long"
)


class OpenWindows:
    """Open windows by remaining capacity: ``put`` finds the tightest one that fits."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]
        self.count = 0

    def _mark(self, capacity: int, change: int) -> None:
        at = capacity + self.leaves
        while at:
            self.filled[at] += change
            at >>= 1

    def _tightest(self, length: int) -> int:
        """Smallest capacity of at least ``length`` with an open window; 0 if there is none."""
        at = length + self.leaves
        while not self.filled[at]:
            while at & 1:  # a right child: no sibling further right
                at >>= 1
                if at <= 1:
                    return 0
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.filled[at]:
                at += 1
        return at - self.leaves

    def put(self, length: int) -> tuple[int, int]:
        """``(window, offset)`` of a piece."""
        capacity = self._tightest(length)
        if capacity:
            number = self.held[capacity].pop()
            self._mark(capacity, -1)
        else:
            number, capacity = self.count, self.window
            self.count += 1
        rest = capacity - length
        if rest:
            self.held[rest].append(number)
            self._mark(rest, 1)
        return number, self.window - capacity


def _packed(path: str, window: int, end_id: int, batch_tokens: int, most_words: int = MOST_WORDS):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, most_words).encode_batch
        task, opened = TaskContext.get().partitionId(), OpenWindows(window)
        names = [part.split()[0] for part in PIECES_SCHEMA.split(", ")]
        pieces: list[tuple] = []
        held = 0

        def placed() -> Iterator[pa.RecordBatch]:
            pieces.sort(key=lambda p: -p[2])  # stable: ties stay in document order
            where = [opened.put(p[2]) for p in pieces]
            for at in range(0, len(pieces), HANDED):
                columns = [*zip(*pieces[at : at + HANDED])]
                spots = where[at : at + HANDED]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()),
                        pa.array(columns[4], pa.int64()), pa.array([task] * len(spots), pa.int64()),
                        pa.array([w for w, _ in spots], pa.int64()), pa.array([o for _, o in spots], pa.int64()),
                    ],
                    names,
                )

        for batch in batches:
            for key, tokens in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.append(tokens.astype("<u4"), np.array([end_id], "<u4"))
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    pieces.append((key, start, len(part), part.tobytes(), len(ids)))
                held += len(ids)
                if held >= batch_tokens:
                    yield from placed()
                    pieces.clear()
                    held = 0
        if pieces:
            yield from placed()

    return pack


def packed_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    batch_tokens: int = BATCH_TOKENS,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: one row per piece.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text is the end id
    alone; null and repeated ids are documents like any other; an empty table gives none.
    ``most_words`` bounds the words a worker remembers; it shapes memory and time, never results.
    """
    pieces = via_table(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _packed(tokenizer_path, window, end_id, batch_tokens, most_words), PIECES_SCHEMA
        ),
        "pieces",
    )
    tasks = pieces.groupBy("task").agg((F.max("place") + 1).alias("windows"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the packing stage, however many documents there are.
    bases = tasks.select("task", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("base"))
    return pieces.join(F.broadcast(bases), "task").select(
        "doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("place")).alias("sequence_id"), "offset"
    )


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """Digest of ``packed_pieces`` with the public word tokenizer unless another is named."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return piece_digest(packed_pieces(docs, tokenizer_path, **options))
