"""Token files by a static range asymmetric numeral system (rANS).

Texts are tokenized once, into a table in the shared folder that also holds each task's
token counts; their sum is the one frequency table that serves every block. A block holds whole
documents up to a number of tokens and is coded by ``LANES`` interleaved states of 64 bits
that write 32-bit words to one stream: token i belongs to lane i mod LANES. Every
``STRIDE`` rows of lanes a checkpoint keeps the states and the place in the stream, so
segments between checkpoints decode independently, each proven by its own checksum.

The files are a Parquet table of blocks (so Spark's committer guards them against lost
executors) in shards of ascending document id, beside the frequency table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicpulse.llm.tokens import encoder
from civicpulse.session import via_table

SCALE = 20
LANES = 1024
STRIDE = 256
BLOCK_TOKENS = 1 << 20
LOW = np.uint64(1 << 31)
BLOCK_SCHEMA = (
    "shard int, block int, first long, n_tokens long, keys array<long>, sizes array<long>, "
    "stream binary, states binary, places array<long>, checksums array<long>"
)


class Table:
    """Frequencies scaled to ``1 << SCALE`` slots; every counted symbol keeps at least one."""

    def __init__(self, counts: dict[int, int], scale: int = SCALE):
        size = max(counts, default=0) + 1
        raw = np.zeros(size, np.float64)
        raw[list(counts)] = list(counts.values())
        slots = 1 << scale
        freq = np.maximum(np.floor(raw / max(raw.sum(), 1) * slots), raw > 0).astype(np.int64)
        if not raw.any():
            freq[0] = slots
        order = np.lexsort((np.arange(size), -freq))
        over = int(freq.sum()) - slots
        for at in order:  # the most frequent symbols take up the difference
            if over == 0:
                break
            change = min(over, int(freq[at]) - 1) if over > 0 else over
            freq[at] -= change
            over -= change
        if over:
            raise ValueError("more symbols than slots")
        self.scale = np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(size, dtype=np.uint16), freq)
        self.slots = np.uint64(slots)


def encode_block(tokens: np.ndarray, table: Table, lanes: int = LANES, stride: int = STRIDE):
    """``(stream, states, places, checksums)`` of a block's tokens (unsigned 16-bit)."""
    state, quotients = np.full(lanes, LOW, np.uint64), np.empty(lanes, np.uint64)
    size = stride * lanes
    groups: list[np.ndarray] = []
    states, places, written = [], [], 0
    for first in range((len(tokens) - 1) // size * size, -1, -size):
        part = tokens[first : first + size]
        freqs, starts = table.freq.take(part), table.start.take(part)
        bounds = freqs << np.uint64(63 - table.scale)
        gaps = table.slots - freqs
        for at in range((len(part) - 1) // lanes * lanes, -1, -lanes):
            row = slice(at, at + lanes)
            freq = freqs[row]
            x, quotient = state[: len(freq)], quotients[: len(freq)]
            full = np.flatnonzero(x >= bounds[row])
            if len(full):
                words = x.take(full)
                groups.append(words.astype(np.uint32))
                written += len(words)
                x[full] = words >> np.uint64(32)
            # The quotient takes whole turns of slots, the rest stays: x + quotient * (slots - freq) + start.
            np.floor_divide(x, freq, out=quotient)
            quotient *= gaps[row]
            x += quotient
            x += starts[row]
        states.append(state.copy())
        places.append(written)
    stream = np.concatenate(groups[::-1]) if groups else np.empty(0, np.uint32)
    checksums = [zlib.crc32(tokens[i : i + size].tobytes()) for i in range(0, len(tokens), size)]
    return (
        stream.astype("<u4").tobytes(),
        np.array(states[::-1]).astype("<u8").tobytes(),
        [written - p for p in places[::-1]],
        checksums,
    )


def decode_segment(
    number: int, n_tokens: int, stream: np.ndarray, states: np.ndarray, place: int, checksum: int,
    table: Table, lanes: int = LANES, stride: int = STRIDE,
) -> np.ndarray:
    """Tokens of one segment, read from its checkpoint alone and checked."""
    first = number * stride * lanes
    count = min(n_tokens - first, stride * lanes)
    out = np.empty(count, np.uint16)
    state = states[number].copy()
    mask = table.slots - np.uint64(1)
    for at in range(0, count, lanes):
        x = state[: count - at]
        slot = x & mask
        symbols = table.symbol.take(slot.view(np.int64))
        out[at : at + lanes] = symbols
        slot -= table.start.take(symbols)
        x >>= table.scale
        x *= table.freq.take(symbols)
        x += slot
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x.take(low) << np.uint64(32)) | stream[place : place + len(low)]
            place += len(low)
    if zlib.crc32(out.tobytes()) != checksum:
        raise ValueError(f"checksum of segment {number} differs")
    return out


def decode_block(row: dict, table: Table, lanes: int = LANES, stride: int = STRIDE) -> np.ndarray:
    stream = np.frombuffer(row["stream"], "<u4").astype(np.uint64)
    states = np.frombuffer(row["states"], "<u8").reshape(-1, lanes)
    parts = [
        decode_segment(i, row["n_tokens"], stream, states, place, checksum, table, lanes, stride)
        for i, (place, checksum) in enumerate(zip(row["places"], row["checksums"]))
    ]
    return np.concatenate(parts) if parts else np.empty(0, np.uint16)


TOKENS_SCHEMA = "key long, row long, tokens binary, counts binary"


def _tokens(path: str, end_id: int):
    names = [part.split()[0] for part in TOKENS_SCHEMA.split(", ")]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(path).encode_batch, zstandard.ZstdCompressor(level=3).compress
        counts = np.zeros(1 << 16, np.int64)
        end = np.array([end_id], "<u2")
        for batch in batches:
            packed, held = [], [end[:0]]
            for ids in encode(batch.column(2)):
                ids = np.concatenate((ids, end))
                held.append(ids)
                packed.append(pack(ids.tobytes()))
            counts += np.bincount(np.concatenate(held), minlength=1 << 16)
            nothing = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), nothing], names
            )
        # One more row for each task: what it has counted.
        total = pa.array([pack(counts.astype("<i8").tobytes())], pa.binary())
        empty = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, pa.nulls(1, pa.binary()), total], names)

    return tokens


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for counts in batch.column(0):
            total += np.frombuffer(unpack(counts.as_py()), "<i8")
    seen = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])


def _blocks(block_tokens: int, table):
    schema = pa.schema(
        [
            ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()),
            ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("stream", pa.binary()),
            ("states", pa.binary()), ("places", pa.list_(pa.int64())), ("checksums", pa.list_(pa.int64())),
        ]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unpack, shard = zstandard.ZstdDecompressor().decompress, TaskContext.get().partitionId()
        keys, texts, held, block, first = [], [], 0, 0, 0

        def made() -> pa.RecordBatch:
            tokens = np.concatenate(texts)
            stream, states, places, checksums = encode_block(tokens, table.value)
            row = {
                "shard": shard, "block": block, "first": first, "n_tokens": len(tokens), "keys": keys,
                "sizes": [len(t) for t in texts], "stream": stream, "states": states,
                "places": places, "checksums": checksums,
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                texts.append(np.frombuffer(unpack(packed.as_py()), "<u2"))
                held += len(texts[-1])
                if held >= block_tokens:
                    yield made()
                    block, first = block + 1, first + held
                    keys, texts, held = [], [], 0
        if keys:
            yield made()

    return blocks


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    shards: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write all of ``docs`` as token files below ``path``, in ascending id order.

    Null ids come first, ties in scan order (and may lie in several shards); a null
    or empty text is the end id alone; no documents leave an empty table of blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    tokens = via_table(rows.mapInArrow(_tokens(tokenizer_path, end_id), TOKENS_SCHEMA), "tokens")
    counted = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(_unpacked, "token long, n long")
    counted.groupBy("token").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(read_table(spark, path))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        tokens.where("counts IS NULL")
        .select("key", "row", "tokens")
        .repartitionByRange(shards, "key", "row")
        .sortWithinPartitions("key", "row")
    )
    made = ordered.select("key", "tokens").mapInArrow(_blocks(block_tokens, table), BLOCK_SCHEMA)
    made.write.parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    """The frequency table: at most one row per id of the vocabulary."""
    return Table({r.token: r.n for r in spark.read.parquet(f"{path}/table").collect()})


def _decoded(table):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = decode_block(row, table.value).astype("<u4")
                stops = np.cumsum(row["sizes"])
                starts = stops - row["sizes"]
                ids = [tokens[a:b].tobytes() for a, b in zip(starts, stops)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(ids), pa.int32()), pa.array(row["keys"], pa.int64()),
                        pa.array(starts + row["first"], pa.int64()), pa.array(row["sizes"], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["shard", "doc_id", "within", "n_tokens", "ids"],
                )

    return decoded


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files below ``path``.

    ``start`` counts the tokens of all documents before it, ``ids`` are little-endian
    unsigned 32-bit numbers. A damaged segment raises.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.sparkContext.broadcast(read_table(spark, path))
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard file.
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = blocks.mapInArrow(
        _decoded(table), "shard int, doc_id long, within long, n_tokens long, ids binary"
    )
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids"
    )
