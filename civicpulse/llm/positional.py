"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns documents into blocks of a bounded number of tokens, each a row of a
table: its dictionary, and for every term the sorted positions at which it
stands (as deltas). Documents lie ``GAP`` apart on the position axis of their block, so no
match crosses from one to the next. A block is built and searched alone, so
neither step shuffles, and a lost task repeats only its own blocks.

``search`` takes the test items' windows in bounded portions. In each block a window
starts from the list of its rarest term; the other lists, shifted by their offset in the
window, are intersected with it from rare to frequent. With ``slop`` 0 that is the exact
phrase; otherwise each term may stand up to ``slop`` places from where it belongs
(proximity). Runs of overlapping matches of an item are joined into one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.llm.rowkeys import MARK, text_mark, without
from civicpulse.llm.words import alnum_words, utf8
from civicpulse.session import via_table

GAP = 64
BLOCK_TOKENS = 1_000_000
INDEX_SCHEMA = (
    "block long, keys array<long>, texts array<long>, starts binary, counts array<long>, "
    "terms binary, heads binary, postings binary"
)
SPAN_SCHEMA = "block long, ordinal int, item string, start int, length int, exact boolean"
TERM_BITS = np.uint64(32)


class _Terms(dict):
    """Term numbers in order of first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _numbers(terms: _Terms, words: list[bytes]) -> np.ndarray:
    return np.fromiter((terms[w] for w in words), np.int32, len(words))


def _block(block: int, keys: list, texts: list, tokens: list, terms: _Terms | None = None) -> dict:
    """One row of the index table; ``tokens`` are each document's words, or their numbers in ``terms``."""
    if terms is None:
        terms = _Terms()
        tokens = [_numbers(terms, words) for words in tokens]
    counts = np.array([len(t) for t in tokens], np.int64)
    ids = np.concatenate(tokens)
    starts = np.concatenate(([0], np.cumsum(counts + GAP)[:-1]))
    places = np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * GAP, counts)
    order = np.argsort(ids, kind="stable")
    places = places[order].astype(np.int64)
    heads = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(terms))))).astype(np.int64)
    steps = np.diff(places, prepend=0)
    if len(terms):
        steps[heads[:-1]] = places[heads[:-1]]
    pack = zstandard.ZstdCompressor(level=1).compress
    return {
        "block": block,
        "keys": keys,
        "texts": texts,
        "starts": starts.astype("<i8").tobytes(),
        "counts": counts.tolist(),
        "terms": pack(b"\n".join(terms)),
        "heads": pack(heads.astype("<i8").tobytes()),
        "postings": pack(steps.astype("<i4").tobytes()),
    }


def _build(block_tokens: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema(
            [
                ("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())),
                ("starts", pa.binary()), ("counts", pa.list_(pa.int64())), ("terms", pa.binary()),
                ("heads", pa.binary()), ("postings", pa.binary()),
            ]
        )
        block = TaskContext.get().partitionId() << 32
        # Words are numbered at once: a block never is there as a Python object per word.
        keys, texts, terms, numbers, held = [], [], _Terms(), [], 0
        for batch in batches:
            for key, mark, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ):
                words = alnum_words(text.as_py())
                keys.append(key)
                texts.append(mark)
                numbers.append(_numbers(terms, words))
                held += len(words) + GAP
                if held >= block_tokens:
                    yield pa.RecordBatch.from_pylist([_block(block, keys, texts, numbers, terms)], schema)
                    block, keys, texts, terms, numbers, held = block + 1, [], [], _Terms(), [], 0
        if keys:
            yield pa.RecordBatch.from_pylist([_block(block, keys, texts, numbers, terms)], schema)

    return build


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """The index of ``docs`` as a table: write it before the first search, search it often.

    Blocks are numbered by the task that builds them, so an index that is worked out anew
    for every use would number them differently.

    A null text has no words; null and repeated ids stay rows of their own. A
    document longer than ``block_tokens`` words is a block by itself.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("key"), text_mark(text_col).alias("mark"), F.col(text_col).alias("text")
    ).mapInArrow(_build(block_tokens), INDEX_SCHEMA)


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    """All runs of ``size`` consecutive words; of a shorter item the whole, of none nothing."""
    if not words:
        return []
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))]


class Probes:
    """Windows of some items as arrays: terms by number, offsets in the window."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        terms = _Terms()
        rows, owners, self.names = [], [], [name for name, _ in items]
        for owner, (_, text) in enumerate(items):
            for window in windows_of(alnum_words(text), size):
                rows.append([terms[w] for w in window])
                owners.append(owner)
        self.terms = list(terms)
        self.owner = np.array(owners, np.int32)
        self.length = np.array([len(r) for r in rows], np.int32)
        self.matrix = np.full((len(rows), size), -1, np.int32)
        for i, row in enumerate(rows):
            self.matrix[i, : len(row)] = row


def _decode(row: dict, probes: Probes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the probed terms: sorted keys (term << 32 | place), list starts and lengths."""
    unpack = zstandard.ZstdDecompressor().decompress
    terms = {t: i for i, t in enumerate(unpack(row["terms"]).split(b"\n"))}
    heads = np.frombuffer(unpack(row["heads"]), "<i8")
    steps = np.frombuffer(unpack(row["postings"]), "<i4").astype(np.int64)
    local = np.array([terms.get(t, -1) for t in probes.terms], np.int64)
    if len(heads) < 2:
        local[:] = -1
    sizes = np.where(local >= 0, heads[local + 1] - heads[local], 0) if len(heads) > 1 else local * 0
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(total) - firsts[owner] + heads[np.maximum(local, 0)][owner]
    run = np.cumsum(steps[at])
    base = np.concatenate(([0], run))[firsts]
    places = run - base[owner]
    return (owner.astype(np.uint64) << TERM_BITS) | places.astype(np.uint64), firsts, sizes


def _near(keys: np.ndarray, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
    """Whether a term stands within ``slop`` of a place."""
    shifted = term.astype(np.uint64) << TERM_BITS
    low = shifted | np.maximum(place - slop, 0).astype(np.uint64)
    found = np.minimum(np.searchsorted(keys, low), max(len(keys) - 1, 0))
    return (keys[found] >= low) & (keys[found] <= (shifted | (place + slop).astype(np.uint64)))


def _matches(row: dict, probes: Probes, slop: int, most: int = 1_000_000):
    """``(window, start, exact)`` arrays of one block, a bounded number of candidates at a time."""
    keys, firsts, sizes = _decode(row, probes)
    grid = np.where(probes.matrix >= 0, sizes[np.maximum(probes.matrix, 0)], np.iinfo(np.int64).max)
    alive = np.nonzero((grid > 0).all(axis=1))[0] if len(grid) else np.empty(0, np.int64)
    if not len(alive):
        return
    order = np.argsort(grid[alive], axis=1, kind="stable")
    loads = grid[alive, order[:, 0]]
    cuts = np.cumsum(loads) // most
    for portion in np.split(np.arange(len(alive)), np.nonzero(np.diff(cuts))[0] + 1):
        rank, load = order[portion], loads[portion]
        who = np.repeat(np.arange(len(portion)), load)
        rarest = probes.matrix[alive[portion], rank[:, 0]]
        within = np.arange(load.sum()) - np.repeat(np.cumsum(load) - load, load)
        places = (keys[np.repeat(firsts[rarest], load) + within] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = places - rank[who, 0]
        held = start >= 0
        who, start = who[held], start[held]
        exact = np.ones(len(who), bool)
        for step in range(1, probes.matrix.shape[1]):
            offset = rank[who, step]
            term = probes.matrix[alive[portion][who], offset]
            void = term < 0
            place = start + offset
            here = void | _near(keys, np.maximum(term, 0), place, 0)
            if slop:
                exact &= here
                here = void | _near(keys, np.maximum(term, 0), place, slop)
            who, start, exact = who[here], start[here], exact[here]
            if not len(who):
                break
        if len(who):
            yield alive[portion][who], start, exact


def _spans(row: dict, probes: Probes, slop: int) -> list[tuple]:
    """Matches of a block as joined spans ``(ordinal, item, start in document, length, exact)``."""
    found = list(_matches(row, probes, slop))
    if not found:
        return []
    window, start, exact = (np.concatenate(x) for x in zip(*found))
    starts = np.frombuffer(row["starts"], "<i8")
    owner, stop = probes.owner[window], start + probes.length[window]
    order = np.lexsort((start, exact, owner))
    spans: list[list] = []
    for o, e, a, b in zip(owner[order].tolist(), exact[order].tolist(), start[order].tolist(), stop[order].tolist()):
        if spans and spans[-1][0] == o and spans[-1][1] == e and a <= spans[-1][3]:
            spans[-1][3] = max(spans[-1][3], b)
        else:
            spans.append([o, e, a, b])
    ordinals = np.searchsorted(starts, [s[2] for s in spans], side="right") - 1
    return [
        (int(n), probes.names[o], int(a - starts[n]), int(b - a), bool(e))
        for n, (o, e, a, b) in zip(ordinals, spans)
    ]


def _search(probes, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = probes.value
        for batch in batches:
            for row in batch.to_pylist():
                if spans := _spans(row, held, slop):
                    ordinal, item, start, length, exact = zip(*spans)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["block"]] * len(spans), pa.int64()), pa.array(ordinal, pa.int32()),
                            pa.array(item, pa.string()), pa.array(start, pa.int32()),
                            pa.array(length, pa.int32()), pa.array(exact, pa.bool_()),
                        ],
                        ["block", "ordinal", "item", "start", "length", "exact"],
                    )

    return search


def search(
    index: DataFrame,
    items: DataFrame,
    window: int = 10,
    slop: int = 0,
    id_col: str = "item_id",
    text_col: str = "text",
    portion_bytes: int = 16 << 20,
) -> DataFrame:
    """Spans of ``index`` that match windows of ``items``: exact ones, and near ones if ``slop``.

    Items are read in portions of at most ``portion_bytes`` of text (an item larger than
    that is one portion). Each portion is sent to all blocks, its spans are written as a table, and
    it is released before the next is read; a null text has no windows.
    """
    spark = index.sparkSession
    lists = index.select("block", "starts", "terms", "heads", "postings")
    found = spark.createDataFrame([], SPAN_SCHEMA)
    for portion in _portions(items.select(F.col(id_col).cast("string"), text_col), portion_bytes):
        probes = spark.sparkContext.broadcast(Probes(portion, window))
        part = lists.mapInArrow(_search(probes, min(slop, GAP - 1)), SPAN_SCHEMA)
        found = found.union(via_table(part, "spans"))
        probes.destroy()
    return found


def _portions(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items ``(name, text)``, a bounded number of bytes at a time."""
    portion: list[tuple[str, str | None]] = []
    held = 0
    for name, text in items.toLocalIterator():
        size = len(utf8(text))
        if portion and held + size > most_bytes:
            yield portion
            portion, held = [], 0
        portion.append((str(name), text))
        held += size
    if portion:
        yield portion


def index_documents(index: DataFrame) -> DataFrame:
    """``(block, ordinal, key, mark, n_words)`` of every indexed document."""
    return index.select(
        "block", F.posexplode(F.arrays_zip("keys", "texts", "counts")).alias("ordinal", "doc")
    ).select(
        "block", "ordinal", F.col("doc.keys").alias("key"), F.col("doc.texts").alias("mark"),
        F.col("doc.counts").alias("n_words"),
    )


def hit_words(spans: DataFrame) -> DataFrame:
    """Per document of exact ``spans``: words inside any span, and the items, sorted as strings."""
    row = Window.partitionBy("block", "ordinal").orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("length") - F.greatest("start", F.coalesce(before, F.lit(0)))
    return (
        spans.where("exact")
        .withColumn("fresh", F.greatest(fresh, F.lit(0)))
        .groupBy("block", "ordinal")
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    slop: int = 0,
) -> DataFrame:
    """``(key, mark, n_words, n_hit, items, near_items)``: one row per row of ``docs``.

    ``items`` have windows that stand in the document word by word; ``near_items`` only
    within ``slop`` places. Null and empty texts have no words and no hits; repeated
    rows each come back; without items nothing is hit; other columns are ignored.
    """
    index = via_table(build_index(docs, id_col, text_col), "index")
    spans = search(index, items, window, slop, item_id, item_text)
    found = hit_words(spans)
    if slop:
        near = spans.where("NOT exact").groupBy("block", "ordinal").agg(F.collect_set("item").alias("near"))
        found = found.join(near, ["block", "ordinal"], "full")
    else:
        found = found.withColumn("near", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    return (
        index_documents(index)
        .join(found, ["block", "ordinal"], "left")
        .select(
            "key", "mark", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", none).alias("items"),
            F.array_sort(F.array_except(F.coalesce("near", none), F.coalesce("items", none))).alias("near_items"),
        )
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without rows that hold an exact window of an item; columns stay as they are.

    The verdict hangs on the text alone, so rows are dropped by id and text hash.
    """
    bad = contamination(docs, items, id_col, text_col, **options).where("n_hit > 0")
    return without(docs, bad.select(F.col("key").alias(f"key_{id_col}"), MARK), text_col)
