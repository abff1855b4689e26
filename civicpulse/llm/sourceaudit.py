"""Source divergence audit: how term shares differ between the sources of a language.

Terms are counted by single-pass in-memory indexing. A task numbers the terms of its
documents as it reads them and keeps their numbers as a block until the block is full; then
postings (term, language, source) are counted, sorted by hash shard and term, and spilled as
a run cut into pieces. The pieces of all runs go to their shard in order of their first
terms, where a heap merges them: a piece is opened when the merge reaches it, so a task holds
one piece a run however long the runs are. What comes out are the frequencies of the
kept terms, written as a table.

Every kept term has a share in every source, though most occur in few. A pair of sources is
therefore summed as if no term occurred in either, plus corrections: for terms of one,
which hang on the count alone and come from a small table of counts, and for terms of
both, which are streamed from the frequencies by term. All arithmetic is on whole numbers.

The sources of one language are expected to be as many as their pairs can be written out.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.llm.words import utf8
from civicpulse.session import broadcast_within, via_table

SCALE = 1_000_000_000
BLOCK_TOKENS = 2_000_000
PIECE_TERMS = 2048
PAIRS_AT_ONCE = 1_000_000
HELD_PAIRS = 500_000
RUN_SCHEMA = "shard int, first binary, names string, terms binary, entries binary, postings binary"
FREQUENCY_SCHEMA = "lang string, term string, df long, sources array<string>, counts array<long>"


def _letters_table() -> bytes:
    """A-Z to a-z; all ASCII but letters to a blank; the rest as it is."""
    table = bytearray(range(256))
    for code in range(128):
        char = chr(code)
        table[code] = ord(char.lower()) if char.isalpha() else 0x20
    return bytes(table)


LETTERS = _letters_table()


def letter_terms(text: str | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return utf8(text).translate(LETTERS).split()


class _Numbers(dict):
    """Numbers in order of first sight."""

    def __missing__(self, name) -> int:
        self[name] = number = len(self)
        return number


class Block:
    """Postings of some documents, until they are spilled as a run."""

    def __init__(self):
        self.terms, self.groups = _Numbers(), _Numbers()
        self.ids: list[np.ndarray] = []
        self.owners: list[int] = []
        self.tokens = 0

    def add(self, text: str | None, lang: str, source: str) -> None:
        words = letter_terms(text)
        self.ids.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.owners.append(self.groups[lang, source])
        self.tokens += len(words)

    def run(self, shards: int, piece_terms: int) -> Iterator[dict]:
        """The block's postings as pieces, ascending by (shard, term, language)."""
        names = np.array([*self.terms, b""], object)[:-1]
        shard = np.fromiter((zlib.crc32(t) % shards for t in self.terms), np.int64, len(names))
        order = np.argsort(names, kind="stable")
        order = order[np.argsort(shard[order], kind="stable")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        groups = sorted(self.groups)
        langs = sorted({lang for lang, _ in groups})
        at_group = np.empty(len(groups), np.int64)
        for new, group in enumerate(groups):
            at_group[self.groups[group]] = new
        lang_of = np.array([langs.index(lang) for lang, _ in groups], np.int64)

        lengths = np.array([len(i) for i in self.ids])
        term = place[np.concatenate(self.ids)] if len(order) else np.empty(0, np.int64)
        owner = at_group[np.array(self.owners, np.int64)]
        docs = len(lengths)
        once = np.unique(term * docs + np.repeat(np.arange(docs), lengths))
        entry, df = np.unique(once // docs * len(langs) + lang_of[owner[once % docs]], return_counts=True)
        posting, count = np.unique(term * len(groups) + np.repeat(owner, lengths), return_counts=True)
        of_term, of_group = np.divmod(posting, len(groups))
        head = np.searchsorted(of_term * len(langs) + lang_of[of_group], entry)
        heads = np.append(head, len(posting))
        entry_term, entry_lang = np.divmod(entry, len(langs))

        sorted_shard = shard[order]
        cuts = np.unique(np.concatenate((np.arange(0, len(order), piece_terms), np.nonzero(np.diff(sorted_shard))[0] + 1)))
        pack = zstandard.ZstdCompressor(level=1).compress
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            if a == b:
                continue
            lo, hi = np.searchsorted(entry_term, [a, b])
            part = slice(heads[lo], heads[hi])
            used, local = np.unique(of_group[part], return_inverse=True)
            entries = np.stack([entry_term[lo:hi] - a, entry_lang[lo:hi], df[lo:hi], np.diff(heads[lo : hi + 1])])
            yield {
                "shard": int(sorted_shard[a]), "first": names[order[a]],
                "names": json.dumps([langs, [groups[g][1] for g in used]]),
                "terms": pack(b"\n".join(names[order[a:b]])),
                "entries": pack(entries.astype("<i8").tobytes()),
                "postings": pack(np.stack([local, count[part]]).astype("<i8").tobytes()),
            }


def _entries(row: dict) -> Iterator[tuple]:
    """``(term, lang, df, sources, counts)`` of a piece, ascending."""
    unpack = zstandard.ZstdDecompressor().decompress
    terms = unpack(row["terms"]).split(b"\n")
    langs, sources = json.loads(row["names"])
    term, lang, df, size = np.frombuffer(unpack(row["entries"]), "<i8").reshape(4, -1).tolist()
    source, count = np.frombuffer(unpack(row["postings"]), "<i8").reshape(2, -1).tolist()
    at = 0
    for t, g, d, n in zip(term, lang, df, size):
        yield terms[t], langs[g], d, [sources[s] for s in source[at : at + n]], count[at : at + n]
        at += n


def _runs(shards: int, block_tokens: int, piece_terms: int):
    schema = pa.schema(
        [
            ("shard", pa.int32()), ("first", pa.binary()), ("names", pa.string()), ("terms", pa.binary()),
            ("entries", pa.binary()), ("postings", pa.binary()),
        ]
    )

    def spilled(block: Block) -> Iterator[pa.RecordBatch]:
        pieces = []
        for piece in block.run(shards, piece_terms):
            pieces.append(piece)
            if len(pieces) == 256:
                yield pa.RecordBatch.from_pylist(pieces, schema)
                pieces = []
        if pieces:
            yield pa.RecordBatch.from_pylist(pieces, schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(text.as_py(), lang, source)
                if block.tokens >= block_tokens:
                    yield from spilled(block)
                    block = Block()
        if block.tokens:
            yield from spilled(block)

    return runs


def merged(pieces: Iterator[dict]) -> Iterator[tuple[str, str, int, dict[str, int]]]:
    """``(lang, term, df, counts by source)`` of pieces that come by (shard, first term)."""
    heap: list[tuple] = []
    upcoming, number = next(pieces, None), 0
    while heap or upcoming is not None:
        while upcoming is not None and (not heap or (upcoming["shard"], upcoming["first"]) <= heap[0][:2]):
            entries = _entries(upcoming)
            term, lang, *rest = next(entries)
            heapq.heappush(heap, (upcoming["shard"], term, lang, number, rest, entries))
            upcoming, number = next(pieces, None), number + 1
        shard, term, lang, *_ = heap[0]
        total, counts = 0, {}
        while heap and heap[0][:3] == (shard, term, lang):
            *_, at, (df, sources, found), entries = heap[0]
            total += df
            for source, count in zip(sources, found):
                counts[source] = counts.get(source, 0) + count
            after = next(entries, None)
            if after is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (shard, after[0], after[1], at, after[2:], entries))
        yield lang, term.decode("utf-8", "replace"), total, counts


def _frequencies(min_docs: int, rows_at_once: int = 4096):
    types = pa.schema(
        [
            ("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()),
            ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
        ]
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

        for lang, term, df, counts in merged(row for b in batches for row in b.to_pylist()):
            if df >= min_docs:
                rows.append((lang, term, df, [*counts], [*counts.values()]))
                if len(rows) >= rows_at_once:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    return frequencies


def term_frequencies(
    docs: DataFrame,
    min_docs: int = 3,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    shards: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    piece_terms: int = PIECE_TERMS,
) -> DataFrame:
    """``(lang, term, df, sources, counts)`` of the terms in at least ``min_docs`` documents of a language."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang_col), none).alias("lang"), F.coalesce(F.col(source_col), none).alias("source"),
        F.coalesce(F.col(text_col), none).alias("text"),
    )
    runs = rows.mapInArrow(_runs(shards, block_tokens, piece_terms), RUN_SCHEMA)
    dealt = runs.repartition("shard").sortWithinPartitions("shard", "first")
    return dealt.mapInArrow(_frequencies(min_docs), FREQUENCY_SCHEMA)


def _share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (n + v))``; null without terms."""
    return F.when(v > 0, F.call_function(
        "div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (n + v).cast("decimal(20,0)")
    ) + 1)


def _divergence(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


class _Sums:
    """Exact sums by (language, source, other source), given back when there are many."""

    def __init__(self):
        self.names, self.held = _Numbers(), {}

    def add(self, first: np.ndarray, second: np.ndarray, value: np.ndarray) -> None:
        code = (first << 32) | second
        order = np.argsort(code, kind="stable")
        code, value = code[order], value[order]
        heads = np.nonzero(np.diff(code, prepend=-1))[0]
        for key, total in zip(code[heads].tolist(), np.add.reduceat(value, heads).tolist()):
            self.held[key] = self.held.get(key, 0) + total

    def rows(self) -> pa.RecordBatch:
        names = [*self.names]
        first, second = [k >> 32 for k in self.held], [k & 0xFFFFFFFF for k in self.held]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([names[a][0] for a in first], pa.string()), pa.array([names[a][1] for a in first], pa.string()),
                pa.array([names[b][1] for b in second], pa.string()), pa.array([*self.held.values()], pa.int64()),
            ],
            ["lang", "source", "item", "value"],
        )
        self.__init__()
        return batch


def shared_corrections(term: np.ndarray, group: np.ndarray, p: np.ndarray, rest: np.ndarray):
    """``(first, second, value)`` of all ordered pairs of sources that share a term, in bounded portions.

    Postings lie by ``term``; ``p`` is a posting's share and ``rest`` that of a term its source lacks.
    """
    heads = np.nonzero(np.diff(term, prepend=-1))[0]
    sizes = np.diff(np.append(heads, len(term)))
    partners, start = np.repeat(sizes, sizes), np.repeat(heads, sizes)
    begun = np.cumsum(partners) - partners
    for lo, hi in _portions(begun, PAIRS_AT_ONCE):
        one = np.repeat(np.arange(lo, hi), partners[lo:hi])
        two = np.arange(len(one)) - (begun[one] - begun[lo]) + start[one]
        other = one != two
        one, two = one[other], two[other]
        a, b, a0, b0 = p[one], p[two], rest[one], rest[two]
        value = (a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0
        yield group[one], group[two], value


def _portions(begun: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    cuts = np.nonzero(np.diff(begun // size))[0] + 1
    bounds = [0, *cuts.tolist(), len(begun)]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if a < b)


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    held: list[pa.RecordBatch] = []

    def add(table: pa.Table) -> None:
        terms = table.column("term").combine_chunks()
        langs = table.column("lang").combine_chunks()
        fresh = np.ones(len(terms), bool)
        if len(terms) > 1:
            same = pa.compute.and_(pa.compute.equal(terms[1:], terms[:-1]), pa.compute.equal(langs[1:], langs[:-1]))
            fresh[1:] = ~same.to_numpy(zero_copy_only=False)
        names = zip(langs.to_pylist(), table.column("source").to_pylist())
        group = np.fromiter((sums.names[n] for n in names), np.int64, len(terms))
        p, rest = table.column("p").to_numpy(), table.column("rest").to_numpy()
        for portion in shared_corrections(np.cumsum(fresh), group, p, rest):
            sums.add(*portion)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = table.num_rows - 1
        term, lang = table.column("term"), table.column("lang")
        other = pa.compute.or_(pa.compute.not_equal(term, term[last]), pa.compute.not_equal(lang, lang[last]))
        at = np.nonzero(other.to_numpy())[0]
        if len(at):  # the last term may go on in the next batch
            add(table.slice(0, at[-1] + 1))
            held = table.slice(at[-1] + 1).to_batches()
        if len(sums.held) >= HELD_PAIRS:
            yield sums.rows()
    if held:
        add(pa.Table.from_batches(held))
    if sums.held:
        yield sums.rows()


def source_audit(
    docs: DataFrame,
    min_docs: int = 3,
    most_terms: int = 200,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    **indexing,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by divergence, terms above their language.

    Part ``pair`` has every other source of the language, also for sources without a kept
    term; part ``term`` the first ``most_terms`` terms whose share is above that in the language.
    Null texts, languages and sources are empty strings; repeated rows are documents like
    any other; an empty table gives none; other columns are ignored.
    """
    kept = via_table(term_frequencies(docs, min_docs, text_col, lang_col, source_col, **indexing), "frequencies")
    none = F.lit("")
    seen = docs.select(
        F.coalesce(F.col(lang_col), none).alias("lang"), F.coalesce(F.col(source_col), none).alias("source")
    ).distinct()
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    postings = kept.select(
        "lang", "term", total.alias("total"), F.explode(F.arrays_zip("sources", "counts")).alias("x")
    ).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(total).alias("lang_n"))
    zero = F.lit(0).cast("long")
    groups = via_table(
        seen.join(sums, ["lang", "source"], "left").join(broadcast_within(via_table(langs, "languages")), "lang", "left").select(
            "lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"),
            F.coalesce("lang_n", zero).alias("lang_n"),
        ).withColumn("rest", _share(zero, F.col("n"), F.col("v"))),
        "groups",
    )
    near = broadcast_within(groups)
    known = postings.join(near, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))

    above = known.withColumn("q", _share(F.col("total"), F.col("lang_n"), F.col("v"))).where("p > q")
    terms = above.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _divergence(F.col("p"), F.col("q")).alias("value"),
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)

    other = near.select("lang", F.col("source").alias("item"), F.col("rest").alias("item_rest"))
    apart = F.col("source") != F.col("item")
    bare = _divergence(F.col("rest"), F.col("item_rest"))
    blank = groups.join(other, "lang").where(apart).select(
        "lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * bare).otherwise(0).alias("value")
    )
    counts = known.groupBy("lang", "source", "p", "rest").agg(F.count("*").alias("k"))
    single = counts.join(other, "lang").where(apart)
    own = single.select(
        "lang", "source", "item", (F.col("k") * (_divergence(F.col("p"), F.col("item_rest")) - bare)).alias("value")
    )
    theirs = single.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"),
        (F.col("k") * (_divergence(F.col("item_rest"), F.col("p")) - _divergence(F.col("item_rest"), F.col("rest")))).alias("value"),
    )
    shared = (
        known.select("lang", "term", "source", "p", "rest")
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(_corrected, "lang string, source string, item string, value long")
    )
    pairs = blank.unionByName(own).unionByName(theirs).unionByName(shared)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank")
    )
    return pairs.unionByName(terms)
