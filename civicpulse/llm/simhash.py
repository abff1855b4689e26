"""Near duplicates by SimHash, linked with vantage-point trees over Hamming distance.

Two fingerprints within ``max_distance`` bits agree closely in at least one of a few
disjoint blocks of bits: with block radii r that satisfy sum(r + 1) = max_distance + 1,
some block differs in at most r bits. For each block a vantage-point tree
partitions the fingerprints by their distance, within the block, to a vantage point: what
is nearer than the median goes left, the rest right, and by the triangle bound a
neighbour of a left point lies below median + r, so exactly the right points in
that boundary ring are sent left as well. The top of each tree deals fingerprints out to
shards. It is grown in rounds: of every shard that is still crowded a few points, drawn by hash,
give the vantage points and medians of its next levels (which shapes shards but never results;
the driver sees ``DRAWN`` points a round at most, whatever the number of fingerprints). The rest of
the tree is grown inside each shard, and leaves are compared exactly on all 64 bits.

Equal fingerprints are one row from the start, a leaf returns each linked group as a
star, and a shard that no vantage point splits is cut into blocks that meet in pairs, so no
task sees more than two blocks and no group is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.components import components
from civicpulse.llm.rowkeys import MARK, key_columns, once_each, without
from civicpulse.llm.words import blank_words, by_slices
from civicpulse.session import broadcast_within, via_table

SEED = 42
BITS = 64
LEAF = 96
# Points drawn in a round, of one crowded shard at most, and rounds of growing.
DRAWN = 131_072
DRAWN_OF_SHARD = 4_096
ROUNDS = 12
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_BYTE_AT = np.arange(8) * 256


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of one text; zero for a text without words."""
    words = blank_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, stops[shingle - 1 :])]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = counts.ravel() * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column | str, shingle: int = 4) -> Column:
    """SimHash of a text column as a signed long (the same 64 bits)."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return by_slices(
            texts, lambda some: pa.array(np.array([fingerprint(t, shingle) for t in some], np.uint64).view(np.int64))
        )

    return simhash(text)


def hex_fingerprint(column: Column | str) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def block_plan(max_distance: int, blocks: int = 3) -> list[tuple[int, int]]:
    """``(mask, radius)`` of each block of bits."""
    blocks = min(blocks, max_distance + 1)
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    base, more = divmod(max_distance + 1, blocks)
    return [
        (((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i], base - 1 + (i < more))
        for i in range(blocks)
    ]


def _grow(sample: np.ndarray, mask: int, radius: int, depth: int, rng) -> dict | None:
    """The top of a tree: nested nodes, None for a shard."""
    if depth == 0 or len(sample) < 8:
        return None
    vantage = sample[rng.integers(len(sample))]
    away = np.bitwise_count((sample ^ vantage) & np.uint64(mask))
    middle = int(np.median(away))
    left, right = sample[away < middle + radius], sample[away >= middle]
    if len(left) == len(sample) or len(right) == len(sample):
        return None
    return {
        "vantage": vantage,
        "middle": middle,
        "left": _grow(left, mask, radius, depth - 1, rng),
        "right": _grow(right, mask, radius, depth - 1, rng),
    }


def _deal(node: dict | None, points: np.ndarray, mask: int, radius: int, code: int, out: list):
    """Append ``(shard code, points)`` of every shard that points fall into."""
    if not len(points):
        return
    if node is None:
        out.append((code, points))
        return
    away = np.bitwise_count((points ^ node["vantage"]) & np.uint64(mask))
    _deal(node["left"], points[away < node["middle"] + radius], mask, radius, 2 * code, out)
    _deal(node["right"], points[away >= node["middle"]], mask, radius, 2 * code + 1, out)


def _flood(points: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Linked groups of a crowded leaf: each point meets only what is not yet reached."""
    rest = points
    while len(rest):
        root, rest = rest[0], rest[1:]
        group, queue = [], [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= reach
            if near.any():
                found = rest[near]
                rest = rest[~near]
                group.append(found)
                queue.extend(found)
        if group:
            yield np.concatenate(group), root


def _small(points: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Linked groups of a leaf by its distance matrix."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= reach
    if near.sum() == len(points):
        return
    label = np.arange(len(points))
    while True:
        lower = np.where(near, label[None, :], len(points)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    for root in np.unique(label):
        members = points[(label == root) & (np.arange(len(points)) != root)]
        if len(members):
            yield members, points[root]


def links_within(points: np.ndarray, mask: int, radius: int, reach: int) -> list[tuple]:
    """Stars ``(members, root)`` that connect all points linked inside one shard."""
    rng = np.random.default_rng(7)
    found: list[tuple] = []
    stack = [np.unique(points)]
    while stack:
        here = stack.pop()
        if len(here) <= LEAF:
            found.extend(_small(here, reach))
            continue
        for _ in range(3):
            vantage = here[rng.integers(len(here))]
            away = np.bitwise_count((here ^ vantage) & np.uint64(mask))
            middle = max(1, int(np.median(away)))
            left, right = here[away < middle + radius], here[away >= middle]
            if max(len(left), len(right)) <= 0.9 * len(here):
                stack.extend((left, right))
                break
        else:
            found.extend(_flood(here, reach))
    return found


def _shard_rows(trees: list, plan: list[tuple[int, int]]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (tree, (mask, radius)) in enumerate(zip(trees, plan)):
                out: list = []
                _deal(tree, points, mask, radius, 1, out)
                for code, held in out:
                    shard = np.full(len(held), (code << 8) | part, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard), pa.array(held.view(np.int64))], ["shard", "point"]
                    )

    return deal


def _shard_sizes(trees: list, plan: list[tuple[int, int]]):
    """As ``_shard_rows``, but only how many points of a batch fall into each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows: dict[int, int] = {}
            for part, (tree, (mask, radius)) in enumerate(zip(trees, plan)):
                out: list = []
                _deal(tree, points, mask, radius, 1, out)
                rows |= {(code << 8) | part: len(held) for code, held in out}
            yield pa.RecordBatch.from_arrays(
                [pa.array([*rows], pa.int64()), pa.array([*rows.values()], pa.int64())], ["shard", "rows"]
            )

    return count


def _sizes(points: DataFrame, trees: list, plan: list[tuple[int, int]]) -> DataFrame:
    """``(shard, rows)`` of all shards; points are counted where they are dealt."""
    counted = points.mapInArrow(_shard_sizes(trees, plan), "shard long, rows long")
    return counted.groupBy("shard").agg(F.sum("rows").alias("rows"))


def _extended(tree: dict | None, code: int, grown: dict) -> dict:
    """``tree`` with ``grown`` in place of the shard that ``code`` leads to."""
    if code == 1:
        return grown
    top = code.bit_length() - 2
    side = "right" if (code >> top) & 1 else "left"
    return {**tree, side: _extended(tree[side], (1 << top) | (code & ((1 << top) - 1)), grown)}


def _grown(points: DataFrame, plan: list[tuple[int, int]], shard_rows: int) -> list[dict | None]:
    """A tree top per block of bits, under which shards hold about ``shard_rows`` points."""
    spark, trees, stuck = points.sparkSession, [None] * len(plan), set()
    rng = np.random.default_rng(11)
    for _ in range(ROUNDS):
        sizes = _sizes(points, trees, plan).where(F.col("rows") > 2 * shard_rows)
        # The largest first; the others have their turn in a later round.
        sizes = sizes.where(~F.col("shard").isin(*stuck)) if stuck else sizes
        crowded = sizes.orderBy(F.desc("rows"), "shard").limit(DRAWN // 256).collect()
        if not crowded:
            break
        most = min(DRAWN_OF_SHARD, DRAWN // len(crowded))
        # A sixteenth of a shard at most: small sets are not drawn whole either.
        shares = [(r.shard, min(1 / 16, most / r.rows)) for r in crowded]
        lot = F.pmod(F.xxhash64("point"), F.lit(1 << 30))
        # Points that no shard draws are left out before they are dealt.
        some = points.where(lot < max(share for _, share in shares) * (1 << 30))
        dealt = some.mapInArrow(_shard_rows(trees, plan), "shard long, point long")
        shares = F.broadcast(spark.createDataFrame(shares, "shard long, share double"))
        drawn = dealt.join(shares, "shard").where(lot < F.col("share") * (1 << 30))
        found = drawn.select("shard", "point").toPandas()
        for row in crowded:
            part, code = row.shard & 255, row.shard >> 8
            sample = found["point"][found["shard"] == row.shard].to_numpy(np.int64).view(np.uint64)
            depth = int(np.ceil(np.log2(row.rows / shard_rows)))
            depth = min(depth, max(1, int(np.log2(max(len(sample), 1) / 32))))
            grown = _grow(sample, *plan[part], depth, rng)
            if grown is None:
                stuck.add(row.shard)
            else:
                trees[part] = _extended(trees[part], code, grown)
    return trees


def links(
    points: DataFrame,
    max_distance: int = 4,
    shard_rows: int = 20_000,
    blocks: int = 3,
) -> DataFrame:
    """``(a, b)`` edges that connect all fingerprints within ``max_distance`` bits.

    ``points`` has one column of distinct signed longs. Edges form stars, so the edge
    count stays below the rows dealt out; their components are those of all pairs.
    """
    points = points.toDF("point")
    plan = block_plan(max_distance, blocks)
    trees = _grown(points, plan, shard_rows)
    dealt = points.mapInArrow(_shard_rows(trees, plan), "shard long, point long")
    crowded = (
        _sizes(points, trees, plan)
        .where(F.col("rows") > 4 * shard_rows)
        .select("shard", F.ceil(F.col("rows") / (2 * shard_rows)).cast("long").alias("cuts"))
    )
    crowded = broadcast_within(via_table(crowded, "crowded"))
    cut = F.pmod(F.xxhash64("point"), F.col("cuts"))
    pairs = F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1),
            lambda other: F.least(cut, other) * F.col("cuts") + F.greatest(cut, other),
        )
    )
    lanes = dealt.join(crowded, "shard", "left").select("shard", F.explode(pairs).alias("lane"), "point")

    def link(table: pa.Table) -> pa.Table:
        held = table.column("point").to_numpy().view(np.uint64)
        mask, radius = plan[table.column("shard")[0].as_py() & 255]
        stars = links_within(held, mask, radius, max_distance)
        a = np.concatenate([m for m, _ in stars]) if stars else np.empty(0, np.uint64)
        b = np.concatenate([np.full(len(m), r) for m, r in stars]) if stars else np.empty(0, np.uint64)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return lanes.groupBy("shard", "lane").applyInArrow(link, "a long, b long").distinct()


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_distance: int = 4,
    keep: list[str] | None = None,
) -> DataFrame:
    """``(id, fingerprint, group, component, *keep)``: one row per row of ``docs``.

    ``fingerprint`` and ``group`` (the fingerprint that stands for all linked ones) are
    signed longs, ``component`` is the smallest id reachable over links.
    Null and empty texts have fingerprint zero and link like any other; null ids take
    part but never name a component unless all its ids are null; repeated rows each
    come back; an empty table gives an empty table; other columns are ignored.
    """
    prints = via_table(
        docs.select(
            F.col(id_col).alias("id"),
            fingerprint_column(F.col(text_col), shingle).alias("fingerprint"),
            *[F.col(c).alias(f"keep_{c}") for c in keep or []],
        ),
        "prints",
    )
    points = via_table(
        prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "points"
    )
    roots = components(links(points.select("fingerprint"), max_distance))
    rooted = points.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(lowest, "root").select(
        "fingerprint", F.col("root").alias("group"), "component"
    )
    return prints.join(named, "fingerprint").select(
        "id", "fingerprint", "group", "component", *[F.col(f"keep_{c}").alias(c) for c in keep or []]
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (nulls last).

    Ties between different texts of one id go to the lower text hash, of rows that repeat id
    and text any one stays. Columns stay as they are.
    """
    keyed = docs.select(*key_columns([id_col], text_col), F.col(id_col), F.col(text_col).alias("__text"))
    groups = near_duplicate_groups(keyed, id_col, "__text", keep=[MARK], **options)
    keys = via_table(groups.groupBy("group", "id", MARK).agg(F.count("*").alias("copies")), "keys")
    first = keys.groupBy("group").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", MARK)).alias("first")
    )
    judged = keys.join(first, "group").withColumn(
        "stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col(MARK) == F.col(f"first.{MARK}"))
    )
    key = [F.col("id").alias(f"key_{id_col}"), F.col(MARK)]
    # Rows that repeat id and text are taken out of the main scan and come back once.
    apart = judged.where("NOT stays OR copies > 1").select(*key)
    repeated = judged.where("stays AND copies > 1").select(*key)
    return without(docs, apart, text_col).unionByName(once_each(docs, repeated, text_col))
