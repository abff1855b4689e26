"""SimHash groups and the positional index against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from civicpulse.llm import simhash
from civicpulse.llm.components import components
from civicpulse.llm.positional import Probes, _block, _spans, contamination, drop_contaminated
from civicpulse.llm.simhash import (
    block_plan, drop_near_duplicates, fingerprint, hex_fingerprint, links, links_within, near_duplicate_groups,
)
from civicpulse.session import via_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points, reach=4):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= reach:
                root[find(a)] = find(b)
    groups = {}
    for p in points:
        groups.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "A b C d e f g a b c d", "ß É x y z w " * 9])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    text = "the cat sat on"
    row = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(text, 42)


@pytest.mark.parametrize("reach", range(0, 9))
def test_blocks_leave_no_pair_out(reach):
    plan = block_plan(reach)
    assert sum(r + 1 for _, r in plan) == reach + 1
    assert sum(m.bit_count() for m, _ in plan) == 64


def clustered(seed, centres=60, near=12):
    rng = np.random.default_rng(seed)
    points = set()
    for centre in rng.integers(0, 1 << 63, centres).tolist():
        for _ in range(near):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            points.add(centre ^ sum(1 << int(f) for f in flips))
    return sorted(points)


def test_links_connect_what_brute_force_connects(spark):
    points = clustered(3)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "p bigint")
    # Small shards: several levels of trees, crowded shards cut into pairs of blocks.
    edges = links(frame, 4, shard_rows=20)
    found = components(edges).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(int(np.int64(r.node).view(np.uint64)))
    want = [g for g in slow_components(points) if len(g) > 1]
    assert sorted(map(sorted, groups.values())) == want


def test_trees_grow_in_rounds_from_few_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 1 << 62, 6000))
    frame = spark.createDataFrame([(int(p),) for p in points], "point bigint")
    monkeypatch.setattr(simhash, "DRAWN_OF_SHARD", 64)
    plan = block_plan(4)
    trees = simhash._grown(frame, plan, 400)
    held = frame.mapInArrow(simhash._shard_rows(trees, plan), "shard long, point long")
    sizes = [r["count"] for r in held.groupBy("shard").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 2400
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    assert simhash._grown(frame, plan, 400) == [None] * 3


def test_crowded_leaf_is_not_expanded_into_pairs():
    base = 0x0123456789ABCDEF
    points = np.array([base ^ (1 << i) ^ (1 << j) for i in range(22, 64) for j in range(22, i + 1)], np.uint64)
    mask, radius = block_plan(4)[0]
    stars = links_within(points, mask, radius, 4)
    assert sum(len(m) for m, _ in stars) < 3 * len(points)
    assert len({int(x) for m, r in stars for x in [*m, r]}) == len(np.unique(points))


def test_groups_and_kept_rows(docs, nothing):
    got = near_duplicate_groups(docs).select("id", hex_fingerprint("fingerprint").alias("f"), "component").collect()
    assert len(got) == docs.count()
    texts = docs.collect()
    want = {r.doc_id: f"{slow_fingerprint(r.text):016x}" for r in texts}
    assert all(r.f == want[r.id] for r in got)
    by = {r.id: r.component for r in got}
    assert by[1] == by[6] == 1 and by[2] == by[3] == by[4] == 2 and by[None] is None
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 9, 10]
    assert near_duplicate_groups(nothing).count() == 0 and drop_near_duplicates(nothing).count() == 0


ITEMS = [
    ("i1", "the cat sat on the mat and looked at the moon, the cat"),
    ("i2", None),
    ("i3", " . "),
    ("i4", "one"),
    ("i5", "Die KATZE gehen nach Hause"),
    ("i6", "cat on sat the mat the and looked moon at"),
]


def slow_hits(text, items, size=10):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        terms = ALNUM.findall(lower(item))
        for i in range(max(1, len(terms) - size + 1)) if terms else []:
            window = terms[i : i + size]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(name)
    return len(words), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = contamination(docs, items, slop=3).collect()
    want = sorted((r.doc_id or -1, *slow_hits(r.text, ITEMS)) for r in docs.collect())
    assert sorted((r.key or -1, r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert "i6" in next(r for r in got if r.key == 1).near_items  # same words, other order
    clean = drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == [2, 3, 4, 5, 9]
    assert contamination(nothing, items).count() == 0
    assert {r.n_hit for r in contamination(docs, items.limit(0)).collect()} == {0}


def test_portions_of_items_give_the_same(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    whole = contamination(docs, items).select("key", "n_hit").collect()
    from civicpulse.llm import positional

    index = via_table(positional.build_index(docs, block_tokens=50))
    spans = positional.search(index, items, portion_bytes=5)
    hits = positional.index_documents(index).join(positional.hit_words(spans), ["block", "ordinal"], "left")
    assert sorted((r.key or -1, r.n_hit or 0) for r in hits.collect()) == sorted((r.key or -1, r.n_hit) for r in whole)


def test_random_texts_by_block():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcd"), rng.integers(0, 40))) for _ in range(60)]
    items = [(str(i), " ".join(rng.choice(list("abcd"), rng.integers(0, 9)))) for i in range(8)]
    row = _block(0, list(range(60)), [0] * 60, [t.encode().split() for t in texts])
    hit = {}
    for ordinal, item, start, length, exact in _spans(row, Probes(items, 5), 0):
        hit.setdefault(ordinal, [set(), set()])
        hit[ordinal][0].update(range(start, start + length))
        hit[ordinal][1].add(item)
    for i, text in enumerate(texts):
        words, found = hit.get(i, [set(), set()])
        assert (len(words), sorted(found)) == slow_hits(text, items, 5)[1:]


def test_blocks_are_built_of_numbers(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from civicpulse.llm import positional

    class Task:
        def partitionId(self):
            return 3

    texts = ["a b a", None, "b c", "", "c c c a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([7] * 5), pa.array(texts)], ["key", "mark", "text"])
    held, plain = [], positional._block
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task()))
    monkeypatch.setattr(positional, "_block", lambda *a: held.append(a) or plain(*a))
    for most in (1, 130, 1 << 20):
        held.clear()
        built = [r for b in positional._build(most)(iter([batch])) for r in b.to_pylist()]
        assert all(isinstance(n, np.ndarray) for a in held for n in a[3])
        at = 0
        for number, row in enumerate(built):
            n = len(row["keys"])
            words = [(t or "").encode().split() for t in texts[at : at + n]]
            assert row == plain((3 << 32) + number, list(range(at, at + n)), [7] * n, words)
            at += n
        assert at == 5


def test_shards_are_counted_where_points_are_dealt(spark):
    values = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 3000).tolist()
    points = spark.createDataFrame([(v,) for v in values], "point long").repartition(3)
    plan = block_plan(4)
    trees = simhash._grown(points, plan, 200)
    dealt = points.mapInArrow(simhash._shard_rows(trees, plan), "shard long, point long")
    want = {(r.shard, r["count"]) for r in dealt.groupBy("shard").count().collect()}
    assert len(want) > 3 and {(r.shard, r.rows) for r in simhash._sizes(points, trees, plan).collect()} == want
    counted = points.mapInArrow(simhash._shard_sizes(trees, plan), "shard long, rows long")
    assert counted.count() <= 3 * len(want)
