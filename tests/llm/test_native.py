"""Hilbert shards and license scans against brute force; their plans hold no Python."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from civicpulse.llm.hilbert import hilbert_index, hilbert_shards, value_bounds
from civicpulse.llm.licenses import license_report, scan_licenses, signature_rules
from helpers import plan_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 1), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = [F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1) for i in range(n)]
    rows = spark.range(1 << (n * bits)).select(hilbert_index(cells, bits).alias("h"), F.array(*cells).alias("c"))
    path = [r.c for r in sorted(rows.collect(), key=lambda r: r.h)]
    assert sorted(r.h for r in rows.collect()) == list(range(1 << (n * bits)))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def test_shards_of_awkward_rows(spark, docs, nothing):
    def shard(frame, n=4):
        rows = frame.select("*", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("same"))
        sizes = {"size": F.length("text"), "lang": F.col("lang"), "source": F.col("source")}
        return hilbert_shards(rows, sizes, n, group="same", tie=("doc_id",))

    got = shard(docs).collect()
    assert len(got) == docs.count()
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert set(counts) == {0, 1, 2, 3}
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    ranked = sorted(got, key=lambda r: (r.shard, r.slot))
    order = [r.same for r in ranked]
    assert all(order[i] == order[i + 1] for i in range(len(order) - 1) if order[i] in order[i + 1 :])  # copies lie together
    assert shard(nothing).count() == 0
    few = shard(docs.limit(2), 16).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}
    assert not re.search("Python|Pandas|Arrow", plan_text(shard(docs)))


def test_shards_prune_every_dimension(spark):
    rows = spark.range(4096).select(F.col("id") % 64, F.floor(F.col("id") / 64)).toDF("x", "y")
    shards = hilbert_shards(rows, {"x": F.col("x"), "y": F.col("y")}, 16, tie=("x", "y"))
    spans = shards.groupBy("shard").agg((F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy")).collect()
    assert len(spans) == 16 and max(max(r.dx, r.dy) for r in spans) <= 32  # half of either side


TEXTS = [
    (1, "Released under the MIT License."), (2, None), (3, ""), (4, "mit License, MIT\nlicense and the Apache License, Version 2.0"),
    (5, "This work is licensed under the GNU General Public License, version 3."), (6, "SPDX-License-Identifier: BSD-3-Clause"),
    (7, "Licensed under CC BY-NC 4.0."), (8, "We permit licenses; admit license."), (8, "We permit licenses; admit license."),
    (9, "no notice at all"), (10, "see https://www.apache.org/licenses/LICENSE-2.0 for the license " * 40), (None, "All rights reserved."),
]


def slow_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def test_base_places_and_labels(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("row", F.lit("clash"))
    got = license_report(frame)
    rows = got.collect()
    want = sorted((d or 0, *map(str, slow_base(t))) for d, t in TEXTS)
    assert sorted((r.doc_id or 0, *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows) == want
    labels = {r.doc_id: (r.labels, r.score) for r in rows}
    assert labels[1] == ("mit", 0.9) and labels[5] == ("gpl,gpl-3.0", 0.9) and labels[6] == ("bsd-3-clause", 1.0)
    assert labels[7] == ("cc-by-nc", 0.9) and labels[9] == labels[2] == labels[3] == ("", 0.0)
    assert labels[8][1] == 0 and labels[None] == ("proprietary", 0.8) and labels[10][0] == "apache-2.0"
    assert all(0 <= r.score <= 1 for r in rows)
    assert license_report(frame.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", plan_text(got))


def test_detections_are_intervals_without_contained_ones(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    _, found = scan_licenses(frame)
    docs, _ = scan_licenses(frame)
    ids = {r.row: r.id for r in docs.collect()}
    texts = dict(TEXTS)
    got = {}
    for r in found.collect():
        got.setdefault(ids[r.row], []).append((r.start, r.stop, r.priority))
        assert 0 <= r.start < r.stop <= len(texts[ids[r.row]])
    for spans in got.values():
        for i, a in enumerate(spans):
            assert not any(b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and b != a for j, b in enumerate(spans) if j != i)


def test_every_rule_is_gated_by_what_it_implies():
    rules = signature_rules()
    assert len(rules) > 200
    from civicpulse.llm.licenses import GATE

    for rule in rules:
        re.compile(rule.regex)
    gate = re.compile(GATE)
    for sample in ("spdx-license-identifier: mit", "mit license", "licensed under gpl", "public domain", "all rights reserved", "creativecommons.org/licenses/by/4.0"):
        assert gate.search(sample)
    assert zlib.crc32(b"") == 0


def test_phrases_of_ones_own_pass_the_gate(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    docs, _ = scan_licenses(frame, phrases={"notice at all": "none"})
    assert [(r.id, [p.word for p in r.places]) for r in docs.where("size(places) > 0").collect()] == [(9, [1])]


def forms(regex):
    """Texts that a rule matches: every alternative, optional parts with and without."""
    import re._parser as parser

    def joined(items):
        out = [""]
        for op, arg in items:
            out = [a + b for a in out for b in form(str(op), arg)]
        return out

    def form(op, arg):
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return [chr(v) for o, v in arg if str(o) == "LITERAL"] or ["1" if "DIGIT" in str(arg) else " " if "SPACE" in str(arg) and "NOT" not in str(arg) else "x"]
        if op == "BRANCH":
            return [text for branch in arg[1] for text in joined(branch)]
        if op == "SUBPATTERN":
            return joined(arg[3])
        if op == "MAX_REPEAT":
            least, most, inner = arg
            return [text * n for text in joined(inner) for n in {least, min(int(most), least + 1)}]
        assert op in ("AT", "ASSERT_NOT"), op
        return [""]

    return [text for text in joined(parser.parse(regex)) if re.search(regex, text)]


def test_every_form_of_every_rule_passes_gate_and_keywords():
    from civicpulse.llm.licenses import GATE

    gate = re.compile(GATE)
    for rule in signature_rules():
        texts = forms(rule.regex)
        assert texts, rule
        for text in texts:
            assert gate.search(text) and any(word in text for word in rule.keywords), (rule, text)


def test_notices_without_the_word_license(spark):
    texts = {
        "Released under the GPL v3.": "gpl-3.0", "distributed under the terms of the GPL": "gpl", "Available under CC BY-SA 4.0": "cc-by-sa",
        "Published under MPL 2.0": "mpl-2.0", "http://mozilla.org/MPL/2.0/": "mpl-2.0", "MIT No Attribution": "mit-0",
        "Common Development and Distribution License": "cddl-1.0", "SIL Open Font License": "ofl-1.1", "license: BSL-1.0": "bsl-1.0",
        "Eclipse.org/legal/EPL-2.0": "epl-2.0", "released under the\nmoon": "",
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_report(frame).collect()}
    for i, label in enumerate(texts.values()):
        assert label in got[i].labels.split(",") and (got[i].score > 0) == bool(label), got[i]


def test_strings_that_begin_alike_are_told_apart(spark):
    rows = spark.range(3200).select(
        "id", F.when(F.col("id") % 40 == 0, None).otherwise(F.format_string("https://www.example.com/%05d", "id")).alias("url")
    ).repartition(5)
    bounds = value_bounds(rows, "url", 32)
    assert len(bounds) == 31
    held = sorted(r.url for r in rows.collect() if r.url)
    for i, bound in enumerate(bounds, 1):
        assert abs(held.index(bound) - i * len(held) / 32) <= 1
    spread = hilbert_shards(rows, {"url": F.col("url")}, shards=8).groupBy("shard").agg(F.min("url").alias("lo"), F.max("url").alias("hi")).orderBy("shard").collect()
    cells = [(r.lo, r.hi) for r in spread]
    assert all(a[1] < b[0] or a[1][:-3] <= b[0] for a, b in zip(cells, cells[1:])) and len({c[0] for c in cells}) == 8
    assert value_bounds(rows.where("id < 0"), "url", 32) == []
    hot = spark.range(900).select(F.when(F.col("id") < 600, "m").otherwise(F.col("id").cast("string")).alias("v"))
    assert value_bounds(hot, "v", 4)[-1] == "m"


def test_sources_of_one_prefix_shape_the_curve(spark):
    def sharded(prefix):
        rows = spark.range(2000).select("id", F.concat(F.lit(prefix), (F.col("id") % 20).cast("string")).alias("source"), (F.col("id") * 7919 % 997).alias("size"))
        out = hilbert_shards(rows, {"size": F.col("size"), "source": F.col("source")}, tie=("id",))
        return sorted(tuple(r) for r in out.select("id", "shard", "slot").collect())

    assert sharded("src") == sharded("https://www.example.com/")
