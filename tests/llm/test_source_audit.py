"""The source audit against counting everything, with runs of all sizes."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from civicpulse.llm import sourceaudit
from civicpulse.llm.sourceaudit import Block, merged, source_audit, term_frequencies

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, value int, rank string, part string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{c}" for c in "abcdefghij"] + ["Élan", "the", "THE", "it's", "中文字"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words, rng.integers(0, 40)))
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", "", None, "c\n"][i % 5]))
    rows += [(90, None, "xx", "a"), (91, "", "xx", "b"), (92, "alone", "yy", "z"), (93, "the " * 30_000, "en", "a")]
    rows += [(94, "the the same", "en", "d")] * 4 + [(None, "1 2 3", "en", "e")]
    return [(*r, 1, "clash", "clash") for r in rows]


def slow_audit(rows, min_docs=3, most=200):
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text or ""))
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for (g, t), n in df.items() if g == lang and n >= min_docs]
        sources = [s for g, s in groups if g == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p, q = share(counts[lang, source]), share(whole)
        found = {"pair": {}, "term": {}}
        for other in sources:
            if other != source:
                o = share(counts[lang, other])
                found["pair"][other] = sum((p[t] - o[t]) ** 2 // o[t] for t in kept)
        found["term"] = {t: (p[t] - q[t]) ** 2 // q[t] for t in kept if counts[lang, source][t] and p[t] > q[t]}
        for part, items in found.items():
            ranked = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= most]
    return sorted(out)


@pytest.mark.parametrize("indexing", [{}, {"block_tokens": 50, "piece_terms": 3, "shards": 3}])
def test_audit(spark, indexing, monkeypatch):
    if indexing:
        monkeypatch.setattr(sourceaudit, "PAIRS_AT_ONCE", 7)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(tuple(r) for r in source_audit(docs, **indexing).collect())
    assert got == slow_audit(rows)
    got = sorted(tuple(r) for r in source_audit(docs, most_terms=2, **indexing).collect())
    assert got == slow_audit(rows, most=2)


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert source_audit(none).count() == 0
    assert source_audit(spark.createDataFrame([(1, None, None, None, 1, "", "")], DOCS)).count() == 0


def test_runs_merge_to_the_same_counts():
    whole, parts = Block(), []
    rng = np.random.default_rng(4)
    for i in range(40):
        text, group = " ".join(rng.choice(list("abcdefgh"), 30)), (["en", "de"][i % 2], f"s{i % 3}")
        whole.add(text, *group)
        if i % 4 == 0:
            parts.append(Block())
        parts[-1].add(text, *group)

    def runs(blocks, piece_terms):
        pieces = [p for b in blocks for p in b.run(4, piece_terms)]
        return list(merged(iter(sorted(pieces, key=lambda p: (p["shard"], p["first"])))))

    def plain(rows):
        return [(lang, term, df, sorted(counts.items())) for lang, term, df, counts in rows]

    assert plain(runs(parts, 2)) == plain(runs([whole], 1000))
    assert len(plain(runs(parts, 2))) == 16


def test_kept_terms_hold_all_their_counts(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    kept = {(r.lang, r.term): r for r in term_frequencies(docs).collect()}
    assert kept["en", "the"].df >= 5 and sum(kept["en", "the"].counts) > 30_000
    assert ("yy", "alone") not in kept
