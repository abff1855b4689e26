"""Exact hold-outs, binned densities, the heat surface and word segmentation, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from helpers import column
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.functions.geo import METRES_PER_DEGREE
from civicpulse.functions.segment import Segmenter, dictionary_tokenizer
from civicpulse.ml import features, labels, metrics
from civicpulse.operators import density, distribution, shares


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 999])
def test_hold_out_has_exactly_its_size(spark, n):
    df = spark.range(n).repartition(3)
    train, test = labels.exact_split(df, "id")
    assert test.count() == math.ceil(n / 5) and train.count() == n - math.ceil(n / 5)
    again = labels.exact_split(df.repartition(7), "id")[1]
    assert sorted(column(again, "id")) == sorted(column(test, "id"))
    assert set(column(labels.split(df, "id")[1], "id")) ^ set(column(test, "id")) != set(range(n)) or n < 5


@pytest.mark.parametrize("most", [1, 10, 10_000])
@pytest.mark.parametrize("count", [0, 1, 137, 400, 500])
def test_smallest_by_narrowing(spark, most, count):
    df = spark.range(400).select(F.md5(F.col("id").cast("string")).alias("p"))
    want = sorted(column(df, "p"))[:count]
    assert sorted(column(df.where(shares.smallest(df, F.col("p"), count, most)), "p")) == want


def values(spark, data):
    return distribution.value_counts(spark.createDataFrame([(float(v),) for v in data], "v double"), "v")


@pytest.mark.parametrize("cells", [512, 4096, 32768])
def test_binned_curve_is_within_its_bound(spark, cells):
    rng = random.Random(4)
    data = [rng.gauss(20, 5) for _ in range(500)] + [20.0] * 50 + [45.0]
    counts = values(spark, data)
    exact = {r.point: r for r in distribution.density_curve(counts).collect()}
    binned = {r.point: r for r in distribution.binned_density_curve(counts, cells=cells).collect()}
    h = np.std(data, ddof=1) * len(data) ** -0.2
    step, width = (max(data) - min(data)) / cells, (max(data) - min(data)) / 30
    bound = len(data) * width * (step / h) ** 2 / (8 * h * math.sqrt(2 * math.pi))
    assert sorted(binned) == sorted(exact) == list(range(200))
    for point, row in exact.items():
        assert binned[point].x == pytest.approx(row.x)
        assert abs(binned[point].y - row.y) <= bound + 1e-9
    assert h / step < 360 or bound <= 1e-6 * len(data) * width / (h * math.sqrt(2 * math.pi))


def test_no_binned_curve_for_equal_values(spark):
    assert distribution.binned_density_curve(values(spark, [3, 3])).count() == 0
    assert distribution.binned_density_curve(values(spark, [])).count() == 0


def test_heat_surface_equals_the_direct_kernel_sum(spark):
    lat, lon = fixed.DEFAULT_CENTER
    rng = random.Random(6)
    points = [(lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.02, 0.02), rng.choice([1.0, 2.5])) for _ in range(60)]
    df = spark.createDataFrame([*points, (None, lon, 1.0)], "latitude double, longitude double, w double")
    got = density.heat_surface(df, cells_per_radius=3, weight=F.col("w")).collect()
    cell = density.pixel_metres(fixed.DEFAULT_ZOOM, lat) * 50 / 3
    raw = [math.exp(-4.5 * (i / 3) ** 2) for i in range(-3, 4)]
    want = {}
    for a, b, w in points:
        x = math.floor((b - lon) * METRES_PER_DEGREE * math.cos(math.radians(lat)) / cell)
        y = math.floor((a - lat) * METRES_PER_DEGREE / cell)
        for i, j in itertools.product(range(7), repeat=2):
            at = (x + i - 3, y + j - 3)
            want[at] = want.get(at, 0) + w * raw[i] * raw[j] / sum(raw) ** 2
    assert {(r.x, r.y): r.heat for r in got} == pytest.approx(want)
    assert sum(r.heat for r in got) == pytest.approx(sum(p[2] for p in points))


def test_radius_shrinks_by_half_a_zoom_step(spark):
    assert density.pixel_metres(11, 0) == pytest.approx(2 * density.pixel_metres(12, 0))
    assert density.pixel_metres(0, 0) * 256 == pytest.approx(40_075_016.686)


def slow_cut(text, dictionary):
    """Every way to cut a text, the best by (unknown characters, tokens, longest tokens first)."""
    best = None
    for marks in itertools.product([False, True], repeat=max(len(text) - 1, 0)):
        tokens, start = [], 0
        for i, mark in enumerate([*marks, True], 1):
            if mark:
                tokens.append(text[start:i])
                start = i
        known = [t in dictionary for t in tokens]
        if any(not a and not b for a, b in zip(known, known[1:])):
            continue
        cost = (sum(len(t) for t, k in zip(tokens, known) if not k), len(tokens), [-len(t) for t in tokens])
        if best is None or cost < best[0]:
            best = (cost, tokens)
    return best[1] if text else []


def test_segmentation_equals_exhaustive_search():
    rng = random.Random(9)
    for _ in range(250):
        dictionary = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 7))}
        text = "".join(rng.choices("abcx", k=rng.randint(0, 10)))
        assert Segmenter(dictionary).cut(text) == slow_cut(text, dictionary), (dictionary, text)


def test_dictionary_plugs_into_the_features(spark):
    dictionary = spark.createDataFrame([("น้ำ",), ("ท่วม",), ("น้ำท่วม",), ("ถนน",), (None,)], "word string")
    tokenizer = dictionary_tokenizer(dictionary, "word")
    df = spark.createDataFrame([(1, "น้ำท่วมถนน abc"), (2, "ถนนน้ำ!"), (3, ""), (4, None)], "id int, t string")
    tokens = features.with_tokens(df, "t", tokenizer)
    found = {r.id: r.tokens for r in tokens.collect()}
    assert found[1] == ["น้ำท่วม", "ถนน", "abc"] and found[2] == ["ถนน", "น้ำ"] and found[3] == []
    assert not found[4]
    model = features.fit_tfidf(df.where("t IS NOT NULL"), "t", tokenizer, min_df=1)
    assert "น้ำท่วม ถนน" in model.terms


def test_dictionary_query_equals_a_plain_version(spark):
    import hashlib

    from querybook import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    split = {k: features_words(t) for k, t in docs}
    df = {}
    for tokens in split.values():
        for t in set(tokens):
            df[t] = df.get(t, 0) + 1
    segmenter = Segmenter(t for t, n in df.items() if n >= 5 and 2 <= len(t) <= 8)
    want = {}
    for k, tokens in split.items():
        cut = [c for t in tokens for c in segmenter.cut(t)]
        want[k] = (len(cut), hashlib.md5("|".join(cut).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.digest) for r in QUERIES["dictionary_tokens"](spark, folder).collect()}
    assert got == want


def test_equal_pieces_are_cut_once(monkeypatch):
    import pyarrow as pa

    from civicpulse.functions import segment

    cuts, plain = [], Segmenter.cut
    monkeypatch.setattr(Segmenter, "cut", lambda self, text: cuts.append(text) or plain(self, text))
    built = Segmenter(["ab", "abc", "cd", "d"])
    rows = pa.array([["abcd", "zz", "ab"], None, [], ["abcd"], ["", "abx", "abcd"]], pa.list_(pa.string()))
    want = [["abc", "d", "zz", "ab"], None, [], ["abc", "d"], ["ab", "x", "abc", "d"]]
    assert built.cut_all(rows).to_pylist() == want
    assert built.cut_all(rows.slice(1, 3)).to_pylist() == want[1:4]
    assert built.cut_all(rows.slice(1, 2)).to_pylist() == [None, []]
    assert sorted(cuts) == sorted({"abcd", "zz", "ab", "", "abx"})
    monkeypatch.setattr(segment, "MOST_CUTS", 2)  # a memory that overflows changes nothing
    assert Segmenter(["ab", "abc", "cd", "d"]).cut_all(rows).to_pylist() == want


def features_words(text):
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{M}\p{N}_]+", text.lower()) if t]


@pytest.mark.parametrize("slices", [2, 16])
def test_area_under_the_curve_by_all_pairs(spark, slices):
    rng = random.Random(3)
    rows = [([rng.randint(0, 1), 1], [rng.choice([0.1, 0.2, rng.random()]), rng.random()]) for _ in range(200)]
    df = spark.createDataFrame(rows, "truth array<int>, scores array<double>").repartition(3)
    got = {r.label: r for r in metrics.ranking_scores(df, slices=slices).collect()}
    up = [s[0] for t, s in rows if t[0]]
    down = [s[0] for t, s in rows if not t[0]]
    want = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
    assert got[0].auc == pytest.approx(want) and (got[0].positives, got[0].negatives) == (len(up), len(down))
    assert got[1].auc is None
