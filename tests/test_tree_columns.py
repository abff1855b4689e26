"""Trees over cells dealt by feature: what a level costs, and that the dealing never shows in the trees."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from civicpulse.ml import trees
from civicpulse.ml.trees import BINS, boosted_trees, quantile_cuts

CLASSES = ["first", "second"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((240, 9)) < 0.4, rng.random((240, 9)).round(2), 0.0)
    y = np.column_stack([x[:, 0] + rng.normal(0, 0.3, 240) > 0.3, x[:, 1] * x[:, 4] + rng.normal(0, 0.2, 240) > 0.1])
    data = [
        (Vectors.sparse(9, {j: float(v) for j, v in enumerate(a) if v}), [c for c, has in zip(CLASSES, b) if has])
        for a, b in zip(x, y)
    ]
    return spark.createDataFrame(data, ["features", "labels"]).cache()


def test_a_level_is_one_stage_without_a_shuffle(spark, rows, monkeypatch):
    context = spark.sparkContext
    monkeypatch.setattr(trees, "MISSES", 0, raising=False)  # else workers that have not met the cells are asked twice

    def stages(rounds):
        context.setJobGroup(f"trees of {rounds}", "trees")
        boosted_trees(trees=rounds, depth=2, rate=0.3).fit(rows, CLASSES)
        context.setLocalProperty("spark.jobGroup.id", None)
        tracker = context.statusTracker()
        found = [s for j in tracker.getJobIdsForGroup(f"trees of {rounds}") for s in tracker.getJobInfo(j).stageIds]
        return sum(bool((info := tracker.getStageInfo(s)) and info.numCompletedTasks) for s in found)

    assert stages(10) - stages(2) <= 8 * 2


def test_trees_do_not_hang_on_how_cells_are_dealt(rows, monkeypatch):
    found = []
    for part, record, misses, layout in ((10**6, 10**6, 16, 2), (40, 30, 16, 5), (40, 1, 0, 1)):
        monkeypatch.setattr(trees, "LEAST_CELLS_OF_PART", part)
        monkeypatch.setattr(trees, "CELLS_OF_RECORD", record)
        monkeypatch.setattr(trees, "MISSES", misses)
        model = boosted_trees(trees=5, depth=4, rate=0.3).fit(rows.repartition(layout), CLASSES)
        forest = model.forest
        found.append([x.tolist() for x in (model.cuts.points, forest.feature, forest.bin, forest.zeros_left, forest.value)])
    assert found[0] == found[1] == found[2] and (np.array(found[0][1]) >= 0).sum() > 20


def test_search_is_the_same_for_few_and_many_nodes(monkeypatch):
    rng = np.random.default_rng(1)
    n, features = 400, np.array([2, 5, 6])
    slot, p, truth = rng.integers(0, 5, n).astype(np.uint8), rng.random(n), rng.integers(0, 2, n)
    g, h = trees._slopes(p, truth)
    totals = np.stack([np.bincount(slot, x, 5)[:4] for x in (g, h)])
    rows = np.concatenate([np.sort(rng.choice(n, 150, replace=False)) for _ in features])
    codes = np.repeat(np.arange(3), 150) * BINS + np.concatenate([np.sort(rng.integers(0, 9, 150)) for _ in features])
    found = []
    for few in (0, 9):
        monkeypatch.setattr(trees, "FEW_NODES", few)
        search = trees._Search(slot, totals, p, truth, 1.0, 1.0)
        search.look(features, codes, rows, 8 * BINS)
        found.append(search.found())
    assert found[0] == found[1] and len(found[0][0]) == 4
    parted = np.unpackbits(np.frombuffer(found[0][1], np.uint8), count=n).astype(bool)
    for at, _, _, _, zeros_left, _, left_h in found[0][0]:
        left = (slot == at) & (parted != zeros_left)
        assert h[left].sum() == left_h  # exact: slopes are multiples of a power of two


def test_workers_remember_up_to_a_bound(monkeypatch):
    records = [(np.array([1, 4]), np.array([2, 1]), np.array([0, 3, 7], np.uint8), np.array([5, 6, 5], np.int32))] * 2
    held = trees._Remembered()
    ready = list(held.reading(("fit", 0), records))
    assert ready[0][1].tolist() == [0, 3, BINS + 7] and len(held.get(("fit", 0))) == 2
    monkeypatch.setattr(trees, "REMEMBERED_BYTES", held.bytes)
    assert len(list(held.reading(("fit", 1), records))) == 2
    assert held.get(("fit", 0)) is None and held.get(("fit", 1)) is not None
    assert len(list(held.reading(("fit", 2), records * 2))) == 4  # too large to be kept, read in full
    assert held.get(("fit", 2)) is None and held.get(("fit", 1)) is not None and held.bytes == trees.REMEMBERED_BYTES


def test_cuts_are_quantiles():
    values = np.random.default_rng(3).permutation(np.arange(1.0, 1001.0))
    assert quantile_cuts(values, 4).tolist() == [250.0, 500.0, 750.0]
    assert quantile_cuts(np.array([0.3, 0.1, 0.3])).tolist() == [0.1, 0.3]
    assert len(quantile_cuts(np.random.default_rng(4).random(5000))) == BINS - 1
