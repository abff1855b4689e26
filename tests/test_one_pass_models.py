"""Linear models and histogram trees that fit all classes at once, against NumPy on dense rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from civicpulse.ml import blocks as blocks_module
from civicpulse.ml.blocks import class_counts, read_blocks, to_blocks
from civicpulse.ml.evidence import is_fitted
from civicpulse.ml.linear import linear_svc, logistic
from civicpulse.ml.trees import BINS, best_splits, boosted_trees
from civicpulse.plans.classification import classify

CLASSES = ["all", "first", "none", "second"]


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(8)
    x = np.where(rng.random((300, 12)) < 0.3, rng.random((300, 12)).round(2), 0.0)
    noise = rng.normal(0, 0.3, (300, 2))
    y = np.column_stack([x[:, 0] - x[:, 3] + noise[:, 0] > 0, x[:, 1] + x[:, 2] * x[:, 5] + noise[:, 1] > 0.4])
    return x, y


@pytest.fixture(scope="module")
def rows(spark, dense):
    x, y = dense
    data = []
    for i, (a, (first, second)) in enumerate(zip(x, y)):
        vector = Vectors.dense(a.tolist()) if i % 7 == 0 else Vectors.sparse(12, {j: v for j, v in enumerate(a) if v or j == i % 12})
        data.append((i, vector, ["all"] + ["first"] * bool(first) + ["second"] * bool(second)))
    return spark.createDataFrame(data, ["id", "features", "labels"]).repartition(5).cache()


def test_blocks_hold_every_row(rows, dense, monkeypatch):
    x, y = dense
    for bound in (1, 50, 1 << 20):
        monkeypatch.setattr(blocks_module, "BLOCK_CELLS", bound)
        found = to_blocks(rows, CLASSES)
        n, positives = class_counts(found, 4)
        assert n == 300 and positives.tolist() == [300, y[:, 0].sum(), 0, y[:, 1].sum()]
        read = list(read_blocks(iter(found.toArrow().to_batches()), 4))
        assert len({b.number for b in read}) == len(read)
        sums = sum(np.bincount(b.indices, b.values, 12) for b in read)
        assert sums == pytest.approx(x.sum(axis=0))


def newton(x, y, loss, rounds=200):
    """Damped Newton on ``|w|^2 / 2 + sum(loss)``, dense, intercept last."""
    a = np.column_stack([x, np.ones(len(x))])
    s = np.where(y, 1.0, -1.0)
    w = np.zeros(a.shape[1])

    def value(w):
        m = s * (a @ w)
        return w @ w / 2 + (np.logaddexp(0, -m) if loss == "log" else np.maximum(0, 1 - m) ** 2).sum()

    for _ in range(rounds):
        m = s * (a @ w)
        if loss == "log":
            p = 1 / (1 + np.exp(m))
            slope, curve = -p, p * (1 - p)
        else:
            slope, curve = -2 * np.maximum(0, 1 - m), 2.0 * (m < 1)
        gradient = w + a.T @ (s * slope)
        step = np.linalg.solve(np.eye(len(w)) + (a.T * curve) @ a, gradient)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return w, value(w), np.abs(gradient).max()


@pytest.mark.parametrize("make, loss", [(logistic, "log"), (linear_svc, "hinge")])
def test_linear_models_equal_newton(rows, dense, make, loss):
    x, y = dense
    model = make().fit(rows, CLASSES)
    assert is_fitted(model, rows)
    for k, column in ((1, y[:, 0]), (3, y[:, 1])):
        want, value, rest = newton(x, column, loss)
        assert rest < 1e-8
        a, s = np.column_stack([x, np.ones(len(x))]), np.where(column, 1.0, -1.0)
        w, m = model.weights[k], s * (a @ model.weights[k])
        got = w @ w / 2 + (np.logaddexp(0, -m) if loss == "log" else np.maximum(0, 1 - m) ** 2).sum()
        assert got == pytest.approx(value, rel=1e-6)
        assert w == pytest.approx(want, abs=1e-3)
    scored = {r.id: r for r in model.transform(rows).collect()}
    want = np.column_stack([x, np.ones(len(x))]) @ model.weights.T
    assert np.array([scored[i].scores for i in range(300)]) == pytest.approx(want)
    assert {tuple(r.predicted[::2]) for r in scored.values()} == {(1, 0)}


@pytest.mark.parametrize("fit", [logistic(), linear_svc(), boosted_trees(trees=3, depth=2)])
def test_scores_of_other_rows_are_found_out(rows, fit):
    model = fit.fit(rows, CLASSES)
    assert is_fitted(model, rows)
    other = rows.select("features", (299 - rows.id).alias("id")).join(rows.select("id", "labels"), "id")
    assert not is_fitted(model, other)


def test_number_of_passes_does_not_grow_with_classes(rows, monkeypatch):
    from civicpulse.ml import linear

    counts = {}
    for classes in (CLASSES[1:2], CLASSES, [*CLASSES, "first", "second"]):
        calls, plain = [], linear._pass
        monkeypatch.setattr(linear, "_pass", lambda *a: calls.append(1) or plain(*a))
        logistic().fit(rows, classes)
        monkeypatch.setattr(linear, "_pass", plain)
        counts[len(classes)] = len(calls)
    assert counts[6] == counts[4] <= counts[1] + 15


def slow_trees(x, y, trees, depth, rate):
    """Second-order boosting by trying every value of every feature, zeros to either side."""
    p0 = y.mean()
    base = np.log(p0 / (1 - p0))
    margin, model = np.full(len(x), base), []

    def grow(rows, level, g, h):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for cut in np.unique(v[v != 0]):
                    for zeros_left in (False, True):
                        left = np.where(v == 0, zeros_left, v <= cut)
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        gr, hr = total_g - gl, total_h - hl
                        if hl < 1 or hr < 1:
                            continue
                        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total_g**2 / (total_h + 1)
                        if gain > best[0] + 1e-5:
                            best = (gain, (f, cut, zeros_left, left))
        if best[1] is None:
            return -rate * total_g / (total_h + 1)
        f, cut, zeros_left, left = best[1]
        return f, cut, zeros_left, grow(rows[left], level + 1, g, h), grow(rows[~left], level + 1, g, h)

    def walk(tree, row):
        while isinstance(tree, tuple):
            f, cut, zeros_left, low, high = tree
            tree = low if (zeros_left if row[f] == 0 else row[f] <= cut) else high
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(x)), 0, p - y, p * (1 - p))
        model.append(tree)
        margin = margin + np.array([walk(tree, r) for r in x])
    return margin


def test_trees_equal_exhaustive_search(rows, dense):
    x, y = dense
    model = boosted_trees(trees=6, depth=3, rate=0.3).fit(rows, CLASSES)
    assert is_fitted(model, rows) and model.live.tolist() == [1, 3]
    scored = {r.id: r for r in model.transform(rows).collect()}
    got = np.array([scored[i].scores for i in range(300)])
    for k, column in ((1, y[:, 0]), (3, y[:, 1])):
        want = slow_trees(x, column.astype(float), 6, 3, 0.3)
        assert got[:, k] == pytest.approx(want, abs=1e-4)
        loss = np.logaddexp(0, np.where(column, -want, want)).sum()
        assert model.losses[-1][[1, 3].index(k)] == pytest.approx(loss, rel=1e-4)
    assert {(r.predicted[0], r.predicted[2]) for r in scored.values()} == {(1, 0)}


def test_bins_do_not_pass_the_bound(spark):
    rng = np.random.default_rng(2)
    values = rng.random(4000)
    rows = spark.createDataFrame(
        [(Vectors.sparse(2, {1: float(v)}), ["up"] if v > 0.5 else []) for v in values], ["features", "labels"]
    )
    model = boosted_trees(trees=3, depth=1).fit(rows, ["up"])
    assert np.diff(model.cuts.heads).max() < BINS
    cut = model.cuts.points[model.forest.bin[0, 0, 0]]
    assert abs(cut - 0.5) < 2 / BINS
    scored = model.transform(rows).select("predicted", "labels").collect()
    assert np.mean([r.predicted[0] == bool(r.labels) for r in scored]) > 0.99


def test_split_needs_weight_on_both_sides():
    key = np.array([3 * BINS, 3 * BINS + 1])
    totals = np.array([[0.0], [0.5]])
    found = best_splits(key, np.array([-3.0, 3.0]), np.array([0.25, 0.25]), totals, 10 * BINS, 1.0, 1.0)
    assert len(found[0]) == 0
    found = best_splits(key, np.array([-3.0, 3.0]), np.array([2.0, 2.0]), np.array([[0.0], [4.0]]), 10 * BINS, 1.0, 1.0)
    assert [f.tolist() for f in found] == [[0], [6.0], [3], [0], [False], [-3.0], [2.0]]


def test_splits_do_not_hang_on_the_portions_scanned(monkeypatch):
    from civicpulse.ml import trees

    rng = np.random.default_rng(4)
    keys = [rng.choice(4 * 6 * BINS, 900, replace=False) for _ in range(3)]
    key = np.concatenate([np.sort(k) for k in keys])
    g, h = rng.integers(-3, 4, len(key)).astype(float), np.ones(len(key))
    totals = np.array([[5.0, -3.0, 0.0, 2.0], [1e3, 1e3, 1e3, 1e3]])
    found = {}
    for most in (1, 5, 1 << 20):
        monkeypatch.setattr(trees, "SCANNED", most)
        found[most] = [x.tolist() for x in best_splits(key, g, h, totals, 6 * BINS, 1.0, 1.0)]
    assert found[1] == found[5] == found[1 << 20] and found[1][0] == [0, 1, 2, 3]


def test_rows_times_weights():
    sizes, values = np.array([2, 0, 3]), np.array([1.0, 2.0, 3.0, -1.0, 0.5])
    block = blocks_module.Block(0, sizes, np.array([0, 3, 1, 2, 0]), values, np.zeros((3, 3)))
    weights = np.arange(12.0).reshape(4, 3)
    dense = np.array([[1.0, 0, 0, 2], [0, 0, 0, 0], [0.5, 3, -1, 0]])
    assert block.times(weights) == pytest.approx(dense @ weights)


def test_classify_gives_scores_beside_truth(spark):
    data = [(i, f"{'water' if i % 2 else 'road'} place{i % 5}", "{wet}" if i % 2 else "{dry}") for i in range(200)]
    tickets = spark.createDataFrame(data, "ticket_id int, comment string, type string")
    done = classify(tickets, models={"svc": (linear_svc(), 1), "trees": (boosted_trees(trees=5, depth=2), 5)})
    for rows in done.results.values():
        for r in rows.collect():
            assert r.predicted == r.truth and [s > 0 for s in r.scores] == [p == 1 for p in r.predicted]
    done.close()
