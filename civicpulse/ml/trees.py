"""Boosted trees over histograms, second order, all classes at once (M9).

Feature values are binned once, by quantiles of what is not zero; zeros (most cells of a text
vector) are never stored: a node's sums less those of its bins are the zeros' sums, and each
split learns the side they go to.

Text vectors are wide and thin: sums by (node, feature, bin) are as many as the cells, so it is
rows that travel, a bit each, and never sums. The cells are dealt once by feature, a column with
all its rows to one task. One job of one stage per tree level serves all classes:

* the driver sends where each row stands (its node; once a tree its probability);
* a task adds up gradients and hessians of its columns' cells by (class, node, feature, bin),
  leaves out columns that weigh too little in a node to be split there, scans the others' bins
  from the left, and returns the best split of each node with a bit per row: does it part from the zeros;
* the driver keeps the best split of the tasks' and moves the rows on.

A worker remembers the cells of parts it has met, up to a bound, and is sent them anew where it
does not, so nothing is lost with it. The driver holds, and a task reads, some 20 bytes a row and class.
"""

from __future__ import annotations

import gc
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed
from civicpulse.ml.blocks import feature_count, read_blocks, settled, to_blocks, vector_cells

BINS = 256
SCANNED = 8_192
LEAST_GAIN = 1e-6
LEAST_CELLS_OF_PART = 20_000
MOST_CELLS_OF_PART = 8_000_000
CELLS_OF_PIECE = 1 << 21
CELLS_OF_RECORD = 1 << 17
FEW_NODES = 6
REMEMBERED_BYTES = 192 << 20
MISSES = 16


@dataclass
class Forest:
    """Trees by (round, class, node): node i has the children 2i + 1 and 2i + 2.

    ``feature`` is -1 where a node is not split, ``value`` is then the leaf's.
    """

    base: np.ndarray
    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    zeros_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        shape = (0, len(self.base), (2 << self.depth) - 1)
        self.feature, self.bin = np.empty(shape, np.int32), np.empty(shape, np.int32)
        self.zeros_left, self.value = np.empty(shape, bool), np.empty(shape)

    def __len__(self) -> int:
        return len(self.feature)

    def grow(self) -> None:
        """One more round, of trees that are a single node each."""
        shape = (1, *self.feature.shape[1:])
        self.feature = np.concatenate([self.feature, np.full(shape, -1, np.int32)])
        self.bin = np.concatenate([self.bin, np.zeros(shape, np.int32)])
        self.zeros_left = np.concatenate([self.zeros_left, np.zeros(shape, bool)])
        self.value = np.concatenate([self.value, np.zeros(shape)])

    def nodes(self, codes: np.ndarray, rows: np.ndarray, n: int, at: int, label: int) -> np.ndarray:
        """The node each of ``n`` rows has come to in one tree.

        ``codes`` (feature * BINS + bin, ascending) and ``rows`` are the cells that are not zero.
        """
        feature, cut, zeros_left = self.feature[at, label], self.bin[at, label], self.zeros_left[at, label]
        node = np.zeros(n, np.int16)
        split = np.nonzero(feature >= 0)[0]
        first = np.searchsorted(codes, feature[split].astype(np.int64) * BINS)
        last = np.searchsorted(codes, (feature[split].astype(np.int64) + 1) * BINS)
        middle = np.searchsorted(codes, feature[split].astype(np.int64) * BINS + cut[split], side="right")
        for here, a, m, b in zip(split.tolist(), first, middle, last):  # parents come before children
            inside = node == here
            left, right = 2 * here + 1, 2 * here + 2
            low, high = rows[a:m], rows[m:b]
            low, high = low[inside[low]], high[inside[high]]
            node[inside] = left if zeros_left[here] else right
            node[low] = left
            node[high] = right
        return node

    def add(self, margins: np.ndarray, codes: np.ndarray, rows: np.ndarray, begin: int, end: int) -> None:
        """Add the trees of rounds ``begin`` to ``end`` to ``margins`` (rows x classes)."""
        for at in range(begin, end):
            for label in range(margins.shape[1]):
                margins[:, label] += self.value[at, label][self.nodes(codes, rows, len(margins), at, label)]


def _probability(margins: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -margins))


def _loss(margins: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Of each class; both are classes x rows."""
    return np.logaddexp(0.0, np.where(truth > 0, -margins, margins)).sum(axis=1)


@dataclass(frozen=True)
class Cuts:
    """Ascending cut points of each feature, one after the other; a bin holds values up to its cut."""

    heads: np.ndarray
    points: np.ndarray

    def bins(self, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Bin of each value: how many cut points of its feature lie below it."""
        order = np.lexsort((values, indices))
        out = np.empty(len(values), np.int64)
        at, found = indices[order], values[order]
        bounds = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:]):
            points = self.points[self.heads[at[a]] : self.heads[at[a] + 1]]
            out[order[a:b]] = np.searchsorted(points, found[a:b])
        return out


def quantile_cuts(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The distinct ones of the ``bins`` quantiles of a feature's values that are not zero."""
    ranks = -(-np.arange(1, bins) * len(values) // bins)
    return np.unique(np.sort(values)[np.maximum(ranks, 1) - 1])


def _outlined(blocks: DataFrame, n_classes: int, width: int) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """The first row's number of each block, the targets of all rows, and how many cells each feature has."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(width, np.int64)
        for block in read_blocks(batches, n_classes):
            cells += np.bincount(block.indices[block.values != 0], minlength=width)
            yield pa.RecordBatch.from_arrays([pa.array([block.number]), pa.array([block.targets.tobytes()], pa.binary())], ["block", "of"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([cells.tobytes()], pa.binary())], ["block", "of"])

    found = sorted(((r.block, bytes(r.of)) for r in blocks.mapInArrow(outline, "block long, of binary").collect()), key=lambda r: r[0])
    targets = [np.frombuffer(of, "u1").reshape(-1, n_classes) for number, of in found if number >= 0]
    ends = np.cumsum([0, *map(len, targets)]).tolist()
    cells = sum((np.frombuffer(of, np.int64) for number, of in found if number < 0), np.zeros(width, np.int64))
    starts = dict(zip((number for number, _ in found if number >= 0), ends))
    return starts, np.concatenate([np.empty((0, n_classes), np.uint8), *targets]), cells


def _parts(cells: np.ndarray, cores: int) -> tuple[int, np.ndarray]:
    """How many parts the features are dealt to, and the part of each: by weight, to and fro."""
    total = int(cells.sum())
    parts = min(cores, len(cells), 1 + total // LEAST_CELLS_OF_PART)
    parts = min(parts * max(1, -(-total // (parts * MOST_CELLS_OF_PART))), len(cells))
    turn = np.arange(len(cells)) % (2 * parts)
    part = np.empty(len(cells), np.int32)
    part[np.argsort(-cells, kind="stable")] = np.minimum(turn, 2 * parts - 1 - turn)
    return parts, part


def _dealt(blocks: DataFrame, n_classes: int, n: int, starts: dict[int, int], parts: int, part: np.ndarray) -> RDD:
    """The cells that are not zero, as ``(part, (feature * n + row, value))`` arrays, a partition per part."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def pieces() -> Iterator[pa.RecordBatch]:
            cells, values = (np.concatenate(x) for x in zip(*held))
            to = part[cells // n]
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(parts + 1))
            for at in np.flatnonzero(np.diff(bounds)):
                chosen = order[bounds[at] : bounds[at + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), *(pa.array([x[chosen].tobytes()], pa.binary()) for x in (cells, values))],
                    ["part", "cells", "values"],
                )

        for block in read_blocks(batches, n_classes):
            stored = block.values != 0
            held.append((block.indices[stored].astype(np.int64) * n + (starts[block.number] + block.owner[stored]), block.values[stored]))
            count += len(held[-1][0])
            if count >= CELLS_OF_PIECE:
                yield from pieces()
                held, count = [], 0
        if count:
            yield from pieces()

    pieces = blocks.mapInArrow(dealt, "part int, cells binary, values binary").rdd
    return pieces.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2])))).partitionBy(parts, int)


def _read_columns(pieces: Iterable[tuple[int, tuple[bytes, bytes]]], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(feature, values, rows)`` of whole columns, by feature; rows ascend."""
    held = [(np.frombuffer(c, np.int64), np.frombuffer(v)) for _, (c, v) in pieces]
    if held:
        cells, values = (np.concatenate(x) for x in zip(*held))
        del held
        order = np.argsort(cells)
        features, rows = np.divmod(cells[order], n)
        values = values[order]
        heads = _heads(features)
        for a, b in zip(heads, [*heads[1:], len(rows)]):
            yield int(features[a]), values[a:b], rows[a:b]


def _cuts(dealt: RDD, parts: int, n: int, width: int, bins: int) -> Cuts:
    """The cut points of all features; fewer than ``bins`` numbers of each come to the driver."""

    def points(pieces) -> list[tuple[int, np.ndarray]]:
        return [(feature, quantile_cuts(values, bins)) for feature, values, _ in _read_columns(pieces, n)]

    found = dict(dealt.context.runJob(dealt, points, range(parts)))
    every = [found.get(i, np.empty(0)) for i in range(width)]
    return Cuts(np.cumsum([0, *map(len, every)]), np.concatenate(every))


def _columns(dealt: RDD, n: int, bins: int) -> RDD:
    """The cells by column: records ``(features, sizes, bins, rows)`` of whole columns, cells by bin."""

    def records(pieces) -> Iterator[tuple[np.ndarray, ...]]:
        held, count = [], 0
        for feature, values, rows in _read_columns(pieces, n):
            found = np.searchsorted(quantile_cuts(values, bins), values).astype(np.uint8)
            order = np.argsort(found, kind="stable")
            held.append((feature, len(rows), found[order], rows[order].astype(np.int32)))
            count += len(rows)
            if count >= CELLS_OF_RECORD:
                yield _record(held)
                held, count = [], 0
        if held:
            yield _record(held)

    return dealt.mapPartitions(records).persist(StorageLevel.MEMORY_AND_DISK)


def _record(held: list[tuple]) -> tuple[np.ndarray, ...]:
    features, sizes, bins, rows = zip(*held)
    return np.array(features), np.array(sizes), np.concatenate(bins), np.concatenate(rows)


def _heads(column: np.ndarray) -> np.ndarray:
    """Where the column changes, the first place included."""
    fresh = np.ones(len(column), bool)
    np.not_equal(column[1:], column[:-1], out=fresh[1:])
    return np.flatnonzero(fresh)


class _Search:
    """The best split of each node of a level, for one class, over the columns a task meets.

    ``slot`` says at which node of the level a row stands, ``totals.shape[1]`` if at none that
    could be split; ``totals`` are the nodes' sums of gradients and hessians.
    """

    def __init__(self, slot: np.ndarray, totals: np.ndarray, p: np.ndarray, truth: np.ndarray, penalty: float, least_weight: float):
        self.slot, self.totals, self.penalty, self.least_weight = slot, totals, penalty, least_weight
        self.g, self.h = _slopes(p, truth)
        self.slots = np.flatnonzero(np.bincount(slot, minlength=totals.shape[1])[: totals.shape[1]]).tolist()
        self.best = {}

    def look(self, features: np.ndarray, codes: np.ndarray, rows: np.ndarray, span: int) -> None:
        """Whole columns: ``codes`` (place in ``features`` * BINS + bin, ascending) and rows of their cells."""
        sums = [self._sums(slot, inside, features, codes, rows, span) for slot, inside in self._inside(self.slot.take(rows))]
        if sums := [x for x in sums if x]:
            key, g, h = (np.concatenate(x) for x in zip(*sums))
            found = best_splits(key, g, h, self.totals, span, self.penalty, self.least_weight)
            for split in zip(*(x.tolist() for x in found)):
                self._keep(*split, features, codes, rows)

    def _inside(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The cells of each node, given where each cell's row stands."""
        if len(self.slots) <= FEW_NODES:
            yield from ((slot, np.flatnonzero(at == slot)) for slot in self.slots)
        else:
            order, ends = np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=self.totals.shape[1]))
            yield from ((slot, order[ends[slot - 1] if slot else 0 : ends[slot]]) for slot in self.slots)

    def _sums(self, slot: int, inside: np.ndarray, features, codes, rows, span: int):
        """Keys as of :func:`best_splits` with their sums, of one node; nothing of columns that can't be split in it."""
        if not len(inside):
            return None
        own, owner = (codes, rows) if len(inside) == len(rows) else (codes.take(inside), rows.take(inside))
        h, heads = self.h.take(owner), _heads(own // BINS)
        # A side of a split lies within the column's cells; if these weigh too little, there is none.
        enough = np.add.reduceat(h, heads) >= self.least_weight
        if not enough.any():
            return None
        if not enough.all():
            chosen = np.flatnonzero(np.repeat(enough, np.diff(np.append(heads, len(own)))))
            own, owner, h = own.take(chosen), owner.take(chosen), h.take(chosen)
        heads = _heads(own)
        column, bins = np.divmod(own[heads], BINS)
        key = slot * span + features[column] * BINS + bins
        return key, np.add.reduceat(self.g.take(owner), heads), np.add.reduceat(h, heads)

    def _keep(self, slot: int, gain: float, feature: int, cut: int, zeros_left: bool, left_g: float, left_h: float, features, codes, rows) -> None:
        """Keep a split if none as good came before; equal ones go by feature."""
        if slot in self.best and (self.best[slot][0], -self.best[slot][1]) >= (gain, -feature):
            return
        first = int(np.searchsorted(features, feature)) * BINS
        a, middle, b = np.searchsorted(codes, (first, first + cut + 1, first + BINS)).tolist()
        parted = rows[middle:b] if zeros_left else rows[a:middle]
        self.best[slot] = (gain, feature, cut, zeros_left, left_g, left_h, parted[self.slot[parted] == slot])

    def found(self) -> tuple[list[tuple], bytes]:
        """``(slot, gain, feature, bin, zeros_left, left_g, left_h)``, and a bit per row: parts from its node's zeros."""
        parts = np.zeros(len(self.slot), bool)
        for *_, parted in self.best.values():
            parts[parted] = True
        return [(slot, *x[:-1]) for slot, x in self.best.items()], np.packbits(parts).tobytes()


class _Remembered:
    """Records of parts this worker has met, ready for :meth:`_Search.look`, the least used dropped first."""

    def __init__(self):
        self.held: OrderedDict[tuple[str, int], tuple[int, list]] = OrderedDict()
        self.bytes, self.frozen = 0, False

    def freeze(self) -> None:
        """Once a worker: Spark collects its garbage after every task, and would go through all that was imported."""
        if not self.frozen:
            gc.freeze()
            self.frozen = True

    def get(self, key: tuple[str, int]) -> list | None:
        if key not in self.held:
            return None
        self.held.move_to_end(key)
        return self.held[key][1]

    def reading(self, key: tuple[str, int], records: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
        """The records made ready one by one; remembered if all of them fit the bound."""
        self.bytes -= self.held.pop(key, (0, None))[0]
        size, kept = 0, []
        for features, sizes, bins, rows in records:
            ready = features, np.repeat(np.arange(len(features), dtype=np.int32) * BINS, sizes) + bins, rows.astype(np.intp)
            size += sum(x.nbytes for x in ready)
            if size <= REMEMBERED_BYTES:
                kept.append(ready)
            else:
                kept.clear()
            yield ready
        if size <= REMEMBERED_BYTES:
            self.held[key], self.bytes = (size, kept), self.bytes + size
        while self.bytes > REMEMBERED_BYTES:
            self.bytes -= self.held.popitem(last=False)[1][0]


_REMEMBERED = _Remembered()


@dataclass(frozen=True)
class _Level:
    """What a task is asked of its columns on a level: by class, where the rows stand and what the nodes weigh."""

    fit: str
    sent: Broadcast
    truth: Broadcast
    stands: dict[int, tuple[np.ndarray, np.ndarray]]
    span: int
    penalty: float
    least_weight: float

    def splits(self, records: Iterable[tuple[np.ndarray, ...]]) -> list[tuple]:
        _REMEMBERED.freeze()
        searches = {
            k: _Search(slot, totals, self.sent.value[k], self.truth.value[k], self.penalty, self.least_weight)
            for k, (slot, totals) in self.stands.items()
        }
        for features, codes, rows in records:
            for search in searches.values():
                search.look(features, codes, rows, self.span)
        return [(k, *search.found()) for k, search in searches.items() if search.best]

    def read(self, records: Iterable[tuple[np.ndarray, ...]]) -> list[list[tuple]]:
        from pyspark import TaskContext

        return [self.splits(_REMEMBERED.reading((self.fit, TaskContext.get().partitionId()), records))]

    def recall(self, parts: Iterable[int]) -> list[tuple[int, list[tuple] | None]]:
        """By part; None where this worker does not hold the records."""
        found = [(part, _REMEMBERED.get((self.fit, part))) for part in parts]
        return [(part, records if records is None else self.splits(records)) for part, records in found]


class _Parts:
    """The columns' parts. Workers that remember theirs are asked without sending the cells anew."""

    def __init__(self, columns: RDD, parts: int):
        def numbered(part: int, records) -> Iterator[int]:
            for _ in records:
                pass
            yield part

        self.columns, self.parts, self.context, self.fit = columns, parts, columns.context, uuid.uuid4().hex
        # Cached beside the columns, so that the tasks run there.
        self.numbers = columns.mapPartitionsWithIndex(numbered).persist(StorageLevel.MEMORY_AND_DISK)
        self.met, self.misses_left = False, MISSES * parts

    def ask(self, level: _Level) -> list[tuple]:
        found, missing = [], list(range(self.parts))
        if self.met and self.misses_left > 0:  # else workers end with their tasks, or the parts are too large
            recalled = dict(self.context.runJob(self.numbers, level.recall, missing))
            found, missing = [x for x in recalled.values() if x is not None], [part for part, x in recalled.items() if x is None]
            self.misses_left -= len(missing)
        if missing:
            found += self.context.runJob(self.columns, level.read, missing)
        self.met = True
        return [x for of in found for x in of]

    def close(self) -> None:
        self.numbers.unpersist()
        self.columns.unpersist()


def best_splits(key, g, h, totals: np.ndarray, span: int, penalty: float, least_weight: float):
    """Best split of each slot (class and node) from sums by ``slot * span + feature * BINS + bin``.

    ``(slot, gain, feature, bin, zeros_left, left_g, left_h)`` arrays; slots without a split that
    gains are left out.
    """
    if not len(key):
        return [np.empty(0)] * 7
    if (key[1:] <= key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, g, h = key[order], g[order], h[order]
        heads = _heads(key)
        key, g, h = key[heads], np.add.reduceat(g, heads, dtype=float), np.add.reduceat(h, heads, dtype=float)
    # Whole columns (slot and feature), so many at a time that what is worked out stays in the cache.
    columns = _heads(key // BINS)
    cuts = columns[_heads(columns // SCANNED)]
    found = [_scan(key[a:b], g[a:b], h[a:b], totals, span, penalty, least_weight) for a, b in zip(cuts, [*cuts[1:], len(key)])]
    slot, gain, *rest = (np.concatenate(x) for x in zip(*found))
    # Of a slot's equal gains the first is kept, as in one scan.
    order = np.lexsort((np.arange(len(slot)), -gain, slot))
    chosen = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
    return [slot[chosen], gain[chosen], *(x[chosen] for x in rest)]


def _scan(key, g, h, totals: np.ndarray, span: int, penalty: float, least_weight: float):
    """:func:`best_splits` of ascending, distinct keys."""
    column = key // BINS
    starts = _heads(column)
    sizes = np.diff(np.append(starts, len(key)))
    slots = column[starts] // (span // BINS)
    run_g, run_h = np.cumsum(g), np.cumsum(h)
    before_g, before_h = run_g[starts] - g[starts], run_h[starts] - h[starts]
    ends = starts + sizes - 1
    total_g, total_h = totals[0][slots], totals[1][slots]
    zero_g, zero_h = total_g - (run_g[ends] - before_g), total_h - (run_h[ends] - before_h)
    low_g, low_h = run_g - np.repeat(before_g, sizes), run_h - np.repeat(before_h, sizes)
    all_g, all_h = np.repeat(total_g, sizes), np.repeat(total_h, sizes)

    def gains(left_g, left_h):
        right_g, right_h = all_g - left_g, all_h - left_h
        with np.errstate(divide="ignore", invalid="ignore"):
            out = left_g * left_g / (left_h + penalty) + right_g * right_g / (right_h + penalty)
        out[np.minimum(left_h, right_h) < (least_weight or np.finfo(float).tiny)] = -1.0  # nor is an empty side one
        return out

    apart = gains(low_g, low_h)
    joined = gains(low_g + np.repeat(zero_g, sizes), low_h + np.repeat(zero_h, sizes))
    most = np.maximum(apart, joined)
    # The first key of each slot's greatest gain.
    turns = _heads(slots)
    heads = starts[turns]
    top = np.maximum.reduceat(most, heads)
    of, sizes = slots[turns], np.diff(np.append(heads, len(key)))
    chosen = np.flatnonzero(most == np.repeat(top, sizes))
    chosen = chosen[np.searchsorted(chosen, heads)]
    gain = most[chosen] - totals[0][of] ** 2 / (totals[1][of] + penalty)
    kept = (most[chosen] >= 0) & (gain > LEAST_GAIN)
    chosen, of, gain = chosen[kept], of[kept], gain[kept]
    code, zeros = key[chosen] % span, joined[chosen] > apart[chosen]
    at = np.searchsorted(starts, chosen, side="right") - 1
    return [of, gain, code // BINS, code % BINS, zeros, low_g[chosen] + zero_g[at] * zeros, low_h[chosen] + zero_h[at] * zeros]


def _slopes(p: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the logistic loss, rows last.

    As multiples of a power of two so small that sums over all rows are exact: equal splits gain
    the same in whichever order and task they are summed up, and the first one is taken.
    """
    unit = 2.0 ** (p.shape[-1].bit_length() - 50)
    return np.rint((p - truth) / unit) * unit, np.maximum(np.rint(p * (1 - p) / unit), 1) * unit


@dataclass(frozen=True)
class BoostedTrees:
    """Settings of the fit: rounds, depth, learning rate, L2 penalty, least hessian of a child."""

    trees: int = fixed.BOOSTED_TREES
    depth: int = fixed.BOOSTED_DEPTH
    rate: float = fixed.BOOSTED_RATE
    penalty: float = 1.0
    least_weight: float = 1.0
    bins: int = BINS

    def fit(self, train: DataFrame, classes: Sequence[str], features: str = "features", labels: str = "labels") -> "TreesModel":
        width = max(feature_count(train, features), 1)
        blocks = settled(to_blocks(train, classes, features, labels), "blocks")
        starts, targets, cells = _outlined(blocks, len(classes), width)
        n, positives = len(targets), targets.sum(axis=0, dtype=np.int64)
        live = np.nonzero((positives > 0) & (positives < n))[0]
        rate = positives[live] / max(n, 1)
        forest, losses = Forest(np.log(rate / (1 - rate)), self.depth), np.empty((0, len(live)))
        cuts = Cuts(np.zeros(width + 1, np.int64), np.empty(0))
        if len(live):
            parts, part = _parts(cells, blocks.sparkSession.sparkContext.defaultParallelism)
            dealt = _dealt(blocks, len(classes), n, starts, parts, part)
            cuts, columns = _cuts(dealt, parts, n, width, self.bins), _Parts(_columns(dealt, n, self.bins), parts)
            try:
                forest, losses = self._boost(columns, forest, np.ascontiguousarray(targets[:, live].T), width * BINS)
            finally:
                columns.close()
        return TreesModel(list(classes), positives, n, live, forest, cuts, losses, self)

    def _boost(self, columns: _Parts, forest: Forest, truth: np.ndarray, span: int) -> tuple[Forest, np.ndarray]:
        """All trees, and each class's loss before every one and after the last."""
        margins = np.repeat(forest.base[:, None], truth.shape[1], axis=1)
        losses, sent = [_loss(margins, truth)], columns.context.broadcast(truth)
        for _ in range(self.trees):
            tree, places = self._tree(columns, margins, truth, sent, span)
            for k, place in enumerate(places):
                margins[k] += tree.value[0, k][place]
            losses.append(_loss(margins, truth))
            forest = _joined(forest, tree)
        sent.destroy()
        return forest, np.array(losses)

    def _tree(self, columns: _Parts, margins: np.ndarray, truth: np.ndarray, truth_sent: Broadcast, span: int) -> tuple[Forest, np.ndarray]:
        """The next tree of every class, and the node each row comes to in it (classes x rows)."""
        tree, places = Forest(np.zeros(len(margins)), self.depth), np.zeros(margins.shape, np.int32)
        tree.grow()
        p = _probability(margins)
        g, h = _slopes(p, truth)
        tree.value[0, :, 0] = -self.rate * g.sum(axis=1) / (h.sum(axis=1) + self.penalty)
        sent, going = columns.context.broadcast(p), range(len(margins))
        for level in range(self.depth):
            count, first = 1 << level, (1 << level) - 1
            stands = {}
            for k in going:
                slot = np.where(places[k] >= first, places[k] - first, count)
                totals = np.stack([np.bincount(slot, x[k], count + 1)[:count] for x in (g, h)])
                # Either side of a split has the least weight.
                heavy = np.append(totals[1] >= 2 * self.least_weight, False)
                if heavy.any():
                    stands[k] = np.where(heavy[slot], slot, count).astype(np.min_scalar_type(count)), totals
            if not stands:
                break
            found = columns.ask(_Level(columns.fit, sent, truth_sent, stands, span, self.penalty, self.least_weight))
            going = sorted({k for k, *_ in found})
            for k in going:
                splits = [(of, bits) for label, of, bits in found if label == k]
                self._grow(tree, places[k], k, first, stands[k], splits)
            if not going:
                break
        sent.destroy()
        return tree, places

    def _grow(self, tree: Forest, place: np.ndarray, k: int, first: int, stands: tuple, splits: list[tuple[list[tuple], bytes]]) -> None:
        """Split the nodes of a level by the best of the tasks' splits, and move their rows on."""
        slot, totals = stands
        best = {}
        for task, (of, _) in enumerate(splits):
            for at, gain, feature, *rest in of:
                best[at] = max(best.get(at, (-np.inf,)), (gain, -feature, task, *rest))
        owner, zeros_left = np.full(totals.shape[1] + 1, -1), np.zeros(totals.shape[1] + 1, bool)
        for at, (_, feature, task, cut, zeros, left_g, left_h) in best.items():
            node, owner[at], zeros_left[at] = first + at, task, zeros
            tree.feature[0, k, node], tree.bin[0, k, node], tree.zeros_left[0, k, node] = -feature, cut, zeros
            right_g, right_h = totals[:, at] - (left_g, left_h)
            tree.value[0, k, 2 * node + 1] = -self.rate * left_g / (left_h + self.penalty)
            tree.value[0, k, 2 * node + 2] = -self.rate * right_g / (right_h + self.penalty)
        owners = owner[slot]
        for task, (_, bits) in enumerate(splits):
            rows = np.flatnonzero(owners == task)
            parted = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(slot))[rows].astype(bool)
            place[rows] = 2 * place[rows] + 1 + (parted == zeros_left[slot[rows]])


def _joined(one: Forest, two: Forest) -> Forest:
    both = Forest(one.base, one.depth)
    for name in ("feature", "bin", "zeros_left", "value"):
        setattr(both, name, np.concatenate([getattr(one, name), getattr(two, name)]))
    return both


def boosted_trees(**settings) -> BoostedTrees:
    """M9: gradient-boosted trees over histogram splits, logistic loss."""
    return BoostedTrees(**settings)


@dataclass(frozen=True)
class TreesModel:
    """Fitted trees of the classes that vary; the others are constant."""

    classes: list[str]
    positives: np.ndarray
    n: int
    live: np.ndarray
    forest: Forest
    cuts: Cuts
    losses: np.ndarray
    settings: BoostedTrees

    def transform(self, df: DataFrame, output: str = "predicted", scores: str = "scores", features: str = "features") -> DataFrame:
        """Add ``scores array<double>`` (log odds) and ``predicted array<int>``. No shuffle."""
        indices, values = vector_cells(F.col(features))
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def margins(at: pd.Series, of: pd.Series) -> pd.Series:
            return pd.Series(list(sent.value.scores(at, of)))

        return df.withColumn(scores, margins(indices, values)).withColumn(
            output, F.transform(scores, lambda s: (s > 0).cast("int"))
        )

    def scores(self, indices: Sequence[np.ndarray], values: Sequence[np.ndarray]) -> np.ndarray:
        """Log odds of rows given as indices and values of their cells."""
        sizes = np.array([len(i) for i in indices])
        out = np.tile(np.where(self.positives > 0, np.inf, -np.inf), (len(sizes), 1))
        if not len(sizes) or not len(self.live):
            return out
        at, of = np.concatenate(list(indices)), np.concatenate(list(values))
        owner, stored = np.repeat(np.arange(len(sizes)), sizes), of != 0
        at, of, owner = at[stored].astype(np.int64), of[stored], owner[stored]
        codes = at * BINS + self.cuts.bins(at, of)
        order = np.argsort(codes, kind="stable")
        margins = np.tile(self.forest.base, (len(sizes), 1))
        self.forest.add(margins, codes[order], owner[order], 0, len(self.forest))
        out[:, self.live] = margins
        return out
