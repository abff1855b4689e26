r"""Conversation structure repair: the cheapest edits to ``(s?(ua)+)?``, found by prefix doubling.

A conversation's edits are a path through nodes (rows taken, state), state being the
initial of the last role written: none, s, u or a. Keep and Rerole take a row and write
it, Delete takes it, Insert writes an empty text. Costs to the end are worked out from the
last row back; arcs that lie on a cheapest path are optimal.

Of all optimal paths the one with the ASCII-least audit (the edits' initials) is wanted.
Nodes are ranked by their least audit of 1, 2, 4, ... edits: the rank of a node at
double the length is that of the pair (its rank, rank of the node its pointer leads to), and
pointers are doubled alongside. A node's optimal arcs bear different initials, so its
least audit of any length leads to one node, and one pointer a length is enough. The
path is then read off the doubled pointers, all its places at once.

Rows are judged where they are read; one row a conversation row without its text goes to
the task that repairs the conversation, many conversations at a time, a longer one in
stretches whose end costs are carried back. The texts meet the audit in a second
pass, which streams them, so a conversation of any number of rows takes some ten bytes a row
in memory (its audit, one cell by contract, takes one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.session import via_table

INITIALS = "sua"
LABELS = np.frombuffer(b"DIKR", np.uint8)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40
# State after writing s, u, a or any other initial in state none, s, u, a; -1 is not allowed.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
# State after the only user or assistant row that may be written: an insert or a rerole.
WRITTEN = np.array([2, 2, 3, 2])
ENDS = np.array([0, FAR, FAR, 0])
BLANKS = " \t\n\x0b\f\r"
STRETCH = 1 << 16
AUDIT_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def damaged(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows ``(conv_id, turn, role, text, lost)`` damaged by the hash of conversation and turn.

    Of ``crc32(conv_id:turn) % 20``, 0 drops the row (``lost``), 1 empties its text, 2 takes
    ``.!?`` out, 3 repeats it, 4 makes it a user's. A null role or text, and a null in the
    hashed string, is one space.
    """
    one = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col(id_col).cast("string"), one), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), one)
    )
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), one).alias("role"), F.coalesce(F.col(text_col), one).alias("text"),
        (F.crc32(key) % 20).alias("way"),
    )
    way = F.col("way")
    return rows.select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (way == 0).alias("lost"), F.explode(F.sequence(F.lit(1), F.when(way == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _print(role: Column, text: Column) -> Column:
    """128 bits that tell (role, text) apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


ORDER = ["turn", "role", "print"]


def _judged(rows: DataFrame) -> DataFrame:
    """What the repair needs of each row; its text stays behind."""
    role, text = F.col("role"), F.col("text")
    rest = F.rtrim(text, F.lit(BLANKS))
    initial = F.instr(F.lit(INITIALS), F.left(role, F.lit(1)))
    return rows.select(
        "conv_id", "turn", "role", _print(role, text).alias("print"), "lost",
        F.when(role == "", 3).when(initial > 0, initial - 1).otherwise(3).cast("tinyint").alias("initial"),
        (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


class Repair:
    """Least cheapest audits of conversations given as concatenated rows.

    ``sizes`` are rows per conversation; ``initial`` (0 to 3), ``gone`` (to be deleted) and
    ``cut`` (costs one more if it stays) belong to rows; ``ends`` are costs of ending in
    each state, per conversation.
    """

    def __init__(self, sizes, initial, gone, cut, ends):
        self.sizes = np.asarray(sizes, np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        self.first = starts + np.arange(len(self.sizes))  # layers: one more than rows each
        self.layers = int(self.sizes.sum() + len(self.sizes))
        at = np.arange(self.sizes.sum()) + np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.stays = np.full(self.layers, FAR)
        self.stays[at] = np.where(gone, FAR, np.where(cut, TRUNCATED, 0))
        self.initial = np.full(self.layers, 3)
        self.initial[at] = initial
        self.cost = np.empty((self.layers, 4), np.int64)
        self._back(np.asarray(ends, np.int64))

    def _arcs(self, layer: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
        """Costs of D, K and R from the nodes of ``layer``, ``below`` being the next layer's costs."""
        after = AFTER[:, self.initial[layer]].T
        kept = np.where(after >= 0, np.take_along_axis(below, np.maximum(after, 0), 1), FAR)
        stays = self.stays[layer][:, None]
        return below + DELETE, kept + stays + KEEP, below[:, WRITTEN] + stays + REROLE

    def _settle(self, cost: np.ndarray) -> np.ndarray:
        """Costs with inserts: two in a row are the most that can help."""
        cost = np.minimum(cost, cost[:, WRITTEN] + INSERT)
        return np.minimum(cost, cost[:, WRITTEN] + INSERT)

    def _back(self, ends: np.ndarray) -> None:
        last = self.first + self.sizes
        self.cost[last] = self._settle(ends)
        order = np.argsort(-self.sizes, kind="stable")
        longer = np.searchsorted(-self.sizes[order], np.arange(-1, -int(self.sizes.max(initial=0)) - 1, -1), side="right")
        for back, count in enumerate(longer.tolist()):
            layer = last[order[:count]] - 1 - back
            taken = self._arcs(layer, self.cost[layer + 1])
            self.cost[layer] = self._settle(np.minimum.reduce(taken))

    def audits(self, entry: np.ndarray, goes_on: bool = False) -> tuple[list[bytes], np.ndarray]:
        """Least audit of each conversation from its entry state, and the state it ends in.

        After the last row only inserts are left; where the rows go on, so do their edits.
        """
        layers = np.arange(self.layers)
        is_last = np.zeros(self.layers, bool)
        is_last[self.first + self.sizes] = True
        below = self.cost[np.minimum(layers + 1, self.layers - 1)]
        deleted, kept, reroled = self._arcs(layers, below)
        inserted = self.cost[:, WRITTEN] + INSERT
        costs = np.stack([deleted, inserted, kept, reroled], 2)
        costs[is_last] = FAR
        if not goes_on:
            costs[is_last, :, 1] = inserted[is_last]
        tight = costs == self.cost[:, :, None]
        node = 4 * layers[:, None] + np.arange(4)
        after = AFTER[:, self.initial].T
        to = np.stack(
            [node + 4, 4 * layers[:, None] + WRITTEN, 4 * (layers[:, None] + 1) + np.maximum(after, 0), 4 * (layers[:, None] + 1) + WRITTEN], 2
        )
        label = np.where(tight.any(2), tight.argmax(2), -1).ravel()
        pointer = np.where(label >= 0, np.take_along_axis(to.reshape(-1, 4), np.maximum(label, 0)[:, None], 1)[:, 0], node.ravel())
        rank, length = label + 1, (label >= 0).astype(np.int64)
        pointers = [pointer]
        start = 4 * self.first + entry
        while (label[pointers[-1][start]] >= 0).any():
            jump = pointers[-1]
            rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
            length = length + length[jump]
            pointers.append(jump[jump])
        steps = length[start]
        owner = np.repeat(np.arange(len(start)), steps)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)
        path = start[owner]
        for bit, jump in enumerate(pointers):
            taken = (place >> bit) & 1 == 1
            path[taken] = jump[path[taken]]
        text = LABELS[label[path]].tobytes()
        bounds = np.concatenate(([0], np.cumsum(steps))).tolist()
        self.rank = rank
        return [text[a:b] for a, b in zip(bounds, bounds[1:])], pointers[-1][start] % 4


def repair(sizes, initial, gone, cut) -> tuple[np.ndarray, list[str]]:
    """``(costs, audits)`` of conversations; those longer than a stretch are done by stretches."""
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    costs, audits = np.zeros(len(sizes), np.int64), [""] * len(sizes)
    short = sizes <= STRETCH
    rows = np.repeat(short, sizes)
    if short.any():
        whole = Repair(sizes[short], initial[rows], gone[rows], cut[rows], np.tile(ENDS, (int(short.sum()), 1)))
        found, _ = whole.audits(np.zeros(int(short.sum()), np.int64))
        for at, text, cost in zip(np.nonzero(short)[0], found, whole.cost[whole.first, 0]):
            costs[at], audits[at] = cost, text.decode()
    for at in np.nonzero(~short)[0]:
        cuts = [slice(a, min(a + STRETCH, starts[at] + sizes[at])) for a in range(starts[at], starts[at] + sizes[at], STRETCH)]

        def stretch(part: slice, ends: np.ndarray) -> Repair:
            return Repair([part.stop - part.start], initial[part], gone[part], cut[part], ends[None])

        ends = [ENDS]
        for part in cuts[:0:-1]:
            ends.append(stretch(part, ends[-1]).cost[0])
        state, text = np.zeros(1, np.int64), []
        for number, (part, end) in enumerate(zip(cuts, ends[::-1])):
            piece = stretch(part, end)
            if number == 0:
                costs[at] = piece.cost[0, 0]
            found, state = piece.audits(state, goes_on=number + 1 < len(cuts))
            text.append(found[0])
        audits[at] = b"".join(text).decode()
    return costs, audits


def _audited(rows_at_once: int):
    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= rows_at_once:
                table = pa.Table.from_batches(held).combine_chunks()
                convs = table.column("conv_id")
                done = _same_as_last(convs)
                if done:  # the last conversation may go on
                    yield _audit(table.slice(0, done))
                    table = table.slice(done)
                held, count = table.to_batches(), 0
        if held:
            yield _audit(pa.Table.from_batches(held).combine_chunks())

    return audited


def _keys(convs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    null = convs.is_null().to_numpy()
    return convs.fill_null(0).to_numpy(), null


def _same_as_last(convs: pa.ChunkedArray) -> int:
    """Where the run of rows of the last conversation begins."""
    ids, null = _keys(convs)
    other = np.nonzero((ids != ids[-1]) | (null != null[-1]))[0]
    return int(other[-1]) + 1 if len(other) else 0


def _audit(table: pa.Table) -> pa.RecordBatch:
    """One row per conversation of rows sorted by conversation and place."""
    ids, null = _keys(table.column("conv_id"))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    conv, n = np.cumsum(fresh) - 1, int(fresh.sum())
    live = ~table.column("lost").to_numpy()
    heads = np.nonzero(fresh)[0]
    conv = conv[live]
    turns, no_turn = _keys(table.column("turn"))
    turns, has_turn = turns[live], ~no_turn[live]
    initial = table.column("initial").to_numpy().astype(np.int64)[live]
    blank, cut = table.column("blank").to_numpy()[live], table.column("truncated").to_numpy()[live]
    prints = table.column("print").combine_chunks().cast(pa.binary(16)).take(pa.array(np.nonzero(live)[0]))
    prints = np.frombuffer(prints.buffers()[1], "<u8", offset=16 * prints.offset, count=2 * len(prints)).reshape(-1, 2)
    order = np.lexsort((np.arange(len(conv)), prints[:, 1], prints[:, 0], conv))
    again = np.zeros(len(conv), bool)
    again[order[1:]] = (conv[order[1:]] == conv[order[:-1]]) & (prints[order[1:]] == prints[order[:-1]]).all(axis=1)
    double = again & ~blank
    cut = cut & ~blank & ~again
    pair = (conv[1:] == conv[:-1]) & ~_legal(initial[:-1], initial[1:])

    def total(mask: np.ndarray, of: np.ndarray = conv) -> np.ndarray:
        return np.bincount(of[mask], minlength=n)

    costs, audits = repair(np.bincount(conv, minlength=n), initial, blank | double, cut)
    gaps = np.zeros(n, np.int64)
    with_turn, turn = conv[has_turn], turns[has_turn]
    if len(turn):  # rows are sorted by turn
        first = np.ones(len(turn), bool)
        first[1:] = with_turn[1:] != with_turn[:-1]
        last = np.append(first[1:], True)
        other = first.copy()
        other[1:] |= turn[1:] != turn[:-1]
        gaps[with_turn[first]] = turn[last] - turn[first] + 1 - total(other, with_turn)[with_turn[first]]
    columns = [gaps, total(blank), total(double), total(cut), total(pair, conv[1:]), costs]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[heads], pa.int64(), mask=null[heads]), *[pa.array(c, pa.int64()) for c in columns], pa.array(audits)],
        [part.split()[0] for part in AUDIT_SCHEMA.split(", ")],
    )


def _legal(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Initials su, ua or au."""
    return ((one == 0) & (two == 1)) | ((one == 1) & (two == 2)) | ((one == 2) & (two == 1))


def audit_conversations(rows: DataFrame, rows_at_once: int = 1 << 16) -> DataFrame:
    """Faults, cost and audit of each conversation of ``rows`` (see ``damaged`` for the columns).

    Rows go by turn (null first), ties by role, then by hash of the text. Rows that are ``lost``
    only name their conversation; without others it has zeros and an empty audit. Null
    ids are one conversation, repeated rows duplicates, an empty table gives none.
    """
    narrow = _judged(rows).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return narrow.select("conv_id", "turn", "print", "lost", "initial", "blank", "truncated").mapInArrow(
        _audited(rows_at_once), AUDIT_SCHEMA
    )


REPAIRED_SCHEMA = AUDIT_SCHEMA + ", repaired_sha256 string"


class _Written:
    """Hash of a conversation that is written row by row as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines = audit, 0, "", 0
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1
        self.state = role[:1]

    def _next(self) -> str:
        return "assistant" if self.state == "u" else "user"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(self._next(), "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        """One row of the conversation, with what is inserted before it."""
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._line(role, text)
        elif edit == "R":
            self._line(self._next(), text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in REPAIRED_SCHEMA.split(", ")]
    kept, written = None, None

    for batch in batches:
        done = []
        columns = [batch.column(n) for n in names[:-1]]
        is_text = batch.column("audit").is_null().to_numpy(zero_copy_only=False)
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        for at in range(batch.num_rows):
            if is_text[at]:
                written.take(roles[at], texts[at])
            else:
                if kept is not None:
                    done.append((*kept, written.digest()))
                kept = [c[at].as_py() for c in columns]
                written = _Written(kept[-1])
        if done:
            yield _summary(done, names)
    if kept is not None:
        yield _summary([(*kept, written.digest())], names)


def _summary(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """``audit_conversations`` with the hash of each repaired conversation, its ``role:text`` lines.

    The audit comes first of its conversation's rows, whose texts then stream past it.
    """
    audits = via_table(audit_conversations(rows), "audits")
    texts = rows.where("NOT lost").select(
        "conv_id", "turn", "role", _print(F.col("role"), F.col("text")).alias("print"), "text", F.lit(1).alias("kind")
    )
    both = audits.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return ordered.drop("kind", "turn", "print").mapInArrow(_repaired, REPAIRED_SCHEMA)
