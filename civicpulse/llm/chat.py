r"""Chat formatting: a finite-state machine over roles, and segments with loss flags.

A ``Template`` says, as data, which roles may follow which, what opens and closes a role's
turn, and whose text is learned. Each turn becomes segments ``(text, loss)``; the
formatted conversation is their concatenation. Control strings inside a text get a
backslash after their first character, and backslashes are doubled, so a text never
holds a control string and unescaping gives it back exactly.

Rows are dealt out by range of (conversation, turn, ...), so even a conversation that holds
a large part of all rows is formatted by many tasks. A task that starts inside one does not
know the machine's state; it carries the state after each turn for every state before its
stretch, and stretches are composed afterwards, a row per task and conversation. Only the
digests of such a conversation, which are sequential by nature, are read by one task, as a
stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.session import via_table

SEGMENTS = "array<struct<text:string,loss:boolean>>"
TURNS_SCHEMA = f"conv_id long, part int, place long, states array<int>, segments {SEGMENTS}"
DIGEST_SCHEMA = (
    "conv_id long, part int, states array<int>, n_turns long, turns_sha256 string, "
    "loss_chars long, loss_sha256 string, formatted_chars long"
)
_ARROW_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


@dataclass(frozen=True)
class Turn:
    """What stands around a role's text, and whether the text is learned."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, the order of roles, and how any other role is written.

    ``follows`` maps the role before (empty at the start) to the roles that may come next,
    ``ends`` are the roles a conversation may end with. Another role is spelled out in its
    turn, before ``divider``, and is never in order.
    """

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", loss=True),
        }
    )
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
        }
    )
    ends: tuple[str, ...] = ("assistant",)
    other: Turn = Turn("[ROLE]", "[/ROLE]")
    divider: str = "[TEXT]"

    def __post_init__(self):
        controls = self.controls
        if len(set(controls)) != len(controls):
            raise ValueError("two control strings are equal")
        for one in controls:
            if len(one) < 2 or "\\" in one:
                raise ValueError(f"control string {one!r} is too short or holds a backslash")
            for two in controls:
                borders = any(one.endswith(two[:n]) for n in range(1, min(len(one), len(two) + 1)))
                if borders or (one != two and one in two):
                    raise ValueError(f"{one!r} and {two!r} may run into each other")

    @property
    def controls(self) -> list[str]:
        marks = [m for t in [*self.turns.values(), self.other] for m in (t.opens, t.closes)]
        return [*marks, self.divider]

    @cached_property
    def _inside(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, self.controls)) + r")(?s:.)")

    @cached_property
    def _turn(self) -> re.Pattern:
        known = [f"{re.escape(t.opens)}(.*?){re.escape(t.closes)}" for t in self.turns.values()]
        other = f"{re.escape(self.other.opens)}(.*?){re.escape(self.divider)}(.*?){re.escape(self.other.closes)}"
        return re.compile("|".join([*known, other]), re.DOTALL)

    def escape(self, text: str) -> str:
        return self._inside.sub(r"\g<0>\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[dict]:
        """The segments of one turn."""
        turn, opens = self.turns.get(role), None
        if turn is None:
            turn, opens = self.other, self.other.opens + self.escape(role) + self.divider
        return [
            {"text": opens or turn.opens, "loss": False},
            {"text": self.escape(text), "loss": turn.loss},
            {"text": turn.closes, "loss": False},
        ]

    def read_turns(self, formatted: str) -> list[tuple[str, str]]:
        """``(role, text)`` of every turn in a formatted string."""
        roles, found, at = list(self.turns), [], 0
        while at < len(formatted):
            match = self._turn.match(formatted, at)
            if match is None:
                raise ValueError(f"no turn begins at {at}")
            at = match.end()
            number = match.lastindex - 1
            if number < len(roles):
                found.append((roles[number], self.unescape(match[number + 1])))
            else:
                found.append((self.unescape(match[number]), self.unescape(match[number + 1])))
        return found

    @cached_property
    def states(self) -> list[str]:
        return [*self.follows, "out of order"]

    @cached_property
    def _steps(self) -> dict[str, list[int]]:
        out = len(self.follows)
        return {
            role: [*[self.states.index(role) if role in after else out for after in self.follows.values()], out]
            for role in self.follows
            if role
        }

    def step(self, states: list[int], role: str) -> list[int]:
        """States after a turn of ``role``, of the states before it."""
        steps = self._steps.get(role)
        return [steps[s] for s in states] if steps else [len(self.follows)] * len(states)

    @property
    def accepted(self) -> list[int]:
        return [self.states.index(role) for role in self.ends]


_NONE = object()


def _formatted(template: Template):
    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        every = list(range(len(template.states)))
        last, states = _NONE, every
        for batch in batches:
            convs = batch.column(0).to_pylist()
            after, rows = [], []
            for conv, role, text in zip(convs, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                states = template.step(every if conv != last else states, role)
                last = conv
                after.append(states)
                rows.append(template.segments(role, text))
            n = len(convs)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([part] * n, pa.int32()),
                    pa.array(range(place, place + n), pa.int64()),
                    pa.array(after, pa.list_(pa.int32())), pa.array(rows, _ARROW_SEGMENTS),
                ],
                ["conv_id", "part", "place", "states", "segments"],
            )
            place += n

    return formatted


def _in_order(rows: DataFrame) -> DataFrame:
    keys = ["conv_id", "turn", "role", "mark", "row"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), text.alias("text"),
        F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("row"),
    )


def format_turns(
    conversations: DataFrame,
    template: Template = Template(),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv_id, part, place, states, segments)``: a formatted turn per row, in order of (part, place).

    Rows of a conversation are taken by turn (null first), ties by role and hash of the
    text; null roles and texts are empty, null ids are one conversation. ``states`` is the
    machine's state after the turn, for each state before the conversation's first turn in
    this part. Other columns are ignored, an empty table gives none.
    """
    return _turns(_in_order(_rows(conversations, id_col, turn_col, role_col, text_col)), template)


def _turns(ordered: DataFrame, template: Template) -> DataFrame:
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted(template), TURNS_SCHEMA)


def _digests(template: Template):
    names = [part.split()[0] for part in DIGEST_SCHEMA.split(", ")]
    types = pa.schema(
        [
            ("conv_id", pa.int64()), ("part", pa.int32()), ("states", pa.list_(pa.int32())), ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, states = _NONE, 0, []
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def row() -> tuple:
            return conv, part, states, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        for batch in batches:
            done = []
            for key, place, after, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "states", "segments"))):
                if key != conv:
                    if conv is not _NONE:
                        done.append(row())
                    conv, turns, loss, counts = key, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                part, states = place, after
                formatted = "".join(s["text"] for s in segments)
                learned = "".join(template.unescape(s["text"]) for s in segments if s["loss"])
                for role, text in template.read_turns(formatted):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    counts[0] += 1
                loss.update(learned.encode("utf-8", "replace"))
                counts[1] += len(learned)
                counts[2] += len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), types)], names)
        if conv is not _NONE:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), types)], names)

    return digests


def read_digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """What is read back from ``turns`` in their order: a row per conversation and part."""
    return turns.mapInArrow(_digests(template), DIGEST_SCHEMA)


def conversation_digests(conversations: DataFrame, template: Template = Template(), **columns) -> DataFrame:
    """Format all ``conversations`` and read them back: one row each, and whether its order is ``valid``.

    Null ids are one conversation; an empty table gives none; see ``format_turns``.
    """
    names = {"id_col": "conv_id", "turn_col": "turn", "role_col": "role", "text_col": "text"} | columns
    stretches = via_table(read_digests(format_turns(conversations, template, **names), template), "stretches")
    end = F.aggregate(
        F.array_sort(F.collect_list(F.struct("part", "states"))), F.lit(0), lambda s, x: x["states"][s]
    )
    whole = stretches.groupBy("conv_id").agg(
        F.count("*").alias("stretches"), end.isin(template.accepted).alias("valid"),
        F.sum("n_turns").alias("n_turns"), F.sum("loss_chars").alias("loss_chars"),
        F.sum("formatted_chars").alias("formatted_chars"), F.first("turns_sha256").alias("turns_sha256"),
        F.first("loss_sha256").alias("loss_sha256"),
    )
    whole = via_table(whole, "conversations")
    # Conversations that cross from one task to the next: fewer than there are tasks.
    cut = F.broadcast(whole.where("stretches > 1").select(F.col("conv_id").alias("cut"), "valid"))
    same = F.col("conv_id").eqNullSafe(F.col("cut"))
    again = _rows(conversations, **names).join(cut, same, "left_semi")
    again = again.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "row")
    again = read_digests(_turns(again, template), template).drop("part", "states").join(cut, same).drop("cut")
    return whole.where("stretches = 1").drop("stretches").unionByName(again)
