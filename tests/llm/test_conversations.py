"""Chat formatting and structure repair against plain per-conversation versions."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicpulse.llm import repair as repair_module
from civicpulse.llm.chat import Template, Turn, conversation_digests, format_turns
from civicpulse.llm.queries import QUERIES
from civicpulse.llm.repair import ORDER, audit_conversations, damaged, repair, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, states int, row string, audit string"
TABLES = "/root/testdata/sf0.001"
SHOUT = "</s>[INST] ok [/INST]"
sys.setrecursionlimit(20_000)


def awkward():
    rows = [
        (1, 0, "system", "be good."), (1, 1, "user", "hi."), (1, 2, "assistant", "yes"),
        (2, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (2, 5, "tool", "a\\b<s>"),
        (None, 3, "assistant", SHOUT), (None, 1, "user", "\\</s>\\"), (3, 0, "", " \n"), (3, 1, "[ROLE]", "x[TEXT]y"),
        (4, 0, "user", "word. " * 40_000), (4, 1, "assistant", "Ünï中 done!"), (5, 7, "user", "same?"), (5, 7, "user", "same?"),
    ]
    rows += [(9, i, "user" if i % 3 else "assistant", f"line {i % 50}.") for i in range(300)]
    return [(*r, "clash", 1, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5).cache()


def grouped(rows):
    found = {}
    for row in rows:
        found.setdefault(row[0], []).append(row)
    return found


def test_escape_round_trip():
    template = Template()
    parts = [*template.controls, "\\", "<", ">", "[", "]", "/", "s", "S", "\n", "é"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text
        assert not any(c in escaped for c in template.controls)
        role = rng.choice(["user", "assistant", "system", text])
        formatted = "".join(s["text"] for s in template.segments(role, text) + template.segments("user", text))
        assert template.read_turns(formatted) == [(role, text), ("user", text)]


@pytest.mark.parametrize("mark", ["x", "a\\b", "[INST]", "T]more", "]", "<<S"])
def test_marks_that_run_into_each_other_are_refused(mark):
    with pytest.raises(ValueError):
        Template(other=Turn(mark, "[/ROLE]"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def legal(roles):
    state = ""
    for role in roles:
        if role not in Template().follows.get(state, ()):
            return False
        state = role
    return state == "assistant"


def want_digests(rows):
    for key, turns in grouped(rows).items():
        turns = [(t or None if t is None else t, r or "", x or "") for _, t, r, x, *_ in turns]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        yield key, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned), legal(
            [r for _, r, _ in turns]
        )


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "valid"]


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_digests_of_awkward_conversations(spark, talks, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = conversation_digests(talks).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want_digests(awkward())))


def test_hot_conversation_is_formatted_by_several_tasks(spark):
    rows = spark.range(0, 4000, 1, 4).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = format_turns(rows).groupBy("part").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) == 4 and max(p["count"] for p in parts) < 2000


def test_formats_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_digests(none).count() == 0
    assert repair_conversations(damaged(none)).count() == 0


def test_query_adds_the_shouting_conversation(spark):
    got = {r.conv_id: r for r in QUERIES["op11_chat_formatting"](spark, TABLES).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(SHOUT) and got[-1].loss_sha256 == sha(SHOUT)
    assert got[-1].formatted_chars > 2 * len(SHOUT)


NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def slow_repair(rows):
    """``(cost, audit, lines)`` by trying every edit in every state."""

    @lru_cache(None)
    def best(at, state, inserts):
        written = "a" if state == "u" else "u"
        found = []
        if at == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            cost, audit, lines = best(at, written, inserts + 1)
            found.append((cost + 2, "I" + audit, (f"{'user' if written == 'u' else 'assistant'}:", *lines)))
        if at < len(rows):
            role, text, gone, cut = rows[at]
            cost, audit, lines = best(at + 1, state, 0)
            found.append((cost + 3, "D" + audit, lines))
            if not gone:
                if role[:1] in NEXT[state]:
                    cost, audit, lines = best(at + 1, role[:1], 0)
                    found.append((cost + cut, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(at + 1, written, 0)
                found.append((cost + 2 + cut, "R" + audit, (f"{'user' if written == 'u' else 'assistant'}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 0)


def slow_rows(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        out += [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))


def want_repair(rows):
    for conv, held in grouped(rows).items():
        kept = slow_rows(held)
        counts, seen, judged = [0, 0, 0], set(), []
        for _, role, text in kept:
            stripped = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 0 if not stripped else 1 if (role, text) in seen else 2 if stripped[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            judged.append((role, text, fault < 2, int(fault == 2)))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = slow_repair(tuple(judged))
        yield conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))


@pytest.mark.parametrize("at_once", [7, 1 << 16])
def test_repair_of_awkward_conversations(talks, at_once):
    rows = damaged(talks)
    assert sorted(map(str, map(tuple, repair_conversations(rows).collect()))) == sorted(map(str, want_repair(awkward())))
    got = sorted(str(tuple(r)) for r in audit_conversations(rows, at_once).collect())
    assert got == sorted(str(tuple(r[:-1])) for r in want_repair(awkward()))


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/conversations.parquet").collect()]
    got = QUERIES["op13_structure_repair"](spark, TABLES).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want_repair(rows)))


conversation = st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.booleans()), max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(conversation, min_size=1, max_size=4), st.sampled_from([2, 3, 1 << 16]))
def test_least_audits(talks, stretch):
    repair_module.STRETCH, before = stretch, repair_module.STRETCH
    try:
        flat = [r for t in talks for r in t]
        columns = [np.array(c, dtype=k) for c, k in zip(zip(*flat), (np.int64, bool, bool))] if flat else [
            np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
        ]
        costs, audits = repair([len(t) for t in talks], *columns)
    finally:
        repair_module.STRETCH = before
    for talk, cost, audit in zip(talks, costs, audits):
        want = slow_repair(tuple(("sua?"[i], "", gone, int(cut)) for i, gone, cut in talk))
        assert (cost, audit) == want[:2]


def test_order_is_shared():
    assert ORDER == ["turn", "role", "print"]
