"""License scans: ordered signature rules over whole texts, DataFrame functions only.

Each licence has rules for its SPDX tags, address, full name, a grant ("licensed under the
...") and a guarded short name; their table gives a few hundred regexes. A text
first has to hold a word that any notice holds, then each rule its own keyword,
before a regex is run. Detections are intervals of the text; one inside another of
equal or higher priority is suppressed, so "GNU General Public License, version 3" is
not also "GNU General Public License". Only interval rows are shuffled, never texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.llm.fixed_lists import LICENSE_PHRASES, LICENSES
from civicpulse.session import via_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
VERBS = "licensed|released|distributed|available|published|covered"
GRANTED = rf"(?:{VERBS})(?: \w+){{0,3}} (?:under|by) "
# A text without any of these holds no notice; every rule's pattern implies one of them.
GATE = (
    r"(?i)licen|spdx|public ?domain|rights reserved|proprietary|creative ?commons|gnu\.org|copyright"
    r"|mit no attribution|zero[ -]clause|mozilla\.org|eclipse\.org|wtfpl\.net|sil\.org|joinup\.ec"
    rf"|{GRANTED}"
)
# Priorities by kind of rule, and the confidence that a detection of it gives.
TAG, ADDRESS, GRANT, NAME, SHORT = 5, 4, 3, 2, 1
CONFIDENCE = {TAG: 1.0, ADDRESS: 0.95, GRANT: 0.9, NAME: 0.8, SHORT: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str
    keywords: list[str]  # a match holds one of them
    priority: int


def _literal_head(regex: str) -> str:
    """The plain characters that every match of an address starts with."""
    head = re.match(r"(?:[\w/-]|\\\.)*(?![?*{])", regex)[0]
    return head.replace("\\.", ".")


def signature_rules() -> list[Rule]:
    """All rules in order: a later one of equal priority gives way."""
    rules = []
    for label, ids, name, short, address, keywords in LICENSES:
        for spdx in ids:
            rules.append(Rule(label, rf"spdx-license-identifier:\s{{0,9}}{spdx.replace('.', r'\.')}(?![\w.-])", ["spdx"], TAG))
        rules.append(Rule(label, rf"(?:https?://)?(?:www\.)?{address}", [_literal_head(address)], ADDRESS))
        grant = rf"{GRANTED}(?:the )?(?:terms of )?(?:the )?"
        rules.append(Rule(label, rf"\b{grant}(?:{name}|{short}\b(?! ?[\d-])(?: licen[cs]e)?)", keywords, GRANT))
        rules.append(Rule(label, rf"\b(?:{name})", keywords, NAME))
        rules.append(Rule(label, rf"\b(?:{short}) licen[cs]e|\blicen[cs]e:? {{0,4}}(?:{short})(?![\w.-])", keywords, SHORT))
    return rules


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """Array of (word, label) structs, one per place where a phrase stands."""
    def at(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in sorted(phrases.items(), key=lambda x: -len(x[0].split())):
            first, *rest = phrase.split()
            here = w == first
            for step, term in enumerate(rest, 1):
                here = here & (F.get(words, i + step) == term)
            found = F.when(here, F.lit(label)).otherwise(found)
        return F.struct(i.alias("word"), found.alias("label"))

    return F.filter(F.transform(words, at), lambda x: x["label"].isNotNull())


def _hits(text: Column, rules: list[Rule]) -> Column:
    """Array of (rule, gaps, sizes): lengths of the text between and within its matches."""
    groups: dict[tuple[str, ...], list[Column]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(tuple(r.keywords), []).append(F.struct(F.lit(i).alias("rule"), F.lit(r.regex).alias("regex")))
    table = F.array(
        *[F.struct(F.array(*map(F.lit, words)).alias("keywords"), F.array(*of).alias("rules")) for words, of in groups.items()]
    )

    def found(r: Column) -> Column:
        return F.struct(
            r["rule"].alias("rule"),
            F.transform(F.split(text, r["regex"], -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all(text, r["regex"], F.lit(0)), F.length).alias("sizes"),
        )

    held = F.filter(table, lambda g: F.exists(g["keywords"], lambda word: F.contains(text, word)))
    tried = F.transform(F.flatten(F.transform(held, lambda g: g["rules"])), found)
    return F.filter(tried, lambda h: F.size(h["sizes"]) > 0)


def _gate(phrases: dict[str, str]) -> str:
    """``GATE``, widened by a word of every phrase of which no word implies it."""
    more = [max(p.split(), key=len) for p in phrases if not any(re.search(GATE, word) for word in p.split())]
    return "|".join([GATE, *map(re.escape, more)])


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    rules: list[Rule] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents and detections. Rules of one's own have to match texts that pass ``GATE`` only.

    Documents, one row per row of ``docs``: ``row, id, n_words, places`` (word and label of
    every phrase). Detections: ``row, start, stop, label, priority`` (characters of the
    text) after suppression. A null or empty text has neither; repeated rows each come back.
    """
    phrases = LICENSE_PHRASES if phrases is None else phrases
    rules = signature_rules() if rules is None else rules
    text = F.coalesce(F.col(text_col), F.lit(""))
    gated = docs.select(
        F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
        F.when(text.rlike(_gate(phrases)), lowered(text)).alias("lower"),
    )
    places = _phrase_places(F.regexp_extract_all("lower", F.lit(WORD), F.lit(0)), phrases)
    none_places, none_hits = "array<struct<word:int,label:string>>", "array<struct<rule:int,gaps:array<int>,sizes:array<int>>>"
    scanned = via_table(
        gated.select(
            F.monotonically_increasing_id().alias("row"), "id", "n_words",
            F.coalesce(F.when(F.col("lower").isNotNull(), places), F.array()).cast(none_places).alias("places"),
            F.coalesce(F.when(F.col("lower").isNotNull(), _hits(F.col("lower"), rules)), F.array()).cast(none_hits).alias("hits"),
        ),
        "scanned",
    )
    return scanned.select("row", "id", "n_words", "places"), _resolved(scanned, rules)


def _resolved(scanned: DataFrame, rules: list[Rule]) -> DataFrame:
    """Intervals of all matches, without those inside one of equal or higher priority."""
    known = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority")) for r in rules])
    one = scanned.select("row", F.explode("hits").alias("hit")).select(
        "row", F.col("hit.rule").alias("rule"), F.posexplode(F.arrays_zip("hit.gaps", "hit.sizes")).alias("nth", "part")
    )
    along = Window.partitionBy("row", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("part.gaps") + F.coalesce(F.col("part.sizes"), F.lit(0))).over(along), F.lit(0))
    spans = (
        one.withColumn("start", passed + F.col("part.gaps"))
        .where("part.sizes IS NOT NULL")
        .select("row", "rule", "start", (F.col("start") + F.col("part.sizes")).alias("stop"), known[F.col("rule")].alias("known"))
        .select("row", "rule", "start", "stop", "known.label", "known.priority")
    )
    order = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("priority"), "rule")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = {
        p: F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(earlier) for p in sorted(CONFIDENCE)
    }
    spans = spans.select("*", *[reach[p].alias(f"reach_{p}") for p in reach])
    # Equal intervals: the higher priority, then the earlier rule, comes first in this order.
    inside = F.lit(False)
    for p in reach:
        inside = inside | ((F.col("priority") == p) & (F.coalesce(f"reach_{p}", F.lit(-1)) >= F.col("stop")))
    return spans.where(~inside).drop("rule", *[f"reach_{p}" for p in reach])


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: phrase places, labels of both kinds, and a score.

    The score is the confidence of the surest detection, at least 0.8 where a phrase
    stands, 0 where there is none.
    """
    scanned, found = scan_licenses(docs, id_col, text_col)
    confidence = F.lit(0.0)
    for priority, value in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == priority, F.lit(value)).otherwise(confidence)
    per_row = found.groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max(confidence).alias("surest"), F.count("*").alias("n_detections")
    )
    none = F.array().cast("array<string>")
    words = F.transform("places", lambda p: p["word"].cast("long"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    joined = scanned.join(per_row, "row", "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", none))), ",").alias("labels"),
        F.greatest(
            F.coalesce("surest", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(0.8)).otherwise(F.lit(0.0))
        ).alias("score"),
        F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )
