"""Counts of one text: words, symbols, repeated lines and word windows, histograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from civicpulse.llm.fixed_lists import (
    BRACKET_CHARS, CHAR_CLASSES, COMMON_WORDS, STOP_CHARS, SYMBOL_CHARS,
)
from civicpulse.llm.words import utf8

WORD_LIST = sorted({w for words in COMMON_WORDS.values() for w in words})
_WORD_AT = {w.encode(): i for i, w in enumerate(WORD_LIST)}
REPEAT_WINDOW = 3


def _class_table() -> np.ndarray:
    """Class number of every byte; of a character beyond ASCII only the first byte counts."""
    at = {name: i for i, name in enumerate(CHAR_CLASSES)}
    table = np.full(256, at["other_ascii"], np.int64)
    table[128:] = at["beyond_ascii"]
    table[0x80:0xC0] = len(CHAR_CLASSES)  # continuation bytes
    for chars, name in (
        ("abcdefghijklmnopqrstuvwxyz", "lower"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
        ("0123456789", "digit"), (" \t\r\x0b\x0c", "blank"), ("\n", "newline"),
        (STOP_CHARS, "stop"), (BRACKET_CHARS, "bracket"), (SYMBOL_CHARS, "symbol"),
    ):
        table[[ord(c) for c in chars]] = at[name]
    return table


_CLASS_OF = np.zeros((256, len(CHAR_CLASSES) + 1), np.int64)
_CLASS_OF[np.arange(256), _class_table()] = 1
_SYMBOLS = [ord(c) for c in SYMBOL_CHARS]
_BLANKS = [9, 10, 11, 12, 13, 32]


def repeated_words(words: list[bytes]) -> int:
    """Words inside any window of three that occurs at least twice in the list."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    base = len(number)
    if base >= 2_000_000:  # three numbers no longer fit one 64-bit value
        pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        codes = pair[:-1] * base + ids[2:]
    else:
        codes = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    again = counts[inverse] >= 2
    covered = np.zeros(len(words), bool)
    for shift in range(REPEAT_WINDOW):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [line for line in raw.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def text_counts(text: str | None) -> dict:
    """All counts of one text; a null text counts like an empty one."""
    raw = utf8(text)
    words = raw.split()
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = octets @ _CLASS_OF
    beyond = int(octets[0x80:0xC0].sum())
    blanks = int(octets[_BLANKS].sum())
    common = [0] * (len(WORD_LIST) + 1)
    find = _WORD_AT.get
    lowered = raw.lower().split()
    for at in map(find, lowered):
        if at is not None:
            common[at] += 1
    common[-1] = len(words) - sum(common)
    return {
        "n_words": len(words),
        "word_chars": len(raw) - beyond - blanks,
        "n_symbols": int(octets[_SYMBOLS].sum()),
        "n_dup_lines": duplicate_lines(raw),
        "n_repeat_words": repeated_words(words),
        "n_distinct": len(set(lowered)),
        "n_lines": raw.count(b"\n") + 1 if raw else 0,
        "char_hist": classes[: len(CHAR_CLASSES)].tolist(),
        "word_hist": common,
    }


COUNTS_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_distinct long, n_lines long, char_hist array<long>, word_hist array<long>"
)
COUNTS_TYPE = pa.struct(
    [
        *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines")],
        ("char_hist", pa.list_(pa.int64())), ("word_hist", pa.list_(pa.int64())),
    ]
)
