"""Byte-level word splitting shared by the operators, fast and exact.

UTF-8 keeps every byte of a non-ASCII character above 0x7F, so rules over ASCII
classes may be applied to bytes. ``bytes.lower`` changes A-Z only and
``bytes.split`` splits on 0x20 and 0x09-0x0D only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

SLICE_ROWS = 500


def _alnum_table() -> bytes:
    """A-Z to a-z; ASCII that is neither digit nor letter to a blank; the rest as it is."""
    table = bytearray(range(256))
    for code in range(128):
        char = chr(code)
        table[code] = ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


ALNUM = _alnum_table()


def utf8(text: str | None) -> bytes:
    """The UTF-8 bytes of a text; a null text is empty, a lone surrogate becomes ``?``."""
    return b"" if text is None else text.encode("utf-8", "replace")


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased."""
    return utf8(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return utf8(text).translate(ALNUM).split()


def by_slices(texts: pa.Array, work: Callable[[Iterator[str | None]], pa.Array]) -> pa.Array:
    """``work`` on a few texts at a time, so that a batch is never there as Python objects whole."""
    parts = [work(t.as_py() for t in texts.slice(at, SLICE_ROWS)) for at in range(0, len(texts), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else work(iter(()))
