"""Text to terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicpulse import fixed_values as fixed

# Anything that is neither letter, mark, digit nor underscore separates words.
WORD_BREAK = r"[^\p{L}\p{M}\p{N}_]+"

Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Default tokenizer: split on non-word characters.

    Any function from a text column to an ``array<string>`` column can stand in
    for it, such as a pandas UDF around a dictionary segmenter.
    """
    return F.filter(F.split(text, WORD_BREAK), lambda t: t != "")


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """M5: all n-grams of ``low..high`` words, joined by one blank."""
    # n shifted copies of the token array, zipped: linear in the tokens.
    grams = tokens if low == 1 else F.array().cast("array<string>")
    current = tokens
    for n in range(2, high + 1):
        shifted = F.slice(tokens, F.lit(n), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        # zip_with pads the shorter side with null, and concat_ws would hide it.
        zipped = F.zip_with(current, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        current = F.filter(zipped, lambda g: g.isNotNull())
        if n >= low:
            grams = F.concat(grams, current)
    return grams


def terms(
    text: Column,
    tokenizer: Tokenizer = words,
    ngram_range: tuple[int, int] = fixed.NGRAM_RANGE,
) -> Column:
    """M4 + M5: lower-case, tokenize, n-grams."""
    return ngrams(tokenizer(F.lower(text)), *ngram_range)
