"""Word segmentation by a dictionary, for scripts that write no blanks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicpulse.functions.text import Tokenizer, words

MOST_WORDS = 2_000_000
# Pieces whose cuts a worker remembers, and how long they may be.
MOST_CUTS = 200_000
LONGEST_PIECE = 64


class Segmenter:
    """Maximal matching: the cut that leaves fewest characters to no word, then has fewest tokens.

    Of equal cuts the one whose first token is longest is taken, then the second, and so on.
    Adjacent characters that belong to no word are one token. Costs are worked out from the
    end of a text back, over all words that match anywhere, which an automaton finds in one pass.
    """

    def __init__(self, dictionary: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.cuts: dict[str, list[str]] = {}
        for word in dictionary:
            if word:
                self.automaton.add_word(word, len(word))
        if len(self.automaton):
            self.automaton.make_automaton()

    def cut(self, text: str) -> list[str]:
        n = len(text)
        if not n or not len(self.automaton):
            return [text] if n else []
        if text in self.automaton:  # one token and nothing left over: no cut is better
            return [text]
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.automaton.iter(text):
            starts[end + 1 - size].append(end + 1)
        # Cost from a place to the end, as unknown characters * (n + 1) + tokens: after a word, and
        # inside a run that belongs to no word (which pays for its token when it begins).
        unknown = n + 1
        free, inside = [0] * (n + 1), [0] * (n + 1)
        for at in range(n - 1, -1, -1):
            best = min((free[end] for end in starts[at]), default=unknown * unknown) + 1
            skip = unknown + min(inside[at + 1], free[at + 1])
            inside[at] = min(best, skip)
            free[at] = min(best, skip + 1)
        found, at = [], 0
        while at < n:
            best = free[at]
            # The longest token first: a word, or the run of unknown characters.
            ends = [end for end in starts[at] if free[end] + 1 == best]
            run, spent = at, 0
            while run < n:
                run += 1
                spent += unknown
                if spent + 1 + free[run] == best:
                    ends.append(run)
                if spent + 1 > best:
                    break
            end = max(ends)
            found.append(text[at:end])
            at = end
        return found

    def cut_again(self, text: str) -> list[str]:
        """:meth:`cut`, remembered for short pieces; a full memory is begun anew."""
        found = self.cuts.get(text)
        if found is None:
            found = self.cut(text)
            if len(text) <= LONGEST_PIECE:
                if len(self.cuts) >= MOST_CUTS:
                    self.cuts.clear()
                self.cuts[text] = found
        return found

    def cut_all(self, rows: pa.ListArray) -> pa.ListArray:
        """Every row's pieces cut, equal pieces of the rows once; a null row stays null."""
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        pieces = rows.flatten().dictionary_encode()
        cuts = [self.cut_again(p) for p in pieces.dictionary.to_pylist()]
        if not cuts:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(rows) + 1, np.int32), mask=_ends(rows)), pa.array([], pa.string()))
        lengths = np.array([len(c) for c in cuts], np.int64)
        at = pieces.indices.to_numpy()
        tokens = pa.array(cuts, pa.list_(pa.string())).take(pieces.indices).flatten()
        before = np.concatenate(([0], np.cumsum(lengths[at])))
        heads = before[np.concatenate(([0], np.cumsum(sizes)))]
        return pa.ListArray.from_arrays(pa.array(heads.astype(np.int32), mask=_ends(rows)), tokens)


def _ends(rows: pa.Array) -> np.ndarray:
    """Which offsets of a list array are null, so that null rows are."""
    return np.append(rows.is_null().to_numpy(zero_copy_only=False), False)


# One segmenter per dictionary and worker process: it is built once, not once a batch.
_BUILT: dict[str, Segmenter] = {}


def dictionary_tokenizer(dictionary: DataFrame, column: str) -> Tokenizer:
    """A tokenizer that cuts each run of word characters by the words in ``column``.

    The dictionary goes to every worker, so it may hold :data:`MOST_WORDS` words at most; a
    larger one is refused. Plugs in wherever :func:`civicpulse.functions.text.words` does.
    """
    rows = dictionary.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    name, sent = uuid.uuid4().hex, dictionary.sparkSession.sparkContext.broadcast([r[0] for r in rows])

    @F.arrow_udf("array<string>")
    def cut(pieces: pa.Array) -> pa.Array:
        from civicpulse.functions import segment

        built = segment._BUILT.get(name)
        if built is None:
            segment._BUILT.clear()
            built = segment._BUILT[name] = Segmenter(sent.value)
        return built.cut_all(pieces)

    def tokenize(text: Column) -> Column:
        return cut(words(text))

    return tokenize
