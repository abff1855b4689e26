"""Token ids of whole texts by a public tokenizer, with words encoded once per worker.

The tokenizers split a text into pieces before any merge, so a piece's ids do not hang on
its surroundings. A text is cut at blanks where a piece certainly begins; a cut is
looked up, and only unseen pieces go through the library. Texts in which a cut might not
be a boundary go through it whole. Results equal ``encode`` on the whole text.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words of which a worker begins a new generation; it keeps two.
MOST_WORDS = 350_000
# Texts are cut and numbered in slices of so many bytes.
SLICE_BYTES = 12 << 20
# Texts whose ids are put together at once.
GATHERED = 128
# A blank between white space and white space (or the end) belongs to a longer run; other
# white space than these few is left to the library, as are characters that Python and
# the tokenizers' expressions class differently.
RUN = r"[\t\n\r\f\v ] (?:[\t\n\r\f\v ]|\z)"
# Marks that follow a word as a piece of their own; an apostrophe may belong to a suffix.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Two words at a line break, the second of which begins with a Latin letter.
LINE = r"^[^\n]*[^\s\v]\n[A-Za-zÀ-ÖØ-öø-ÿ][^\n]*\z"
ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others above 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


LATIN = [c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº"]


def _lowers(normalizer) -> bool:
    """Whether words of Latin letters are lower-cased and no more."""
    words = ["".join(LATIN), "".join(reversed(LATIN)), *LATIN]
    return all(normalizer.normalize_str(w) == w.lower() for w in words)


# Ids of many entries in one array, and where each entry starts; the last number is the end.
Ragged = tuple[np.ndarray, np.ndarray]


def _ragged(entries: list[bytes]) -> Ragged:
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 2
    return np.frombuffer(b"".join(entries), "<u2"), np.concatenate(([0], np.cumsum(sizes)))


def _gather(held: Ragged, spots: np.ndarray) -> Ragged:
    """The entries with the given numbers, in this order."""
    ids, stops = held
    sizes = np.diff(stops)[spots]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(stops[spots] - ends[:-1], sizes)
    at += np.arange(len(at))
    return ids.take(at), ends


def _chained(*parts: Ragged) -> Ragged:
    """The entries of all parts, one part after the other."""
    sizes = np.concatenate([np.diff(stops) for _, stops in parts])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))


def _strings(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _last_bytes(strings: pa.Array) -> np.ndarray:
    """The last byte of each string; any for an empty one."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset + 1 : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return np.append(data, 0)[np.maximum(ends, 1) - 1].astype(np.uint8)


class Encoder:
    """Token ids of whole texts as unsigned 16-bit numbers; words seen before are looked up.

    Names of special tokens in a text get their own ids, as the library's defaults have it.
    Vocabularies of more than 65,536 ids are refused.
    """

    def __init__(self, path: str, most_words: int | None = None):
        self.most_words = MOST_WORDS if most_words is None else most_words
        self.tokenizer = load_tokenizer(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.lowers = self.normalizer is not None and _lowers(self.normalizer)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # A text with such a name goes whole; one found after normalization can stand in any text.
        self.names = ["" if t.normalized and self.normalizer is not None else t.content for t in added]
        # Whether white space is dropped, so that every word is encoded alone.
        self.words_end = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.lead = "" if self.words_end else " "
        # Ids of words and marks, with what leads them: those met since the last turn of a
        # generation, and those before. What neither has used is forgotten. Words with marks
        # or line breaks are put together from these; kept as they are they would fill both.
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> str | None:
        """The word as the model sees it; None if normalizing leaves anything but letters."""
        if self.normalizer is not None:
            if self.lowers and (word.isascii() or max(word) <= "ÿ"):
                word = word.lower()
            else:
                word = self.normalizer.normalize_str(word)
            if not word.removeprefix(" ").isalpha():
                return None
        if word.isascii():
            return word.replace(" ", BYTE_LETTERS[32])
        return word.encode().decode("latin-1").translate(BYTE_LETTERS)

    def _unseen(self, word: str) -> bytes | None:
        """Ids of letters, with at most one blank before, that are not among the new words."""
        found = self.old.get(word)
        if found is None:
            letters = self._letters(word)
            if letters is None:
                return None
            found = array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()
        self.new[word] = found
        return found

    def _word(self, word: str) -> bytes | None:
        """Ids of letters with at most one blank before; None if they are no longer letters when normalized."""
        return self.new.get(word) or self._unseen(word)

    def _words(self, words: list[str], lead: str) -> list[bytes | None]:
        """Ids of each word with what leads it; None for what is no word."""
        keys = [lead + word for word in words] if lead else words
        letters = list(map(str.isalpha, words))
        out = list(map(self.new.get, keys))
        for at, found in enumerate(out):
            if not letters[at]:
                out[at] = None
            elif found is None:
                out[at] = self._unseen(keys[at])
        return out

    def _closed(self, cuts: pa.Array, lead: str) -> Ragged:
        """Ids of cuts with what leads them.

        Closing marks are taken off by Arrow, so a word is looked up once whatever follows it;
        what is no word with at most one mark goes cut by cut.
        """
        bare = pc.ascii_rtrim(cuts, characters=MARKS)
        marks = pc.subtract(pc.binary_length(cuts), pc.binary_length(bare)).to_numpy()
        numbered = bare.dictionary_encode()
        entries = self._words(_strings(numbered.dictionary), lead)
        is_word = np.array([found is not None for found in entries], bool)
        entries = [*(found or b"" for found in entries), b""]
        # Two entries for each cut, its word and its mark; the last one is empty.
        spots = np.full((len(cuts), 2), len(entries) - 1)
        spots[:, 0] = numbered.indices.to_numpy()
        single = is_word[spots[:, 0]] & (marks < 2)
        marked = np.flatnonzero(single & (marks == 1))
        closing = _last_bytes(cuts)[marked]
        for mark in np.unique(closing).tolist():
            spots[marked[closing == mark], 1] = len(entries)
            entries.append(self._piece(chr(mark)))
        others = np.flatnonzero(~single)
        spots[others, 0] = np.arange(len(entries), len(entries) + len(others))
        entries += [self._fresh(lead + cut) if lead + cut else b"" for cut in _strings(cuts.take(pa.array(others)))]
        ids, stops = _gather(_ragged(entries), spots.ravel())
        return ids, stops[::2]

    def _look_up(self, cuts: pa.Array) -> Ragged:
        """Ids of what stands between blanks, the first of them included."""
        if len(self.new) >= self.most_words:
            self.old, self.new = self.new, {}
        if self.words_end:
            return self._closed(cuts, "")
        # A line break between two words is a piece of its own.
        lines = pc.match_substring_regex(cuts, LINE)
        one_line = pc.invert(lines)
        parts = pc.split_pattern(cuts.filter(lines), "\n").flatten()
        n, split = len(cuts), len(parts) // 2
        odd = np.arange(2 * split) % 2 == 1
        heads, tails = parts.filter(pa.array(~odd)), parts.filter(pa.array(odd))
        held = _chained(
            self._closed(pa.concat_arrays([cuts.filter(one_line), heads]), self.lead),
            _ragged([b"", self._piece("\n")]),
            self._closed(tails, ""),
        )
        # Three entries for each cut: its first part, the line break, its second part.
        spots = np.full((n, 3), n)
        spots[one_line.to_numpy(zero_copy_only=False), 0] = np.arange(n - split)
        two = lines.to_numpy(zero_copy_only=False)
        spots[two] = np.arange(split)[:, None] * [1, 0, 1] + [n - split, n + 1, n + 2]
        ids, stops = _gather(held, spots.ravel())
        return ids, stops[::3]

    def _fresh(self, cut: str) -> bytes:
        """A word, a word with a closing mark, two parts at a line break, or anything else."""
        body = cut.removeprefix(" ")
        if body.isalpha():
            found = self._word(cut)
            return self._library(cut) if found is None else found
        bare = body.rstrip(MARKS)
        if bare.isalpha():
            marks = body[len(bare) :]
            found = self._word(cut[: -len(marks)])
            # Where the word ends in a mark once normalized, all marks are one piece.
            return self._library(cut) if found is None else found + self._piece(marks)
        head, line, tail = cut.partition("\n")
        if not self.words_end and line and tail[:1].isalpha() and head.strip() and not head[-1].isspace():
            # A line break between two words is a piece of its own.
            return self._fresh(head) + self._piece("\n") + self._fresh(tail)
        return self._piece(cut)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that is no word."""
        found = self.new.get(piece) or self.old.get(piece) or self._library(piece)
        self.new[piece] = found
        return found

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of an Arrow array; a null text has none.

        The texts are cut and their cuts numbered by Arrow; each different cut of the
        batch is looked up once.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(lengths, np.arange(SLICE_BYTES, lengths[-1] if len(lengths) else 0, SLICE_BYTES))
        bounds = np.unique([0, *cuts.tolist(), len(texts)]).tolist()
        return [ids for a, b in zip(bounds, bounds[1:]) for ids in self._encode_slice(texts.slice(a, b - a))]

    def _encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        # A copy: Arrow's list offsets of a slice start inside its parent.
        texts = pa.concat_arrays([texts])
        whole = pc.match_substring_regex(texts, ODD)
        for name in self.names:
            whole = pc.or_(whole, pc.match_substring(texts, name))
        if not self.words_end:
            whole = pc.or_(whole, pc.match_substring_regex(texts, RUN))
        whole = whole.to_numpy(zero_copy_only=False)
        if self.words_end:
            cuts = pc.ascii_split_whitespace(texts)
        else:
            cuts = pc.split_pattern(texts, " ")
        offsets = cuts.offsets.to_numpy()
        numbered = cuts.values.dictionary_encode()
        number, different = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary
        fast = np.repeat(~whole, np.diff(offsets))
        first = np.zeros(len(number), bool)
        if not self.words_end:
            first[offsets[:-1][np.diff(offsets) > 0]] = True  # no blank precedes these
        later = fast & ~first
        used = np.zeros(len(different), bool)
        used[number[later]] = True
        held = self._look_up(different.filter(pa.array(used)))
        heads = np.flatnonzero(fast & first)
        head_ids = [self._fresh(cut) if cut else b"" for cut in _strings(different.take(pa.array(number[heads])))]
        # The empty entry stands for the cuts of whole texts.
        held = _chained(held, _ragged([b"", *head_ids]))
        nothing = np.count_nonzero(used)
        spots = np.full(len(number), nothing)
        spots[later] = (np.cumsum(used) - 1)[number[later]]
        spots[heads] = np.arange(nothing + 1, nothing + 1 + len(heads))
        out = []
        for a in range(0, len(texts), GATHERED):
            bounds = offsets[a : a + GATHERED + 1]
            found, ends = _gather(held, spots[bounds[0] : bounds[-1]])
            ends = ends[bounds - bounds[0]].tolist()
            out += [found[b:e] for b, e in zip(ends, ends[1:])]
        for at in np.flatnonzero(whole).tolist():
            out[at] = np.frombuffer(self._library(texts[at].as_py()), "<u2")
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text."""
        return self.encode_batch(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=4)
def encoder(path: str, most_words: int = MOST_WORDS) -> Encoder:
    """One encoder per worker process and vocabulary: its words stay for later tasks."""
    return Encoder(path, most_words)
