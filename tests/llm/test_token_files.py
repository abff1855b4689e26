"""Token ids, rANS files and packing against the plain library."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from civicpulse.llm import tokens
from civicpulse.llm.ans import Table, decode_block, decode_segment, encode_block, read_tokens, write_tokens
from civicpulse.llm.packing import OpenWindows, pack_documents, packed_pieces
from civicpulse.llm.tokens import Encoder
from civicpulse.session import scratch_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    pick = random.Random(5)
    parts = list(" \n\t.,'abXÉß1#|!́\x1c\x85ΣςΩ中²\xa0　") + ["'s", " <|endoftext|>", "  ", "don't", " foo"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(4000)] + [None]
    encode = plain(path)
    assert [i.tolist() for i in Encoder(path).encode_batch(pa.array(texts))] == [encode(t) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_every_character_beside_words_and_marks(path):
    """Letters may normalize to something else: each assigned character, before and after letters and marks."""
    encode, encoder = plain(path), Encoder(path)
    chars = [chr(c) for c in range(0x11_0000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    letters = [c for c in chars if c.isalpha() and c < "\u3400"]
    shapes = [[f"a {c}. {c}b, x{c}\n{c} {c}{c}!" for c in letters], ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]]
    shapes.append(["SAHİBİ.", "İKİ, ÜÇ", "x İ.", "ΟΔΟΣ. ΣΑΣ", "ﬁne, ǅ! ẞ? ŉ. ΐ;", "e\u0301. É́!"])
    for texts in shapes:
        assert [i.tolist() for i in encoder.encode_batch(pa.array(texts))] == [encode(t) for t in texts]


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 5)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 60)
    texts = [f"word{chr(97 + i % 26)} other, lines\nof {chr(97 + i % 11)}b." for i in range(300)]
    for path in (BYTES, WORDS):
        encode, encoder = plain(path), Encoder(path)
        assert [i.tolist() for i in encoder.encode_batch(pa.array(texts))] == [encode(t) for t in texts]
        assert len(encoder.new) < 40 and len(encoder.old) < 40


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_with_marks_and_line_breaks_are_not_taken_cut_by_cut(path, monkeypatch):
    texts = [f"word{chr(97 + i % 26)} other{chr(97 + i % 23)}, lines.\nOf{chr(97 + i % 11)} (so) it is.\nÉta" for i in range(300)]
    encode, encoder, cut_by_cut, fresh = plain(path), Encoder(path), [], Encoder._fresh
    monkeypatch.setattr(Encoder, "_fresh", lambda self, cut: cut_by_cut.append(cut) or fresh(self, cut))
    assert [i.tolist() for i in encoder.encode_batch(pa.array(texts))] == [encode(t) for t in texts]
    # What begins a text, and one bracket.
    assert len(cut_by_cut) <= len(texts) + 1


def plain_coder(numbers, table, lanes, stride):
    """The coder symbol by symbol, in numbers of any size."""
    states, words, kept = [1 << 31] * lanes, [], []
    for row in range(-(-len(numbers) // lanes) - 1, -1, -1):
        out = []
        for lane, symbol in enumerate(numbers[row * lanes : (row + 1) * lanes].tolist()):
            freq, x = int(table.freq[symbol]), states[lane]
            if x >= freq << (63 - int(table.scale)):
                out.append(x & 0xFFFFFFFF)
                x >>= 32
            states[lane] = (x // freq << int(table.scale)) + x % freq + int(table.start[symbol])
        words = out + words
        if row % stride == 0:
            kept = [*states, *kept]
    return np.array(words, "<u4").tobytes(), np.array(kept, "<u8").tobytes()


@pytest.mark.parametrize("size", [0, 1, 300, 1000])
def test_streams_are_those_of_the_plain_coder(size):
    numbers = np.minimum(np.random.default_rng(size).zipf(1.2, size), 60_000).astype(np.uint16)
    symbols, counts = np.unique(numbers, return_counts=True)
    table = Table(dict(zip(symbols.tolist(), counts.tolist())))
    assert encode_block(numbers, table, lanes=16, stride=8)[:2] == plain_coder(numbers, table, 16, 8)


@pytest.mark.parametrize("size", [0, 1, 7, 1024, 5000])
def test_blocks_round_trip_by_segment(size):
    rng = np.random.default_rng(size)
    numbers = np.minimum(rng.zipf(1.3, size), 60_000).astype(np.uint16)
    symbols, counts = np.unique(numbers, return_counts=True)
    table = Table(dict(zip(symbols.tolist(), counts.tolist())))
    stream, states, places, checksums = encode_block(numbers, table, lanes=16, stride=8)
    row = {"n_tokens": size, "stream": stream, "states": states, "places": places, "checksums": checksums}
    assert (decode_block(row, table, 16, 8) == numbers).all()
    if len(places) > 2:  # one segment alone
        part = decode_segment(
            2, size, np.frombuffer(stream, "<u4").astype(np.uint64),
            np.frombuffer(states, "<u8").reshape(-1, 16), places[2], checksums[2], table, 16, 8,
        )
        assert (part == numbers[256:384]).all()
        with pytest.raises(ValueError):
            decode_block(row | {"checksums": [c ^ 1 for c in checksums]}, table, 16, 8)


def test_files_hold_all_documents_in_order(spark, docs):
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, BYTES, block_tokens=20_000)
    got = read_tokens(spark, path).collect()
    encode = plain(BYTES)
    wanted = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = {}
    for r in wanted:
        ids = np.array(encode(r.text) + [0], "<u4").tobytes()
        want.setdefault(r.doc_id, []).append(ids)
    seen = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == seen and len(r.ids) == 4 * r.n_tokens
        assert bytes(r.ids) in want[r.doc_id]
        seen += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in wanted]


def test_no_documents_no_tokens(spark, nothing):
    path = scratch_path(spark, "tokens")
    write_tokens(nothing, path, BYTES)
    assert read_tokens(spark, path).count() == 0
    assert pack_documents(nothing, WORDS).count() == 0


def test_open_windows_choose_the_tightest():
    pick, windows, room = random.Random(1), OpenWindows(100), {}
    for _ in range(3000):
        size = pick.randint(1, 100)
        fits = [r for r in room.values() if r >= size]
        number, offset = windows.put(size)
        left = room.get(number, 100)
        assert left == (min(fits) if fits else 100) and offset == 100 - left
        room[number] = left - size


def test_pieces_cover_every_document_once(docs):
    encode = plain(WORDS)
    want = sorted((r.doc_id or -1, np.array(encode(r.text) + [2], "<u4").tobytes()) for r in docs.collect())
    pieces = packed_pieces(docs, WORDS, batch_tokens=5000).collect()
    windows, texts = {}, {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        texts.setdefault((p.doc_id or -1, p.doc_tokens), []).append((p.start, bytes(p.ids)))
        assert len(p.ids) == 4 * p.length
    for held in windows.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert sorted(windows) == list(range(len(windows)))
    joined = sum(len(b) for held in texts.values() for _, b in held)
    assert joined == sum(len(b) for _, b in want)
    for (key, size), held in texts.items():
        copies = sum(1 for k, b in want if k == key and len(b) == 4 * size)
        starts = sorted({s for s, _ in held})
        body = b"".join(next(b for s, b in held if s == start) for start in starts)
        assert (key, body) in want and len(held) == copies * len(starts)


def test_digest_is_the_checksum_of_the_ids(docs):
    ids = {(r.doc_id, r.start, r.length): zlib.crc32(bytes(r.ids)) for r in packed_pieces(docs, WORDS).collect()}
    for r in pack_documents(docs, WORDS).collect():
        assert ids[r.doc_id, r.start, r.length] == r.ids_crc32


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_names_of_special_tokens_as_the_untouched_library(path):
    pick, tokenizer = random.Random(6), Tokenizer.from_file(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "a", " b", "\n", ".", "ß", "|>"]
    texts = ["a <|endoftext|> b", *("".join(pick.choice(parts) for _ in range(pick.randint(0, 9))) for _ in range(3000))]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(want[0]) < 5
    assert [i.tolist() for i in Encoder(path).encode_batch(pa.array(texts))] == want


def test_queries_keep_the_ids_of_special_tokens(spark, docs):
    import corpus_pipeline
    from civicpulse.llm import queries

    folder = scratch_path(spark, "names")
    docs.write.parquet(f"{folder}/documents.parquet")
    for path, end, rows, size in (
        (BYTES, 0, queries.op3(spark, folder), "n_tokens"), (WORDS, 2, queries.op9(spark, folder), "length"),
        (WORDS, 2, corpus_pipeline.packing(spark, docs, folder), "length"),
    ):
        tokenizer = Tokenizer.from_file(path)
        (got,) = [r for r in rows.collect() if r.doc_id == 9]
        text = next(r.text for r in docs.collect() if r.doc_id == 9)
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [end]
        assert got[size] == len(ids) and got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
