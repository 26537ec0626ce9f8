"""Packing, token files and the range coder: against the tokenizers library and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalloom.llm import packing, range_coder, token_files
from evalloom.llm.tokens import WordCache, byte_level_encoder

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
TRICKY = ["", " ", "a<|endoftext|>b  c", "<|startoftext|> hi", "É café ́e\x1c\x85x Σας ΣΑΣ", "̀abc 'S don't IT'S İstanbul", "l'eau it's we'll they'RE ''s x''t 1's a1b2 \xa0é!!?'d × ÷ ªµºß ½", "'s", "'", "o'll've'e 'reed 'v", "日本 123", "x" * 5000]


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("text", TRICKY)
def test_encoders_are_the_library(text):
    assert byte_level_encoder()(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WordCache().encode([text])[0], "<u2").tolist() == WORDS.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x180, exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_word_cache_any_text(texts):
    cache = test_word_cache_any_text.cache
    assert [np.frombuffer(x, "<u2").tolist() for x in cache.encode(texts)] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]


test_word_cache_any_text.cache = WordCache()


def test_word_cache_forgets():
    cache = WordCache(most=5)
    for t in ("a b c d e f", "g h i j", "a b zz"):
        assert np.frombuffer(cache.encode([t])[0], "<u2").tolist() == WORDS.encode(t, add_special_tokens=False).ids


def check_pack(docs, out, size=1024):
    expected = defaultdict(list)
    for r in docs.collect():
        expected[r.doc_id].append(ids_of(BYTES, r.text, 2))
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r)
    assert set(got) == set(expected)
    for doc, own in got.items():
        crcs = sorted((x.start, x.length, x.ids_crc32) for x in own)
        assert crcs == sorted((s, n, zlib.crc32(ids[s : s + n].tobytes())) for ids in expected[doc] for s, n in packing.cut(len(ids), size))
        assert all(x.length == size for x in own if x.piece > 0)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in out)
    assert len(by) <= -(-total // size) * 1.05 + 1
    return len(by)


def test_pack(docs):
    check_pack(docs, packing.pack(docs).collect())
    few = check_pack(docs, packing.pack(docs, island_rows=12, epochs=3).collect())
    assert few == check_pack(docs, packing.pack(docs, island_rows=12, epochs=3).collect())


def test_pack_nothing(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(20, 10) == [(0, 10), (10, 10)] and packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=120), st.integers(0, 5))
def test_island(lengths, seed):
    island = packing.Island(lengths, 100, seed, 5, 15, 6)
    best = island.evolve(island.founders(), [[50, 50], [lengths[0]]])
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(island.fill(b) <= 100 for b in best) and len(best) >= island.least
    assert len(best) <= len(island.best_fit([], sorted(range(len(lengths)), key=lambda i: -lengths[i])))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65534) | st.integers(0, 20), max_size=700), st.integers(1, 300))
def test_coder_round_trip(ids, block):
    data = range_coder.encode_segment(np.array(ids, np.uint16), block)
    back, end = range_coder.decode_segment(data)
    assert back.tolist() == ids and end == len(data)


def test_coder_compresses_and_detects_damage():
    ids = np.tile(np.arange(50, dtype=np.uint16), 400)
    data = range_coder.encode_segment(ids)
    assert len(data) < len(ids)
    broken = bytearray(data)
    broken[-1] ^= 0xFF
    broken[len(data) // 2] ^= 0xFF
    with pytest.raises(ValueError, match="checksum|damaged"):
        range_coder.decode_segment(bytes(broken))


def test_token_files(docs, no_docs, monkeypatch):
    out = token_files.round_trip(docs)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in out.collect())
    at, expected = 0, []
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in order:
        ids = ids_of(WORDS, r.text, 1)
        expected.append((at, -1 if r.doc_id is None else r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected
    assert token_files.round_trip(no_docs).collect() == []


def test_token_file_segments(tmp_path):
    path = tmp_path / "x.tok"
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 900, n).astype("<u2") for n in (2, 1, 500, 3, 129, 64, 61)]
    with path.open("wb") as f:
        w = token_files.FileWriter(f, 64, 1)
        for k, ids in enumerate(own):
            w.add(None if k == 0 else k, ids.tobytes())
        w.close()
    with path.open("rb") as f:
        reader = token_files.FileReader(f)
        assert reader.segments == 12 and reader.documents == 7
        for span in (1, 2, 5, 12):  # each document belongs to the range that it begins in
            got = [x for low in range(0, 12, span) for x in reader.read(low, low + span)]
            assert [d for d, *_ in got] == [token_files.NULL_ID, 1, 2, 3, 4, 5, 6]
            assert [s for _, s, _ in got] == [0, 2, 3, 503, 506, 635, 699] and all(np.array_equal(a, b[2]) for a, b in zip(own, got, strict=True))
    bad = tmp_path / "bad.tok"
    bad.write_bytes(b"x" * 100)
    with bad.open("rb") as f, pytest.raises(ValueError, match="token file"):
        token_files.FileReader(f)
