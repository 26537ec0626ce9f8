"""Runs, vector codes and pieces against versions that follow their definitions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import pieces, runs, vector_codes
from evalloom.llm.queries import QUERIES
from tests.llm.conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, exponent=4, least=6):
    """Every stretch for every period, kept where the period is its smallest."""
    found = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i + p - s
            if n >= max(least, exponent * p) and all(any(w[x] != w[x + q] for x in range(s, s + n - q)) for q in range(1, p)):
                found.append((s, n, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(rng):
    out = []
    for _ in range(rng.randint(1, 5)):
        k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 60)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        out.append(w)
    return out


@pytest.mark.parametrize("jumps", [0, 1, 48])
def test_runs_are_those_of_every_stretch(jumps, monkeypatch):
    monkeypatch.setattr(runs, "JUMPS", jumps)
    rng = random.Random(jumps)
    for _ in range(500):
        words = sequences(rng)
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        exponent, least = rng.choice([(4, 6), (2, 2), (3, 4)])
        got = runs.find_runs(np.array([x for w in words for x in w], np.int64), first, exponent, least)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, w in enumerate(words) for r in plain_runs(w, exponent, least)]


def test_longest_lyndon_words_end_at_next_smaller_suffixes():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
        first = np.array([0, len(w)])
        s = runs.Suffixes(np.array(w), first)
        assert s.sa.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        lyndon = lambda u: all(u < u[k:] for k in range(1, len(u)))
        assert runs.next_smaller(s.rank, first).tolist() == [max(j for j in range(i + 1, len(w) + 1) if lyndon(w[i:j])) for i in range(len(w))]


def test_ranges_have_their_minimum():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1000, 700)
    low = rng.integers(0, 700, 3000)
    high = np.minimum(699, low + rng.integers(0, 400, 3000))
    assert runs.RangeMinimum(x)(low, high).tolist() == [int(x[a : b + 1].min()) for a, b in zip(low, high)]


def test_long_texts_of_one_word_falling_words_and_fibonacci_words():
    a, b = "x", "x y"
    while len(b) < 200_000:
        a, b = b, b + " " + a
    assert len(runs.find_runs(np.zeros(200_000, np.int64), np.array([0, 200_000]))) == 1
    assert len(runs.find_runs(np.arange(200_000)[::-1], np.array([0, 200_000]))) == 0
    assert len(runs.find_runs(np.unique(b.split(" "), return_inverse=True)[1], np.array([0, len(b.split(" "))]))) == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_op11(doc_id, text):
    w = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w) if len(set(w)) > 1 or n < 6 else [(0, n, 1)]
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    s, m, p = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), s, m, p, None if s is None else 1000 * m // p, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def odd_documents():
    rng = random.Random(9)
    texts = [None, "", " \n\t ", "one", "a a a a a a", "A a A a A a A a", "é日 " * 9, "x\xa0y " * 8, "\x1ca b " * 5, "a b c d " * 30 + "z", "go go go go go", " lead and trail "]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 120))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, "p q p q p q p q"), (3, "one"), (3, "one")]


def test_runs_query(spark, tmp_path):
    rows = odd_documents()
    spark.createDataFrame([(a, b, "en", "s", 0, "x", "y") for a, b in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([plain_op11(*r) for r in rows], key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_runs_keep_other_columns_and_empty_tables(spark, docs, no_docs):
    assert runs.with_runs(no_docs).count() == 0
    out = runs.with_runs(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "runs", "top_run", "collapsed"]
    kept = {r["doc_id"]: r for r in runs.collapsed_documents(docs).collect()}
    assert kept[109]["text"] == "dup" and kept[103]["text"] is None and kept[0]["score"] == "x"
    assert kept[0]["text"] == docs.filter("doc_id = 0").first()["text"]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error) of each vector and the codebooks: Lloyd in plain integers, every part against every entry."""
    kept = [(i, label, [int(np.floor(256.0 * float(np.float32(x)))) for x in e]) for i, e, label in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], []
    width = len(kept[0][2]) // parts
    x = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[v[p] for v in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    nearest = lambda v, book: min((far(v, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        given = [[nearest(v[p], books[p])[1] for p in range(parts)] for v in x]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, g in zip(x, given) if g[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [[nearest(v[p], books[p]) for p in range(parts)] for v in x]
    errors = [sum(d for d, _ in f) for f in final]
    total = {}
    for r, e in zip(kept, errors):
        total[r[1]] = total.get(r[1], 0) + e
    digest = sha(",".join(str(c) for book in books for entry in book for c in entry))
    return [(r[0], "".join(f"{e:02x}" for _, e in f), error, total[r[1]], digest) for r, f, error in zip(kept, final, errors)], books


def vectors(rng, n, odd=True):
    out = [(i, [float(np.float32(x)) for x in rng.normal(size=32) * rng.choice([0.001, 0.02, 1.0])], int(rng.integers(0, 3)) if rng.random() < 0.8 else None) for i in range(n)]
    if odd:
        out += [(n, None, 1), (n + 1, [None] * 32, 1), (n + 2, [float("nan")] + [0.0] * 31, 1), (n + 3, [float("inf")] * 32, 1), (n + 4, [0.0] * 32, 0), (n + 5, [0.0] * 32, 0), (5, [1000.0] * 32, 2), (None, [-3.5] * 32, None), (7, out[7][1], 1), (7, out[7][1], 1)]
    return out


EMBEDDING = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("n", [0, 3, 150])
def test_codes_are_those_of_plain_lloyd(spark, tmp_path, n):
    rows = vectors(np.random.default_rng(n), n, odd=n > 3)
    spark.createDataFrame([(*r, "x") for r in rows], EMBEDDING).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op12_compress_vectors"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_codes(rows)[0], key=key)


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(8)
    x = np.rint(rng.normal(size=(4000, 2, 3)) * 40).astype(np.int64)  # many ties
    books = np.stack([x[:64, p] for p in range(2)])
    state, before, scans = None, None, []
    for _ in range(6):
        step = vector_codes.Round(books, before)
        *state, scanned = step.assign(x, state)
        for p in range(2):
            best, near, second = vector_codes.scan(x[:, p], books[p])
            assert (state[0][:, p] == best).all()
            assert (state[1][:, p] >= np.sqrt(near) * 256 - 1e-6).all() and (state[2][:, p] <= np.sqrt(second) * 256 + 1e-6).all()
        scans.append(scanned)
        before, books = books, books.copy()
        for p in range(2):
            for e in range(64):
                if (state[0][:, p] == e).any():
                    books[p, e] = x[state[0][:, p] == e, p].sum(0) // (state[0][:, p] == e).sum()
    assert scans[0] == 8000 and scans[-1] < 4000


def test_roots_are_exact():
    rng = np.random.default_rng(2)
    squares = np.concatenate([np.arange(3000), np.arange(3000) ** 2, rng.integers(0, 1 << 58, 3000), rng.integers(0, 1 << 29, 2000) ** 2])
    low, high = vector_codes._roots(squares)
    for s, a, b in zip(squares.tolist(), low.tolist(), high.tolist()):
        assert a == math.isqrt(s << 16) and b == a + (a * a != s << 16)


def test_vectors_that_cannot_be_coded(spark):
    rows = [(3, [1.0] * 16, None), (1, [], 1), (2, [0.5] * 15, 1), (4, [0.5] * 32, 1), (5, [3e38] * 16, 1), (6, [0.25] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(df)
    assert {(r["vec_id"], r["error"]) for r in coded.collect()} == {(3, 0), (6, 0)} and books.shape == (16, 2, 1)
    assert vector_codes.compress(df.drop("label"))[0].filter("label is null").count() == 2
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=257)


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


PIECE_TEXTS = ["", " ", "   ", "Hello  world\n\tx", "é日本𝒳 ok", " lead", "▁a▁", "▁▁ ▁x", "\x00a\x00", "a b <s> <unk> <0x0A> </s>", "\r\n\r\n", "tail   ", "ﬁﬃ ½ Å", "x" * 500, "ab" * 300 + "  " * 40, "﷽ก็๐ 🏳️‍🌈", "�﻿"]


def piece_texts():
    rng = random.Random(21)
    letters = "abcdeghinorst ABC  \n\t.,-_▁é日本語한국어зд🙂́‍0123"
    out = PIECE_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(600)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    return out + [" ".join(rng.choice(["the", "of", "model", "weights", "Zürich", "antidisestablishment", "2024"]) for _ in range(400))]


def test_pieces_spans_and_decoded_texts_are_the_librarys():
    lib, model = library(), pieces.piece_model()
    for t in piece_texts():
        ids, starts, ends = model.encode(t)
        want = lib.encode(t, return_type="proto").pieces
        assert ids.tolist() == lib.encode(t), t
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], t
        assert model.decode(ids) == lib.decode(lib.encode(t)), t
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw


def test_long_texts_are_cut_where_no_piece_reaches_across(monkeypatch):
    model, rng = pieces.piece_model(), random.Random(4)
    whole = [model.encode(t) for t in piece_texts()]
    monkeypatch.setattr(pieces, "PART", 3)
    for t, want in zip(piece_texts(), whole):
        assert all((a == b).all() for a, b in zip(model.encode(t), want))
    long = "".join(rng.choice("abcdefgh日") for _ in range(50_000))
    assert model.encode(long)[0].tolist() == library().encode(long)


def test_any_ids_decode_as_in_the_library():
    lib, model, rng = library(), pieces.piece_model(), random.Random(6)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == lib.decode(ids), ids


@pytest.mark.parametrize(("prefix", "squeeze", "escape"), [(True, True, True), (False, False, True), (True, False, False), (False, True, True)])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_map_normalises_as_the_library(rule, prefix, squeeze, escape):
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
    spec = next(dict(pieces._fields(v)) for f, v in pieces._fields(lib.serialized_model_proto()) if f == 3)
    own = pieces.Normalizer({**spec, 3: int(prefix), 4: int(squeeze), 5: int(escape)})
    for t in [*piece_texts(), "ｶﾞＡ  ﾊﾟ", " 　 a  b ", "Straße ΑΣ"]:
        normal, source = own(t)
        want, offsets = lib.normalize(t, with_offsets=True)
        assert normal == want, t
        ends = np.cumsum([0, *(len(c.encode()) for c in normal)])
        raw = t.encode()
        assert [len(raw[:k].decode(errors="ignore")) for k in source[ends]] == offsets, t


def test_pieces_query(spark, tmp_path, docs, no_docs):
    lib = library()
    rows = [(i, t) for i, t in enumerate(piece_texts())] + [(None, "no id"), (3, None), (3, "again"), (3, "again"), (9999, "long words here " * 60_000)]
    spark.createDataFrame([(a, b, "en", "s", 0, "x", "y") for a, b in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_sentence_pieces"](spark, str(tmp_path)).drop("spans_sha256").collect()
    want = [(i, len(ids := lib.encode(t or "")), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert pieces.with_pieces(no_docs).count() == 0
    out = pieces.with_pieces(docs.withColumn("ids", F.lit("clash")))
    assert out.columns == [*docs.columns, "ids", "span_starts", "span_ends", "decoded"]
    assert out.filter("doc_id = 0").first()["decoded"] == docs.filter("doc_id = 0").first()["text"]
