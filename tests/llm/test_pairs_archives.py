"""Near duplicates and archives: against brute force and exact round trips."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm import embedding_dedup, ngram_join, screens, warc
from evalloom.llm.connected import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes_of(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute(rows, percent=75):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t))
    near = lambda s, t: bool(s and t) and 100 * len(s & t) >= percent * len(s | t)
    return classes_of(sorted(i for i in sets if i is not None), lambda a, b: any(near(s, t) for s in sets[a] for t in sets[b]))


def copies(seed, n_groups=12):
    """Groups of near copies around the threshold, a passage that many share, and texts of a few words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.5:
                own = own[: len(own) // 2] + passage + own[len(own) // 2 :]
            out.append((len(out) * 3 % 1009, " ".join(own)))
    return out


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"bucket_rows": 2, "block_rows": 3}), (3, {"bucket_rows": 3, "block_rows": 2, "share": 0.05, "least_common": 3}), (4, {"block_rows": 4, "bucket_rows": 1}), (5, {"keys": "prefix"}), (6, {"keys": "prefix", "share": 0.05, "least_common": 3, "bucket_rows": 3, "block_rows": 2})])
def test_jaccard_is_brute_force(spark, seed, options):
    rows = copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, **options).collect()}
    expected = brute(rows)
    assert {i: c for i, (_, c) in got.items()} == expected
    assert {i: n for i, (n, _) in got.items()} == {i: len(shingles(t)) for i, t in rows}


@pytest.mark.parametrize("keys", ["minima", "prefix"])
def test_template_in_all_documents(spark, keys):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    template = [word() for _ in range(60)]
    rows = []
    for i in range(60):  # the template is 40 to 90 % of a document, the rest its own or its pair's
        own = [word() for _ in range(rng.choice([8, 20, 40, 80]))] if i % 2 == 0 else rows[-1][1].split()[60:]
        rows.append((i, " ".join(template + own[: len(own) - rng.randint(0, 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.classes(df, keys=keys, share=0.2, least_common=5, bucket_rows=8, block_rows=5).collect()}
    assert got == brute(rows)


def test_rare_passages_tie_no_groups(spark, monkeypatch):
    """Passages too rare for the list of common shingles fill buckets, but do not make their documents one group."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(30)] for _ in range(3)]
    rows = [(i, " ".join(passages[i % 3] + [word() for _ in range(50)])) for i in range(240)]
    rows += [(1000 + i, rows[i][1] + " " + word()) for i in range(0, 240, 40)]
    groups = []
    exact = ngram_join.exact_classes

    def seen(docs, found, *rest):
        groups.extend(r["count"] for r in found.groupBy("grp").count().collect())
        return exact(docs, found, *rest)

    monkeypatch.setattr(ngram_join, "exact_classes", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.classes(df, bucket_rows=16, block_rows=20).collect()}
    assert got == brute(rows)
    assert max(groups) == 2


def test_screens(spark, monkeypatch):
    rows, some = spark.range(1000).selectExpr("id", "id % 7 as x"), spark.range(0, 1000, 10).selectExpr("id as k")
    assert {r.id for r in screens.screened(rows, "id", some).collect()} >= set(range(0, 1000, 10))
    expected = sorted(set(range(1000)) - set(range(0, 1000, 10)))
    assert sorted(r.id for r in screens.without(rows, "id", some).collect()) == expected
    assert screens.screen_bits(some, 32) > screens.screen_bits(some)
    monkeypatch.setattr(screens, "SCREEN_BITS", 10)  # room for eight bits each, not for 32
    assert screens.screen_bits(some, 32) == screens.screen_bits(some) == 10
    monkeypatch.setattr(screens, "SCREEN_BITS", 4)  # more values than a screen takes
    assert screens.screened(rows, "id", some).count() == 1000
    assert sorted(r.id for r in screens.without(rows, "id", some).collect()) == expected


def test_jaccard_edges(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.classes(docs).collect()
    assert len(got) == len(rows)
    expected = brute(rows)
    for r in got:
        assert r.component_id == (expected[r.doc_id] if r.doc_id is not None else None)
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in expected.items() if i == c}) and ids.count(None) == 1
    assert ngram_join.classes(no_docs).count() == 0 and ngram_join.distinct_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=2, max_size=25), st.sampled_from([40, 75, 90]))
def test_tree_misses_no_pair(sets, percent):
    arrays = [np.sort(np.array([x * 2654435761 % (1 << 48) for x in s], np.uint64)) for s in sets]
    bits = [ngram_join.bitmap_bits(len(a)) for a in arrays]
    tree = ngram_join.Tree([len(a) for a in arrays], [ngram_join.bitmap(a, b) for a, b in zip(arrays, bits)], bits, percent)
    pairs = list(tree.pairs())
    found = {tuple(sorted(p)) for p in pairs}
    assert len(found) == len(pairs)
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                assert (j, i) in found


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40), st.sampled_from([7, 1000]))
def test_components(spark, edges, some):
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.id: r.component for r in components(df, some).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    linked = {(min(e), max(e)) for e in edges}
    assert got == classes_of(nodes, lambda a, b: (a, b) in linked)


def vectors(seed, n=260, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            out.append((len(out) * 7 % 2003, (centre + rng.normal(size=dim) * rng.choice([0, 0.05, 0.12])).tolist()))
    nan, inf = float("nan"), float("inf")
    return [*out, (5000, None), (5001, [0.0] * dim), (5002, [nan] * dim), (5003, [inf, *[1.0] * (dim - 1)]), (5004, [None] * dim), (5005, [1.0, 2.0]), (5006, []), (5007, [1e300] * dim), (5008, [1e-300] * dim), (5009, out[0][1]), (5009, out[0][1])]


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 5)])
def test_embeddings_are_brute_force(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    got = embedding_dedup.near_duplicates(df, block=block).collect()
    ok = [(k, i, np.array(v)) for k, (i, v) in enumerate(rows) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = embedding_dedup.unit(np.array([v for *_, v in ok]))
    near = x @ x.T >= 0.95
    links = defaultdict(list)
    for (_, i, _), n in zip(ok, near.sum(axis=1) - 1):
        links[i].append(int(n))
    for i, _ in rows:
        links.setdefault(i, [0])
    by = defaultdict(list)
    for k, (_, i, _) in enumerate(ok):
        by[i].append(k)
    comp = classes_of(sorted(by), lambda a, b: near[np.ix_(by[a], by[b])].any())
    found = defaultdict(list)
    for r in got:
        found[r.vec_id].append(r.n_links)
        assert r.component_id == comp.get(r.vec_id, r.vec_id) and r.kept == (r.vec_id == r.component_id)
    right = sum(sorted(found[i]) == sorted(links[i]) for i in links)
    assert right == len(links)
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0
    assert embedding_dedup.near_duplicates(df.filter("vec_id = 5000")).count() == 1


@pytest.mark.parametrize("pairs", [0, 60, 1500])
def test_rare_and_loose_links_are_found(spark, monkeypatch, pairs):
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(rng.normal(size=(4000, 64)))
    if pairs:
        side = rng.normal(size=(pairs, 64))
        side = embedding_dedup.unit(side - (side * x[:pairs]).sum(axis=1)[:, None] * x[:pairs])
        x[-pairs:] = 0.953 * x[:pairs] + np.sqrt(1 - 0.953**2) * side  # cosines just above the threshold
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    visited, own = [], embedding_dedup._visited_pairs
    monkeypatch.setattr(embedding_dedup, "_visited_pairs", lambda nodes, shared, bands, visits, *more: visited.append((visits, len(shared.value.first) ** 2)) or own(nodes, shared, bands, visits, *more))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, queries=1000, sample_rows=1000, block=300).collect()}
    assert sum(got.values()) <= 2 * pairs
    found = sum(got[i] == 1 and got[4000 - pairs + i] == 1 for i in range(pairs))
    assert found >= 0.999 * pairs
    (visits, cells), = visited
    assert visits < cells / 2  # planted partners, at the threshold itself, say how far to go where nothing has a partner


def test_planted_partners():
    rng = np.random.default_rng(2)
    x = embedding_dedup.unit(rng.normal(size=(50, 12)))
    y = embedding_dedup.planted_partners(x, 0.95, rng)
    assert np.allclose((x * y).sum(axis=1), 0.95) and np.allclose((y * y).sum(axis=1), 1)
    index = embedding_dedup.MultiIndex.fit(x, 4, 1)
    a, b = index.halves(x)
    visits, cells = embedding_dedup.visits_to(index, a, b, index.cell(y)), index.cell(y)
    for row, (n, cell) in enumerate(zip(visits, cells)):  # what it needs is where its partner is
        assert index.visits(x[row : row + 1], int(n))[0][-1] == cell


def test_each_pair_is_looked_at_from_one_side():
    rng = np.random.default_rng(3)
    bands = np.array([0, 0, 1, 1, 1, 2])
    a, b = rng.integers(0, 24, (2, 500))  # cells of a grid of six rows and four columns
    one = embedding_dedup.side_of(a, b, bands[a // 4], bands[b // 4])
    other = embedding_dedup.side_of(b, a, bands[b // 4], bands[a // 4])
    assert (one[a == b] & other[a == b]).all() and (one != other)[a != b].all()
    assert 0.4 < one[a != b].mean() < 0.6


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    index = embedding_dedup.MultiIndex.fit(embedding_dedup.unit(rng.normal(size=(300, 8))), 9, 1)
    x = embedding_dedup.unit(rng.normal(size=(20, 8)))
    a, b = index.halves(x)
    every = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    visits = index.visits(x, 13)
    assert np.allclose(np.take_along_axis(every, visits, 1), np.sort(every, axis=1)[:, :13])
    assert (visits[:, 0] == index.cell(x)).all()


PAGES = [(1, "http://a", "<p>é</p>" * 50), (2, "http://b", "<p>é</p>" * 50), (3, "http://c", None), (4, None, ""), (5, "e\r\nf", "x" * 300_000), (6, "http://g", "WARC/1.1\r\n\r\n"), (7, "u", "y"), (7, "u", "y"), (None, "n", "only")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("split", [4 << 20, 300])
def test_warc_round_trip(spark, split):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    rows = warc.round_trip(df, split=split).collect()
    got = sorted((-1 if r.page_id is None else r.page_id, r.payload_length, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    last = defaultdict(int)
    for i, _, h in PAGES:
        last[h or ""] = max(last[h or ""], i or 0)
    expected = []
    for i, _, h in PAGES:
        to = last[h or ""] if i is not None and last[h or ""] != i else None
        expected.append((-1 if i is None else i, len((h or "").encode()), digest(h), "revisit" if to else "response", to))
    assert got == sorted(expected, key=lambda x: x[:4])
    assert warc.round_trip(df.filter("false")).count() == 0
    small = {r.page_id: r.record_type for r in warc.round_trip(df, least=10_000).collect()}
    assert set(small.values()) == {"response"}


def test_ranges_own_each_record_once(tmp_path):
    rng = random.Random(3)
    records = [warc.encode_record(i, f"u{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(4000))), digest(str(i)), None, "d") for i in range(40)]
    data = b"".join(records)
    starts = [sum(map(len, records[:k])) for k in range(len(records))]
    source = pa.BufferReader(data)
    for split in (1, 97, 1000, 5000, len(data)):
        seen = []
        for start in range(0, len(data), split) if split > 1 else range(0, 3000):
            reader = warc.RangeReader(source, start, min(start + split, len(data)), chunk=512)
            seen += [o for o, *_ in reader.records(reader.first())]
        assert seen == ([s for s in starts if s < 3000] if split == 1 else starts)


def test_archive_within_an_archive(spark, tmp_path):
    """Payload bytes that are themselves records: found by the chain check and read again."""
    inner = b"".join(warc.encode_record(1000 + i, "in", random.Random(i).randbytes(700), digest(str(i)), None, "d") for i in range(6))
    outer = [warc.encode_record(i, "out", inner, base64.b32encode(hashlib.sha1(inner).digest()).decode(), None, "d", level=0) for i in range(5)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(outer))
    manifest = spark.createDataFrame([(str(path), path.stat().st_size, 5)], "path string, bytes long, records long")
    rows = warc.read_archives(manifest, split=1500).collect()
    assert sorted(r.page_id for r in rows) == [0, 1, 2, 3, 4] and all(r.block == inner for r in rows)


def test_long_false_chain(spark, tmp_path):
    """An archive in an archive over many ranges is mended in one go, true records between and after it stay."""
    inner = b"".join(warc.encode_record(1000 + i, "in", random.Random(i).randbytes(300), digest(str(i)), None, "d") for i in range(60))
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    small = [random.Random(i).randbytes(500) for i in range(30)]
    records = [warc.encode_record(i, "out", x, sha(x), None, "d", level=0) for i, x in enumerate([*small[:10], inner, *small[10:20], inner, *small[20:]])]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(records))
    manifest = spark.createDataFrame([(str(path), path.stat().st_size, len(records))], "path string, bytes long, records long")
    rows = warc.read_archives(manifest, split=700).collect()
    assert sorted(r.page_id for r in rows) == list(range(32)) and len({r.offset for r in rows}) == 32


def test_damage_is_reported():
    data = bytearray(warc.encode_record(1, "u", b"x" * 100, digest("x"), None, "d") * 2)
    data[-3] ^= 1
    reader = warc.RangeReader(pa.BufferReader(bytes(data)), 0, len(data))
    with pytest.raises(ValueError, match="damaged"):
        list(reader.records(reader.first()))


def test_damage_fails_the_read(spark, tmp_path):
    data = bytearray(b"".join(warc.encode_record(i, "u", bytes(500), base64.b32encode(hashlib.sha1(bytes(500)).digest()).decode(), None, "d") for i in range(9)))
    data[len(data) // 2] ^= 255
    path = tmp_path / "x.warc.gz"
    path.write_bytes(bytes(data))
    manifest = spark.createDataFrame([(str(path), len(data), 9)], "path string, bytes long, records long")
    with pytest.raises(ValueError, match="x.warc.gz"):
        warc.read_archives(manifest, split=400)
