"""Parts of the operators against slow versions that follow their definitions, and the pipeline's stages on odd tables."""

import random
from collections import Counter, defaultdict
from itertools import product

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import mixing, packing, quality_classifier, toxicity
from evalloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_filters import WORD


def enumerated(channel, text):
    """All cheapest readings of a text, from every way through its lattice."""
    found = defaultdict(lambda: float("inf"))
    for way in product(*channel.choices(text)):
        a = b = 0
        cost, out = 0.0, []
        for c, extra in way:
            if c == 0 and b == 0:
                break
            cost += extra - (channel.rows[a][b][c] if c >= 0 else 0.0)
            a, b = (a, b) if c < 0 else (0, 0) if c == 0 else (b, c)
            out += [] if c < 0 else [toxicity.LETTERS[c] if c else " "]
        else:
            cost -= channel.rows[a][b][0] if b else 0.0
            found["".join(out)] = min(found["".join(out)], cost)
    least = min(found.values())
    return {reading for reading, cost in found.items() if cost <= least + 1e-6}


def test_viterbi_is_the_cheapest_way():
    rng = random.Random(4)
    text = " ".join(rng.choice(["the", "idiot", "trash", "loser", "a", "person", "said"]) for _ in range(3000))
    channel = toxicity.Channel(toxicity.model_of(toxicity.count_trigrams([text]).astype(float)))
    signs = "".join(s for s in toxicity.STANDS_FOR if s != "*")
    seen = ["1d10t", "l00ser", "7r4sh", "i d i t"] + ["".join(rng.choice("idotrashle" + signs + "-. ") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    for s in seen:
        assert channel.restore(s) in enumerated(channel, s), s


def test_fourier_ridge_is_kernel_ridge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 4)).astype(np.float32).astype(float)
    y = (np.sin(x[:, 0]) + x[:, 1] > 0).astype(float)
    fourier = quality_classifier.Fourier(np.zeros(4), np.ones(4), 2.0, 3000, 9)
    z = np.clip(x, -5, 5)
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 2.0**2))
    f = fourier(x)
    assert np.abs(f[:, :-1] @ f[:, :-1].T - kernel).max() < 0.12
    train = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y)], "x array<float>, y double").repartition(3)
    a, b = quality_classifier.normal_equations(train, fourier, groups=2)
    assert np.allclose(a, f.T @ f, atol=1e-3) and np.allclose(b, f.T @ y, atol=1e-3)
    ridge = 0.5
    fast = f @ np.linalg.solve(a + ridge * np.eye(len(a)), b)
    exact = (kernel + 1) @ np.linalg.solve(kernel + 1 + ridge * np.eye(len(y)), y)
    assert np.abs(fast - exact).max() < 0.1


def fewest_bins(lengths, size):
    """By (bins, fill of the last one) over all sets of pieces."""
    best = {0: (1, 0)}
    for s in range(1, 1 << len(lengths)):
        ways = []
        for i, n in enumerate(lengths):
            if s >> i & 1:
                bins, fill = best[s & ~(1 << i)]
                ways.append((bins, fill + n) if fill + n <= size else (bins + 1, n))
        best[s] = min(ways)
    return best[(1 << len(lengths)) - 1][0]


def test_islands_find_the_fewest_bins():
    rng = random.Random(8)
    over = []
    for seed in range(60):
        lengths = [rng.randint(10, 70) for _ in range(rng.randint(1, 9))]
        island = packing.Island(lengths, 100, seed, 10, 40, 20)
        over.append(len(island.evolve(island.founders(), [])) - fewest_bins(lengths, 100))
    assert min(over) >= 0 and max(over) <= 1 and sum(over) <= 2


def test_draw_by_laying_out_tokens(docs):
    cell_rows, max_shards, seed = 5, 3, 17
    out = mixing.mix(docs, cell_rows=cell_rows, max_shards=max_shards, seed=seed)
    size, taken = out.columns[-5], out.columns[-2]
    rows = out.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(r["text"] or "")) for r in by[s]) for s in order]
    goal = mixing.targets(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], 1.5, 2)
    block = int(max(1, min([1024, *(g // 256 for g in goal if g > 0)])))
    lines = []
    for s in order:
        cells = max(1, -(-len(by[s]) // cell_rows))
        shards = defaultdict(list)
        for r in by[s]:
            shards[r["key"] % cells % min(max_shards, -(-cells // 8))].append((r["key"] % cells, r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r[size], r[taken]))
        lines.append({j: sorted(v) for j, v in sorted(shards.items())})
    n_blocks = [{j: -(-sum(d[4] for d in v) // block) for j, v in own.items()} for own in lines]
    seats = mixing.sainte_lague(goal, round(sum(goal) / block), [2 * sum(n.values()) for n in n_blocks])
    for own, n_own, won, g, whole in zip(lines, n_blocks, seats, goal, sizes):
        quotas = mixing.sainte_lague([sum(d[4] for d in v) * (g / whole if whole else 0.0) for v in own.values()], won, [2 * n for n in n_own.values()])
        for (j, v), q in zip(own.items(), quotas):
            n = max(n_own[j], 1)
            shift = (seed * 1_000_003 + j * 7919) % n
            # a block is taken once more where a multiple of n lies in its stretch of the line of draws
            copies = [q // n + sum(x % n == 0 for x in range((k + shift) * (q % n) + 1, (k + shift + 1) * (q % n) + 1)) for k in range(n)]
            at, got, want = 0, Counter(), Counter()
            for *_, doc, length, given in v:
                want[doc, sum(copies[p // block] for p in range(at, at + length))] += 1
                got[doc, given] += 1
                at += length
            assert got == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, small, docs, no_docs, name, stage):
    empty, out = stage(spark, no_docs, small), stage(spark, docs, small)
    rows = out.collect()
    assert empty.count() == 0 and empty.columns == out.columns
    known = {r.doc_id: r.text for r in docs.collect()}
    if name == "packing":
        assert {r.doc_id for r in rows} == set(known)
        return
    assert out.columns == docs.columns and all(known[r.doc_id] == r.text for r in rows)
    assert all((r.score, r.n_words) == ("x", "y") for r in rows)
    if name == "n-gram jaccard join":
        assert {103, 104, 105} <= {r.doc_id for r in rows} and not {101, 102} & {r.doc_id for r in rows}


def test_archive_query_is_its_sql(spark, tmp_path):
    import duckdb

    pages = [(1, "u", "<p>a</p>"), (2, "u", "é" * 500), (3, None, None), (4, "v", "<p>a</p>"), (5, "v", ""), (6, "w", "<p>a</p>"), (7, "w", "b" * 70_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op2_warc_round_trip"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['op2_warc_round_trip']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[0]: r[4] for r in want} == {1: 6, 2: None, 3: 5, 4: 6, 5: None, 6: None, 7: None}
