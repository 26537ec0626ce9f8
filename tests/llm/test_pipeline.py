"""The pipeline's stages against plain versions on the smallest tables, and the registered queries."""

import math
from collections import Counter

import corpus_pipeline
import pytest
from evalloom.llm import quality_rules, toxicity
from evalloom.llm.queries import QUERIES

from tests.llm.test_filters import WORD, measures
from tests.llm.test_packing_tokens import check_pack
from tests.llm.test_pairs_archives import brute


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], small).cache())
    return out


def test_stages(stages):
    docs, good, clean, distinct, mixed, packed = stages
    assert all(s.columns == docs.columns for s in (good, clean, distinct, mixed))
    n = [s.count() for s in stages]
    assert n[0] > n[1] >= n[2] >= n[3] > 0
    classes = brute([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in distinct.collect()) == sorted({i for i, c in classes.items() if i == c})
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in distinct.collect()}
    assert sum(r.length for r in packed.filter("piece = 0 and start = 0").collect()) > 0
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_stages_drop_nothing_else(spark, small, stages):
    docs, good, clean, _, mixed, packed = stages
    rules, rows = quality_rules.Rules(), []
    for r in docs.collect():
        n, chars, signs, lines, repeats = measures(r.text)
        ratios = (signs / n, repeats / n, lines / max(n / 10, 1), chars / n) if n else None
        rows.append((r, ratios, n >= rules.min_words and 100 * repeats <= rules.max_repeat_percent * n))
    rank = lambda values, p: sorted(values)[max(math.ceil(p * len(values)), 1) - 1]

    def blended(d, some, value, p, prior=rules.prior):
        """The quantile p of d's group, its language and all, weighed by their numbers."""
        out = rank([value(e, y) for e, y in some], p)
        for same in (lambda e: e.lang == d.lang, lambda e: (e.lang, e.source) == (d.lang, d.source)):
            own = [value(e, y) for e, y in some if same(e)]
            out = (len(own) * (rank(own, p) if own else 0) + prior * out) / (len(own) + prior)
        return out

    passed = [(d, x) for d, x, ok in rows if ok]
    usual = []
    for d, x in passed:
        low, high = (blended(d, passed, lambda e, y: y[3], p, rules.length_prior) for p in (0.25, 0.75))
        usual += [(d, x)] if low - 1.5 * (high - low) <= x[3] <= high + 1.5 * (high - low) else []
    keeps = []
    for d, x in passed:
        inside, short = True, blended(d, usual, lambda e, y: len(WORD.findall(e.text)), rules.tail)
        for k, one in enumerate((1 / short, 6 / short, 1 / max(short / 10, 1), 0)):
            lo, mid, hi = (blended(d, usual, lambda e, y: y[k], p, rules.length_prior if k == 3 else rules.prior) for p in (rules.tail, 0.5, 1 - rules.tail))  # noqa: B023
            inside &= x[k] <= hi + rules.spread * max(hi - mid, one) and (k < 3 or x[k] >= lo - rules.spread * (mid - lo))
        keeps += [d.doc_id] if inside else []
    assert Counter(keeps) == Counter(r.doc_id for r in good.collect())
    scores = toxicity.score(good, spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic")).collect()
    assert Counter(r.doc_id for r in scores if r.score < 0.7) == Counter(r.doc_id for r in clean.collect())
    check_pack(mixed, packed.collect())


def test_run(spark, small, stages):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.run(spark, small).count() == stages[-1].count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, small, name):
    table = {"op2": "pages", "op8": "pages", "op10": "embeddings"}.get(name.split("_")[0], "documents")
    out = QUERIES[name](spark, small)
    rows, there = out.count(), spark.read.parquet(f"{small}/{table}.parquet").count()
    assert rows >= there if name.startswith("op1_") else rows == there
