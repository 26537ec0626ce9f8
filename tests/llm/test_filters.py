"""Mixing, quality rules, toxicity, quality classifier, HTML: against plain Python and held-out accuracy."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.llm import html_extract, mixing, quality_classifier, quality_rules, toxicity
from evalloom.llm.vector_text import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(0, 200))
def test_sainte_lague_by_definition(votes, seats):
    caps = [2 * v for v in votes]
    won = mixing.sainte_lague(votes, seats, caps)
    slow = [0] * len(votes)
    for _ in range(min(seats, sum(caps))):
        open_ = [i for i, v in enumerate(votes) if v and slow[i] < caps[i]]
        slow[max(open_, key=lambda i: (votes[i] / (2 * slow[i] + 1), -i))] += 1
    assert sum(won) == sum(slow) and all(w <= c for w, c in zip(won, caps))
    q = lambda w: sorted(votes[i] / (2 * k + 1) for i, n in enumerate(w) for k in range(n))
    assert np.allclose(q(won), q(slow))


def test_targets():
    assert mixing.targets([10, 10, 100], [5, 2, 1], 1.5, 2) == [20, 20, 140]
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([0, 5], [5, 2], 1.5, 2) == [0, 7.5] and mixing.targets([0], [5], 1.5, 2) == [0]


def test_mix(docs, no_docs):
    out = mixing.mix(docs, cell_rows=5, max_shards=3)
    names = out.columns[-5:]
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        size = len(WORD.findall(r["text"] or ""))
        assert r[names[0]] == size and 0 <= r[names[3]] <= 2 * size and 0 <= r[names[4]] <= 2
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sum(r[names[0]] for r in by[s]) for s in order], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(order))], 1.5, 2)
    for s, g in zip(order, goal):
        assert by[s][0][names[2]] == pytest.approx(g) and by[s][0][names[1]] == sum(r[names[0]] for r in by[s])
        assert abs(sum(r[names[3]] for r in by[s]) - g) <= 0.02 * g + 3
    again = mixing.mix(docs.repartition(7), cell_rows=5, max_shards=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 6 and mixing.mix(no_docs).collect() == []


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs):
    names = {m: f"m_{m}" for m in quality_rules.MEASURES}
    for r in quality_rules.with_measures(docs, names=names).collect():
        assert tuple(r[f"m_{m}"] for m in quality_rules.MEASURES) == measures(r["text"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n#\t\x0b\x1c é"), max_size=60), min_size=1, max_size=20))
def test_quality_measures_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tuple(r[m] for m in quality_rules.MEASURES) for r in quality_rules.with_measures(df).collect()]
    assert sorted(got) == sorted(map(measures, texts))


def test_quality_rules(spark, docs, no_docs):
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids.isdisjoint({103, 104, 105, 106, 107, 108, 109, None}) and set(range(60)) <= ids
    assert quality_rules.filter_documents(no_docs).count() == 0
    plan = quality_rules.filter_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fences_follow_their_group(spark):
    rng = random.Random(4)

    def table(length, signs):
        """Two groups of a language; the words of the first are of about ``length`` letters, ``signs`` of its texts have 30 signs."""
        rows = []
        for i in range(600):
            first = i % 2 == 0
            words = ["".join(rng.choice("abcdef") for _ in range(max(1, round(rng.gauss(length if first else 5, 1))))) for _ in range(100)]
            rows.append((i, " ".join(words) + " #" * (30 if first and i < 600 * signs else 0), "en", "a" if first else "b"))
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        measured = quality_rules.with_measures(df)
        limits = {r.source: (r.lo, r.hi) for r in quality_rules.fences(measured).collect()}
        kept = {r.doc_id for r in quality_rules.judge(measured, quality_rules.fences(measured)).filter("kept").collect()}
        return limits, kept

    base, kept = table(5, 0.02)  # a fiftieth of the first group: junk
    moved, others = table(9, 0)
    usual, all_kept = table(5, 1)  # all of it: what is usual there
    assert len(kept) > 560 and not {i for i in range(0, 12, 2)} & kept
    assert moved["a"][0][3] > base["a"][1][3] and abs(moved["b"][1][3] - base["b"][1][3]) < 0.5 and len(others) > 570
    assert usual["a"][1][0] > 0.2 > base["a"][1][0] and len(all_kept) > 560


def test_small_groups_move_their_fences_and_few_signs_are_no_fault(spark):
    rng = random.Random(6)
    words = lambda n, length=5: " ".join("".join(rng.choice("abcdef") for _ in range(max(1, round(rng.gauss(length, 1))))) for _ in range(n))
    rows = [(i, words(rng.randint(55, 300)), "en", f"s{i % 40}") for i in range(400)]  # ten documents a source
    rows += [(400, words(20_000) + " # %", "en", "s0"), (401, words(60) + " #", "en", "s1"), (402, words(100) + " # #" * 40, "en", "s2"), (403, words(120), "fr", "lone"), (404, words(80, 6), None, None)]
    rows += [(405 + i, words(100, 9), "en", "long") for i in range(300)]
    measured = quality_rules.with_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    fences = quality_rules.fences(measured)
    limits = {(r.lang, r.source): (tuple(r.lo), tuple(r.hi)) for r in fences.collect()}
    assert len(set(limits.values())) == len(limits) == 43  # none is another group's
    assert limits["en", "long"][0][3] > max(v[0][3] for (lang, s), v in limits.items() if lang == "en" and s != "long")
    kept = {r.doc_id for r in quality_rules.judge(measured, fences).filter("kept").collect()}
    assert {400, 401, 403} <= kept and 402 not in kept and len(kept & set(range(400))) >= 0.97 * 400


def labelled(docs, column, rule):
    return docs.select("doc_id", F.when(rule, 1).otherwise(0).alias(column)).filter("doc_id is not null")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 90))]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.sample(range(len(words)), 5):
                words[k] = rng.choice(["idiot", "moron", "worthless", "scum"])
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "###" * junk for w in words), toxic, junk))
    return spark.createDataFrame(rows, "doc_id long, text string, t boolean, j boolean")


def accuracy(out, truth):
    rows = out.join(truth, "doc_id").filter("held_out").collect()
    return sum(r.predicted == r.truth for r in rows) / len(rows), len(rows)


def test_quality_classifier(corpus, docs, no_docs):
    labels = labelled(corpus, "quality", ~F.col("j"))
    out = quality_classifier.score(corpus, labels)
    good, n = accuracy(out, corpus.select("doc_id", (~F.col("j")).cast("int").alias("truth")))
    assert good > 0.97 and n > 100
    edge = quality_classifier.score(docs, labels)
    assert edge.count() == docs.count() and all(0 <= r.score <= 1 for r in edge.collect())
    assert edge.filter("doc_id is null").first().held_out
    assert quality_classifier.score(no_docs, labels).count() == 0
    assert {r.score for r in quality_classifier.score(docs, labels.filter("false")).collect()} == {0.5}
    flipped = labels.withColumn("quality", F.when(quality_classifier.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 9) for r in quality_classifier.score(corpus, x).collect()} for x in (labels, flipped))
    assert a == b


def test_statistics_alone_or_together(docs):
    import pyarrow as pa

    texts = [r.text for r in docs.collect()]
    together = np.concatenate([quality_classifier.statistics(w) for _, w in slices(pa.array(texts, pa.string()))])
    alone = np.concatenate([quality_classifier.statistics(w) for t in texts for _, w in slices(pa.array([t], pa.string()))])
    assert np.allclose(together, alone)


def test_isotonic():
    assert quality_classifier.isotonic(np.ones(4), np.array([1.0, 0.0, 2.0, 2.0])).tolist() == [0.5, 0.5, 2.0, 2.0]


def test_toxicity(spark, corpus, docs, no_docs):
    labels = labelled(corpus, "toxic", F.col("t"))
    out = toxicity.score(corpus, labels)
    good, n = accuracy(out, corpus.select("doc_id", F.col("t").cast("int").alias("truth")))
    assert good > 0.97 and n > 200
    hidden = corpus.withColumn("text", F.expr("replace(replace(replace(replace(text, 'idiot', '1d10t'), 'moron', 'm o r o n'), 'worthless', 'w.0.rthless'), 'scum', 'scuuum')"))
    later = hidden.withColumn("doc_id", F.col("doc_id") + 10_000).unionByName(corpus)
    rows = toxicity.score(later, labels).join(later.select("doc_id", "t"), "doc_id").filter("doc_id >= 10000").collect()
    assert sum(r.predicted == r.t for r in rows) / len(rows) > 0.95
    kept = toxicity.filter_documents(later, labels)
    assert kept.columns == later.columns and kept.filter("t").count() < 0.05 * later.filter("t").count() and kept.filter("not t").count() > 0.97 * later.filter("not t").count()
    edge = toxicity.score(docs, labels)
    assert edge.count() == docs.count() and all(0 <= r.score <= 1 for r in edge.collect())
    assert toxicity.score(no_docs, labels).count() == 0 and toxicity.filter_documents(no_docs, labels).columns == no_docs.columns
    assert {r.score for r in toxicity.score(docs, labels.filter("false")).collect()} == {0.0}


def test_restoring():
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "stupid", "idiot", "moron", "worthless", "a", "person", "said", "that"]) for _ in range(4000))
    reader = toxicity.Reader(toxicity.model_of(toxicity.count_trigrams([text]).astype(float)))
    for seen, meant in {"1d10t": "idiot", "m0r0n": "moron", "st*pid": "stupid", "stuuupid": "stupid", "w.o.r.t.h.l.e.s.s": "worthless", "$tupid!": "stupid", "IDIOT": "idiot", "mоrоn": "moron"}.items():
        assert meant in reader.word(seen), seen
    assert reader.spaced("you i d i o t now") == ["idiot"]
    assert reader.word("4380628581791761") == ("4380628581791761",) and reader.word("a@b.com") == ("a@b.com",) and reader.word("***") == ()


def test_heavy_disguises_are_restored():
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "idiot", "trash", "pathetic", "loser", "a", "person", "said", "that"]) for _ in range(4000))
    reader = toxicity.Reader(toxicity.model_of(toxicity.count_trigrams([text]).astype(float)))
    long = "1" + "." * 40 + "d" + "." * 40 + "10t"
    for seen, meant in {"1d107": "idiot", "!d!07": "idiot", "1.d.1.0.t": "idiot", "1-d-1-0-t": "idiot", "t.r.@.s.h": "trash", "p.@.t.h.e.t.i.c": "pathetic", "1####d####1####0####t": "idiot", long: "idiot"}.items():
        assert meant in reader.word(seen), seen
    for seen, meant in {"1 d 1 0 t": "idiot", "7 r 4 5 h": "trash", "l 0 5 3 r": "loser", "i  d  i  o  t": "idiot", "i\nd\n\ni\no\nt": "idiot", "a p " * 40 + "t r a s h": "trash"}.items():
        assert meant in " ".join(reader.spaced(f"you {seen} now")), seen
    for plain in ("a.b@c.example.org", "https://a.b/c@d.e", "www.site.com/x", "$400", "12:30", "2024-01-02"):
        assert len(reader.word(plain)) == 1, plain
    assert reader.spaced("1 2 3 4 5") == []


def test_doubled_letters_are_looked_up():
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "idiot", "clown", "damn", "little", "good", "person", "said", "that"]) for _ in range(4000))
    model = toxicity.model_of(toxicity.count_trigrams([text]).astype(float))
    scorer = toxicity.Scorer(model, {"idiot$": 3.0, "clown$": 2.0, "damn$": 2.5})
    assert [scorer.raw_weight(w) for w in ("iidiot", "idiott", "ccllown", "daamn", "Daamn!", "idiot")] == [3.0, 3.0, 2.0, 2.5, 2.5, 3.0]
    assert [scorer.raw_weight(w) for w in ("little", "good", "person")] == [0.0, 0.0, 0.0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept them all now.</div>
<div id="wrap"><div class="sidebar"><p>Popular stories, that you should read, are listed here for you.</p></div>
<div class="content"><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;words, of some length, that make   a paragraph
of text.</p><p>Second paragraph, with commas, and more words that follow one another.<p>Third, never closed, but long enough to count for the score.
<ul><li>Item one</li><li>Item two</li></ul><blockquote>Quoted, words of somebody, long enough.</blockquote><form><input><p>Subscribe, to our, letter now please.</p></form></div>
<div id="comments"><p>Great article, thanks a lot, I liked it very much indeed.</p></div></div><footer>&copy; 2024</footer></body></html>"""


def test_html_page():
    assert html_extract.main_text(PAGE).split("\n") == [
        "Head & line",
        "First bold words, of some length, that make a paragraph of text.",
        "Second paragraph, with commas, and more words that follow one another.",
        "Third, never closed, but long enough to count for the score.",
        "Item one",
        "Item two",
        "Quoted, words of somebody, long enough.",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a<br>b</p>", "a\nb"),
        ("<article><p>x &lt;b&gt; &#233;</p></article>", "x <b> é"),
        ("<article><header><h1>Title</h1></header><p>Body of the text, a sentence.</p><aside>no</aside></article>", "Title\nBody of the text, a sentence."),
        ("<p>unclosed <b>bold", "unclosed bold"),
        ("<div><!-- c --><p>a</p><script>x</script></div>", "a"),
        ("<<>><p>odd</p></x>", "<<>>\nodd"),
    ],
)
def test_html_small(page, text):
    assert html_extract.main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "word, word", "&amp;", "<", ">", "<!--", "-->", "<script>", "</script>", "<br>", "\"", "<a href='x'>"]), max_size=30))
def test_html_never_fails(parts):
    text = html_extract.main_text("".join(parts))
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n") if x.strip())


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (None, "w", "<p>x</p>" * 20_000, 0)], "page_id long, url string, html string, text int")
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars for r in out.collect())[:1] == [0]
    assert out.filter("n_chars <> length(text)").count() == 0 and html_extract.extract(df.filter("false")).count() == 0


def test_html_keeps_the_story():
    wide = "İ" * 40  # longer in small letters
    page = f"<html><body><article><p>{wide}</p><script>var x = 1;</SCRIPT ><p>The paragraph after the script, long enough, is here.</p></article></body></html>"
    assert html_extract.main_text(page) == wide + "\nThe paragraph after the script, long enough, is here."
    page = '<article><h1>Head</h1><p>A first paragraph, with commas, and more text.</p><p class="extra">One that is extra, yet part of the story.</p><p>It has <b class="warning">a word</b> of warning.</p><p class="advert">Buy now, it is cheap.</p><div class="related">Other stories</div></article>'
    assert html_extract.main_text(page) == "Head\nA first paragraph, with commas, and more text.\nOne that is extra, yet part of the story.\nIt has a word of warning."


@pytest.mark.parametrize("piece", ['<a "', "<a '\"", '<a x="y ', "<", "</", "<!", '<a b=">', "<a \"'>", "<!-- x", "<script>"])
def test_html_takes_broken_pages_in_linear_time(piece):
    began = time.process_time()
    html_extract.main_text("<p>some text" + piece * 20_000)
    assert time.process_time() - began < 5


def test_mix_of_wide_shards(docs, monkeypatch):
    a = sorted((str(r.doc_id), r[-1], r[-2]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "WIDE", 0)
    assert a == sorted((str(r.doc_id), r[-1], r[-2]) for r in mixing.mix(docs).collect())
