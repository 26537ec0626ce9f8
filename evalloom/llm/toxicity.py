"""Toxicity of documents whose words may be disguised: noisy-channel restoration, then a learned score.

1. A character trigram model is counted over all documents (per task, then added; 60^3 counts at most).
2. Odd words (digits or signs among letters, letters apart, letters repeated) become lattices: every observed character may
   stand for letters, be a separator, or repeat the one before, each at a channel cost. Viterbi finds the reading that the
   trigram model and the channel together like best.
3. A lexicon of words and word beginnings is learned from labelled documents: those whose odds of toxic documents are high
   even at the lower end of their uncertainty. A logistic score of a document's hits follows, fitted on other labelled
   documents than those the lexicon came from.

Learning reads at most ``most_labelled`` documents of each class (by hash of the id); the trigram counts and the scores cover
every whole text. Labelled ids of that bound are the only broadcast rows; documents are never shuffled.

Defined results
* null or empty text: a document without hits, scored as such.
* a null id is held out; null labels are left out; a document with several labels counts with the largest.
* without labels of both classes in the taught folds every score is the mean taught label (0 without any).
* repeated rows get equal scores; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import materialize
from evalloom.llm.quality_classifier import remainder
from evalloom.session import ship

#: Letters of the model: boundary, a-z, the small letters from U+00DF to U+00FF, any other letter.
LETTERS = "\0" + "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "￿"
N = len(LETTERS)
CODE = {c: k for k, c in enumerate(LETTERS)}
# Signs that stand for letters.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "×": "x", "¥": "y", "®": "r", "©": "c", "µ": "u",
}
# Letters of other alphabets that look like Latin ones.
LOOKALIKE = dict(zip("аеорсухіѕјԁһвкмнт" + "αεικνορτυχ", "aeopcyxisjdhbkmht" + "aeiknoptux", strict=True))
SEPARATORS = frozenset(".-_*'~^`·•,:/\\=")
EDGE = ".,;:?\"'()[]{}…-_*#%&=~<>|^/\\`«»“”‘’„–—"
SUBSTITUTE, DROP_SIGN, DROP_SEPARATOR, WILD, REPEAT, SPLIT = 1.0, 9.0, 0.3, 3.5, 0.2, 2.5
_ODD = re.compile(r"[^a-zß-öø-ÿ]|(.)\1\1|(.)\2.*(.)\3.*(.)\4")
_DOUBLED = re.compile(r"(.)\1")
_SIGN_RUN = re.compile(r"^[$#*%&@!+|]{2,}|[$#*%&@!+|]{2,}$|!+$")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_ADDRESS = re.compile(r"^[\w+-]+(?:\.[\w+-]+)*@(?:[a-z0-9-]+\.)+[a-z]{2,}$|^(?:https?|ftps?|file|wss?|ssh|git|s3a?|gs|hdfs)://[\w.-]|^www\.[a-z0-9-]+\.[a-z]{2,}")
_NUMBER = re.compile(r"^[+-]?[$€£¥]?\d[\d\s.,:/-]*[%+$€£¥]?$")


def letters_in(text: str) -> int:
    """How many characters are letters or may stand for one."""
    return sum(c.isalpha() or c in STANDS_FOR or c == "*" for c in text)


def _code_table() -> np.ndarray:
    table = np.zeros(0x2000, np.uint8)
    for c in range(len(table)):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = CODE.get(low, N - 1) if len(low) == 1 else N - 1
    return table


_CODES = _code_table()


def count_trigrams(texts: list[str]) -> np.ndarray:
    """Trigram counts of the words: two boundaries come before a word, one after it."""
    total = np.zeros(N**3, np.int64)
    size, some = 0, []
    for t in [*texts, None]:
        if t is not None:
            some.append(t)
            size += len(t)
        if some and (t is None or size > 1 << 20):
            points = np.frombuffer(" ".join(["", *some, ""]).encode("utf-32-le", "replace"), "<u4")
            c = _CODES[np.where(points < len(_CODES), points, 0)].astype(np.int32)
            c = np.where(points >= len(_CODES), N - 1, c) if (points >= len(_CODES)).any() else c
            a, b, d = c[:-2], c[1:-1], c[2:]
            a = np.where(b == 0, 0, a)
            real = (b != 0) | (d != 0)
            total += np.bincount(((a * N + b) * N + d)[real], minlength=N**3)
            size, some = 0, []
    return total


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b), trigrams interpolated with bigrams and letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                total += count_trigrams([t or "" for t in batch.column(0).slice(at, 512).to_pylist()])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": seen.astype(np.int32), "n": total[seen]})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N**3)
    counts[[r["code"] for r in rows]] = [r["n"] for r in rows]
    return model_of(counts)


def model_of(counts: np.ndarray) -> np.ndarray:
    tri = counts.reshape(N, N, N)
    bi = tri.sum(axis=0)
    uni = bi.sum(axis=0)
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * N)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


class Channel:
    """Restores words under a trigram model."""

    def __init__(self, model: np.ndarray):
        self.rows = model.tolist()
        self.likely = [CODE[c] for c in "aeiountrslchdpmgbfyvkwzjxq"]

    def choices(self, text: str) -> list[list[tuple[int, float]]]:
        """For each observed character the (letter, cost) it may be; letter -1 is none."""
        out, before, run = [], "", 0
        for o in text:
            o = LOOKALIKE.get(o, o)
            run = run + 1 if o == before else 1
            before = o
            if o in CODE and o not in ("\0", "￿"):
                own = [(CODE[o], 0.0)]
                if run >= 2:
                    own.append((-1, REPEAT))
            elif o in STANDS_FOR:
                own = [(CODE[c], SUBSTITUTE) for c in STANDS_FOR[o]] + [(-1, 1.5 if run >= 2 else DROP_SIGN)]
            elif o in SEPARATORS:
                own = [(-1, DROP_SEPARATOR)]
                if o == "*":
                    own += [(c, WILD) for c in self.likely]
            elif o.isspace():
                own = [(-1, 0.0), (0, SPLIT)]
            else:
                own = [(N - 1, 1.0)] if o.isalpha() else [(-1, DROP_SEPARATOR)]
            out.append(own)
        return out

    def restore(self, text: str) -> str:
        """The likeliest words behind ``text`` (small letters), joined by spaces."""
        rows = self.rows
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for own in self.choices(text):
            now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                row = rows[a][b]
                for c, extra in own:
                    if c < 0:
                        state, value, then = (a, b), cost + extra, path
                    elif c == 0:
                        if b == 0:
                            continue
                        state, value, then = (0, 0), cost + extra - row[0], (0, path)
                    else:
                        state, value, then = (b, c), cost + extra - row[c], (c, path)
                    if state not in now or value < now[state][0]:
                        now[state] = (value, then)
            best = now
        path = min(((cost - (rows[a][b][0] if b else 0.0), a, b, p) for (a, b), (cost, p) in best.items()), key=lambda x: x[:3])[3]
        letters = []
        while path is not None:
            letters.append(LETTERS[path[0]] if path[0] else " ")
            path = path[1]
        return "".join(reversed(letters))


class Reader:
    """Words of a text as the score sees them: plain ones trimmed, odd ones restored. Remembers what it has read."""

    def __init__(self, model: np.ndarray, most: int = 200_000):
        self.channel, self.most = Channel(model), most
        self.known: dict[str, tuple[str, ...]] = {}

    def word(self, raw: str) -> tuple[str, ...]:
        got = self.known.get(raw)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[raw] = self.read(raw)
        return got

    def read(self, raw: str) -> tuple[str, ...]:
        core = raw.lower().strip(EDGE)
        if not _ODD.search(core):
            return (core,) if core else ()
        core = _SIGN_RUN.sub("", core).strip(EDGE)
        odd = _ODD.search(core)
        if not odd:
            return (core,) if core else ()
        if letters_in(core) < 3 or _NUMBER.search(core) or _ADDRESS.search(core):
            return (core,)
        return tuple(dict.fromkeys((core, *self.channel.restore(core).split())))

    def undoubled(self, word: str) -> list[str]:
        return self.channel.restore(word).split()

    def spaced(self, text: str) -> list[str]:
        out: list[str] = []
        for m in _SPACED.finditer(text):
            run = " ".join(m[0].lower().split())
            if letters_in(run) >= 3 and not _NUMBER.search(run):
                out += self.channel.restore(run).split()
        return out


def beginnings(word: str) -> list[str]:
    """The word itself (with an end mark) and its beginnings."""
    return [word + "$", *(word[:k] for k in range(3, min(len(word), 9)))]


def features_of(reader: Reader, text: str) -> set[str]:
    words: set[str] = set()
    for raw in set(text.split()):
        words.update(reader.word(raw))
    words.update(reader.spaced(text))
    return {f for w in words if len(w) >= 3 for f in beginnings(w)}


class Scorer:
    """Hits of a lexicon in a text."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float], most: int = 300_000):
        self.reader, self.lexicon, self.most = Reader(model), lexicon, most
        self.roots = {f[:3] for f in lexicon}
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if word[:3] not in self.roots:
            return 0.0
        return max((self.lexicon.get(f, 0.0) for f in beginnings(word)), default=0.0) if len(word) >= 3 else 0.0

    def raw_weight(self, raw: str) -> float:
        read = self.reader.read(raw)
        best = max(map(self.weight, read), default=0.0)
        if not best and len(read) == 1 and read[0].isalpha() and _DOUBLED.search(read[0]):
            # letters said twice may be a disguise, too: looked up once more as the lattice reads them
            best = max(map(self.weight, self.reader.undoubled(read[0])), default=0.0)
        return best

    def hits(self, text: str) -> list[float]:
        """log hits, log distinct hits, hits a hundred words, largest and mean weight."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        words = text.split()
        found: list[tuple[str, float]] = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = self.raw_weight(w)
            if x:
                found.append((w, x))
        found += [(w, x) for w in self.reader.spaced(text) if (x := self.weight(w))]
        if not found:
            return [0.0] * 5
        weights = [x for _, x in found]
        return [math.log1p(len(found)), math.log1p(len({w for w, _ in found})), min(100 * len(found) / max(len(words), 1), 20.0), max(weights), sum(weights) / len(weights)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (last: constant) by damped Newton steps."""
    f = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(f.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (p - y) + ridge * w
        hess = (f * (p * (1 - p))[:, None]).T @ f + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Fitted:
    """A trained score: broadcast character model and lexicon, weights; or one score for all."""

    model: Broadcast | None
    lexicon: Broadcast | None
    weights: np.ndarray | None
    flat: float = 0.0

    def scorer(self) -> Scorer | None:
        return Scorer(self.model.value, self.lexicon.value) if self.model is not None else None

    def scores(self, scorer: Scorer | None, texts: pa.Array) -> np.ndarray:
        if scorer is None:
            return np.full(len(texts), self.flat)
        x = np.array([scorer.hits(t.as_py() or "") for t in texts]).reshape(len(texts), 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 3, held: int = 1, most_labelled: int = 6000, least_documents: int = 4, least_weight: float = 1.5, most_features: int = 50_000) -> Fitted:
    """Train on ``docs`` and the labels of all folds but ``held``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = remainder(F.col("doc_id"), folds)
    taught = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = taught.filter("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).unionByName(taught.filter("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled))
    ids = [(r["doc_id"], r["y"]) for r in chosen.collect()]
    classes = {y for _, y in ids}
    if len(classes) < 2:
        return Fitted(None, None, None, float(next(iter(classes), 0)))
    sample = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))  # at most 2 x most_labelled rows
    half = (F.xxhash64("doc_id", F.lit(3)) % 4 == 0).alias("second")
    seen = materialize(docs.join(sample, "doc_id").select("text", "y", half), "labelled").repartition(max(1, min(24, len(ids) // 400)))
    model = spark.sparkContext.broadcast(language_model(docs))

    def count(batches: Iterator[pa.RecordBatch], wanted: set[str] | None) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(model.value), Counter()
        for batch in batches:
            for t in batch.column(0):
                found = features_of(reader, t.as_py() or "")
                total.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    first = seen.filter("not second")
    toxic = first.filter("y = 1").select("text").mapInArrow(lambda b: count(b, None), "feature string, n long")
    often = toxic.groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_documents).orderBy(F.desc("n"), "feature").limit(most_features).collect()
    a_of = {r["feature"]: r["n"] for r in often}
    wanted = set(a_of)
    plain = first.filter("y = 0").select("text").mapInArrow(lambda b: count(b, wanted), "feature string, n long")
    b_of = {r["feature"]: r["n"] for r in plain.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    sizes = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = lexicon_of(a_of, b_of, sizes.get(1, 0), sizes.get(0, 0), least_weight)
    known = spark.sparkContext.broadcast(lexicon)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.hits(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))], names=["y", "x"])

    rows = seen.filter("second").select("y", "text").mapInArrow(hits, "y int, x array<double>").collect()
    if len({r["y"] for r in rows}) < 2:
        rows = seen.select("y", "text").mapInArrow(hits, "y int, x array<double>").collect()
    if len({r["y"] for r in rows}) < 2:  # labelled ids that the documents do not hold
        return Fitted(None, None, None, float(rows[0]["y"]) if rows else 0.0)
    return Fitted(model, known, logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)))


def score(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    fitted = fit(docs, labels, folds=folds, held=held, **options)
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(True)).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = fitted.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.scores(scorer, batch.column(1)))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns; scored where they are read."""
    fitted = fit(docs, labels, **options)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = fitted.scorer()
        for batch in batches:
            yield batch.filter(pa.array(fitted.scores(scorer, batch.column(place)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def lexicon_of(a_of: dict[str, int], b_of: dict[str, int], n_toxic: int, n_plain: int, least: float) -> dict[str, float]:
    """Features whose log odds, each count moved two deviations against them, are ``least`` at the least."""
    out = {}
    for f, a in a_of.items():
        b = b_of.get(f, 0)
        low = max(a - 1.5 * math.sqrt(a), 0.1) / max(n_toxic, 1)
        high = (b + 1.5 * math.sqrt(b) + 1) / max(n_plain, 1)
        w = math.log(low / high)
        if w >= least:
            out[f] = w
    return out
