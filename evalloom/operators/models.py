"""Calls of language models, judges, OCR engines and compressors as batch functions, with deterministic offline stand-ins.

A live client is any ``Callable[[str], str]`` made per Python worker by a factory; what it raises becomes a row's error, so a
failing call never fails the job.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.scores import multiset_overlap
from evalloom.functions.text import bracketed_chunks, key_values, normal_text, tokens, words
from evalloom.operators.alignment import block_similarity as table_similarity
from evalloom.operators.retrieval import sentence_ranks, sentences
from evalloom.session import ship

# Dollars per million tokens (in, out), and the default model.
PRICES = {"gemini-3.5-flash-lite": (0.075, 0.30), "gemini-3.1-flash-lite": (0.075, 0.30)}
DEFAULT_MODEL = "gemini-3.5-flash-lite"


def cost(model: Column, tokens_in: Column, tokens_out: Column, ok: Column | None = None) -> Column:
    """Cost of a call, eight places; 0 where it failed; unknown models at the default rate."""
    rate = lambda k: F.coalesce(F.try_element_at(F.create_map(*[x for m, p in PRICES.items() for x in (F.lit(m), F.lit(p[k]))]), model), F.lit(PRICES[DEFAULT_MODEL][k]))
    c = F.round(F.coalesce(tokens_in, F.lit(0)) / 1e6 * rate(0) + F.coalesce(tokens_out, F.lit(0)) / 1e6 * rate(1), 8)
    return c if ok is None else F.when(F.coalesce(ok, F.lit(False)), c).otherwise(0.0)


def cache_status(status: Column) -> Column:
    return F.when(status == "ok", "miss").when(status == "error", "error").when(status == "stub", "bypass").otherwise("error")


# --- offline answers, in the JVM ---


def stub_extraction(contract_text: Column) -> Column:
    """The ``key: value`` lines of the contract as JSON."""
    return F.to_json(key_values(contract_text))


# Words of a question that the documents cannot answer.
OUT_OF_SCOPE = ("out-of-scope", "mua bảo hiểm", "mua bao hiem", "tôi có thể", "toi co the")


def stub_answer(question: Column, prompt: Column) -> Column:
    """struct(answer, citations, refused, refusal_reason): the first chunk, three citations, or a refusal."""
    refused = F.lower(question).rlike("|".join(OUT_OF_SCOPE))
    chunks = bracketed_chunks(prompt)
    return F.struct(
        F.when(refused | (F.size(chunks) == 0), "").otherwise(F.get(chunks, F.lit(0))["text"]).alias("answer"),
        F.when(refused, F.array().cast("array<string>")).otherwise(F.transform(F.slice(chunks, 1, 3), lambda c: c["chunk_id"])).alias("citations"),
        refused.alias("refused"),
        F.when(refused, "out_of_scope").alias("refusal_reason"),
    )


NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def heuristic_verdict(pred: Column, ref: Column) -> Column:
    """A deterministic judge; nothing to judge is ambiguous.

    A reference of yes or no asks for that as the first word, one that is a number (a percent sign may follow) for that number
    anywhere; else correct is what equals or contains the reference, or shares half of the tokens (F1 of one half).
    """
    terms = F.struct(normal_text(pred).alias("p"), normal_text(ref).alias("r"), tokens(pred).alias("a"), tokens(ref).alias("b"))

    def judged(x: Column) -> Column:
        p, r, a, b = (x[c] for c in "prab")
        alike = (p == r) | F.contains(p, r) | (4 * multiset_overlap(a, b) >= F.size(a) + F.size(b))
        right = (
            F.when(r.rlike(r"^(yes|no)[.!]?$"), F.get(a, F.lit(0)) == F.get(b, F.lit(0)))
            .when(r.rlike(f"^{NUMBER}%?$"), F.array_contains(_numbers(p), F.get(_numbers(r), F.lit(0))))
            .otherwise(alike)
        )
        return F.when((p == "") | (r == ""), "ambiguous").when(right, "correct").otherwise("incorrect")

    # bound once: each use below would cut the texts again
    return F.transform(F.array(terms), judged)[0]


# --- replies ---


def _decoded(text: str, at: int) -> dict | None:
    """The JSON object that begins at ``at``, if one does."""
    try:
        return json.JSONDecoder().raw_decode(text, at)[0]
    except (ValueError, RecursionError):  # no JSON, or nested too deeply to be a verdict
        return None


def json_object(text: str | None) -> dict | None:
    """The object at a reply's first brace, else the last object that holds no other; None without any."""
    text = text or ""
    braces = [m.start() for m in re.finditer(r"[{}]", text)]
    opening = [at for at in braces if text[at] == "{"]
    first = _decoded(text, opening[0]) if opening else None
    if first is not None:
        return first
    flat = [at for at, after in pairwise(braces) if text[at] == "{" and text[after] == "}"]
    return next((found for at in reversed(flat) if (found := _decoded(text, at)) is not None), None)


VERDICTS = {"correct": True, "incorrect": False, "ambiguous": None}


def _share(x: object, default: float = 0.5) -> float:
    """A number between 0 and 1, or the default for what is none."""
    try:
        share = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default
    return default if share != share else min(1.0, max(0.0, share))


def verdict_of(reply: str | None) -> tuple[str, bool | None, float, str]:
    """(verdict, correct, confidence, reason); a reply without a verdict is ambiguous."""
    said = (reply or "").strip()
    found = json_object(said) or {}
    verdict = str(found.get("verdict", "")).strip().lower()
    if verdict in VERDICTS:
        return verdict, VERDICTS[verdict], _share(found.get("confidence", 0.5)), str(found.get("reason", ""))[:200]
    return "ambiguous", None, 0.5, f"no JSON verdict (raw: {said[:80]})"[:200]


def parse_verdicts(rows: DataFrame, reply: str) -> DataFrame:
    """Add judge_verdict, judge_correct (tri-state), judge_confidence, judge_reason."""
    ship(rows.sparkSession)
    out = "struct<judge_verdict:string,judge_correct:boolean,judge_confidence:double,judge_reason:string>"

    @F.pandas_udf(out)
    def parsed(replies):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([verdict_of(r) for r in replies], columns=["judge_verdict", "judge_correct", "judge_confidence", "judge_reason"]).astype({"judge_correct": object})

    return rows.withColumn("v_", parsed(F.col(reply))).select("*", "v_.*").drop("v_")


def table_teds(rows: DataFrame, pred: str, ref: str) -> DataFrame:
    """Add struct teds(teds, n_pred, n_ref) for two columns of flat cell texts."""
    ship(rows.sparkSession)

    @F.pandas_udf("struct<teds:double,n_pred:long,n_ref:long>")
    def scored(p, r):  # noqa: ANN001, ANN202
        import pandas as pd

        clean = lambda cells: [c for c in (str(x).strip().lower() for x in (cells if cells is not None else []) if x) if c]
        pairs = [(clean(a), clean(b)) for a, b in zip(p, r, strict=True)]
        return pd.DataFrame({"teds": [table_similarity(a, b) for a, b in pairs], "n_pred": [len(a) for a, _ in pairs], "n_ref": [len(b) for _, b in pairs]})

    return rows.withColumn("teds", scored(F.col(pred), F.col(ref)))


# --- live calls ---


class Retry(Exception):
    """A call that may succeed with another key or later (429, 503, time-out)."""


@dataclass
class KeyRing:
    """Calls with keys in turn: what may be retried goes on with the next key, at most ``most`` attempts."""

    keys: list[str]
    most: int = 4
    at: int = 0
    successes: dict[str, int] = field(default_factory=dict)
    errors: dict[str, int] = field(default_factory=dict)

    def call(self, send: Callable[[str, str], str], prompt: str) -> tuple[str, int]:
        last: Exception | None = None
        for attempt in range(1, self.most + 1):
            key = self.keys[self.at % len(self.keys)]
            self.at += 1
            try:
                reply = send(key, prompt)
            except Retry as e:
                self.errors[key] = self.errors.get(key, 0) + 1
                last = e
                continue
            self.successes[key] = self.successes.get(key, 0) + 1
            return reply, attempt
        raise RuntimeError(f"all {self.most} attempts failed: {last}")


def with_backoff(call: Callable[[], str], attempts: int = 3, base: float = 2.0, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> str:
    jitter = random.Random(seed)
    for k in range(attempts):
        try:
            return call()
        except Retry:
            if k == attempts - 1:
                raise
            sleep(min(cap, base * 2**k) * (0.5 + jitter.random() / 2))
    raise AssertionError


def judge_chain(profiles: list[list[Callable[[str], str]]], prompt: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first reply of profiles of models; Retry is retried, PermissionError skips the model; none left: an error verdict."""
    for models in profiles:
        for model in models:
            try:
                return with_backoff(lambda m=model: m(prompt), attempts, sleep=sleep)
            except (Retry, PermissionError):
                continue
    return '{"verdict": "error"}'


def call_model(rows: DataFrame, prompt: str, make: Callable[[], Callable[[str], str]], parallel: int | None = None) -> DataFrame:
    """Add reply, latency_ms, status, error. ``make`` builds the client once a task."""
    ship(rows.sparkSession)
    rows = rows.repartition(parallel) if parallel else rows
    place = rows.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            out = []
            for p in batch.column(place):
                begun = time.perf_counter()
                try:
                    reply, status, error = client(p.as_py()), "ok", None
                except Exception as e:  # noqa: BLE001  the contract: errors are rows
                    reply, status, error = None, "error", f"{type(e).__name__}: {e}"
                out.append((reply, round((time.perf_counter() - begun) * 1000, 1), status, error))
            extra = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(extra, kinds, strict=True))], names=[*batch.schema.names, "reply", "latency_ms", "status", "error"])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in (("reply", T.StringType()), ("latency_ms", T.DoubleType()), ("status", T.StringType()), ("error", T.StringType())))])
    return rows.mapInArrow(run, schema)


def embed(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], *, prefix: str = "", batch: int = 64, parallel: int | None = None) -> DataFrame:
    """Add embedding (array<float>) and embedding_error. ``make`` builds the encoder once a task; it gets ``batch`` texts at
    a time, each behind ``prefix`` (as "query: " or "passage: "). A batch that fails leaves nulls and the error in its rows;
    null texts are empty."""
    ship(rows.sparkSession)
    rows = rows.repartition(parallel) if parallel else rows
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for rb in batches:
            texts = [prefix + (t or "") for t in rb.column(place).to_pylist()]
            vectors: list = []
            errors: list[str | None] = []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    made, error = [[float(x) for x in v] for v in encoder(some)], None
                    if len(made) != len(some):
                        raise ValueError(f"{len(made)} vectors for {len(some)} texts")
                except Exception as e:  # noqa: BLE001  the contract: errors are rows
                    made, error = [None] * len(some), f"{type(e).__name__}: {e}"
                vectors += made
                errors += [error] * len(some)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*rb.schema.names, "embedding", "embedding_error"])

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_error", T.StringType())])
    return rows.mapInArrow(run, schema)


def compress_offline(docs: DataFrame, doc_id: str, text: str, rate: float) -> DataFrame:
    """A stand-in for prompt compression: the sentences of the largest tf-idf (see ``retrieval.tfidf_sentences``) until they
    hold ``rate`` of the words, in the order of the text: (doc_id, text, origin_tokens, compressed_tokens, compress_ratio).

    One row out for each document that has words; nothing is shuffled, and rows that share an id are documents apart.
    """
    ship(docs.sparkSession)
    cut = docs.select(doc_id, sentences(F.col(text)).alias("sentences"))
    n = F.transform("sentences", lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda x: x != "")))
    cut = cut.select(doc_id, "sentences", F.transform("sentences", words).alias("words"), n.alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, no, _, rank = sentence_ranks(batch.column(1), batch.column(2))
            n, said = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).flatten()
            size = batch.num_rows
            every = np.bincount(doc, n, size).astype(np.int64)
            order = np.lexsort((rank, doc))
            ahead = np.cumsum(n[order]) - n[order]
            ahead -= (np.cumsum(every) - every)[doc[order]]
            kept = np.sort(order[ahead < rate * every[doc[order]]])
            left = np.bincount(doc[kept], n[kept], size).astype(np.int64)
            out = np.flatnonzero(np.bincount(doc[kept], minlength=size))
            offsets = np.searchsorted(doc[kept], np.append(out, size))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), said.take(pa.array(kept))), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out)), texts, pa.array(every[out]), pa.array(left[out])], names=[doc_id, "text", "origin_tokens", "compressed_tokens"])

    more = (("text", T.StringType()), ("origin_tokens", T.LongType()), ("compressed_tokens", T.LongType()))
    done = cut.mapInArrow(run, T.StructType([cut.schema[0], *(T.StructField(name, t) for name, t in more)]))
    return done.withColumn("compress_ratio", F.round(F.try_divide("origin_tokens", "compressed_tokens"), 4))
