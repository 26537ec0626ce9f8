"""Embedding, vector search and BM25 re-ranking in the JVM; TF-IDF sentence selection in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.text import words
from evalloom.session import materialize, new_path, numbered, ship


def pseudo_embedding(text: Column, dim: int = 384) -> Column:
    """The offline stand-in for a model: bytes of SHA-512 around zero, cycled to ``dim`` and scaled to length 1."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 512)
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5) * 0.1)
    # bound once: 64 numbers, then repeated
    return F.transform(F.array(one), lambda v: unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: v[i % 64])))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.try_divide(x, s["n"])))[0]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(queries: DataFrame, items: DataFrame, k: int, same: str | None = None, metric: str = "l2", most_queries: int = 10_000) -> DataFrame:
    """The ``k`` nearest items of each query: (query_id, item_id, distance, rank).

    queries (query_id, query_vec[, same]), items (item_id, vec[, same]). The queries, a stated set of at most
    ``most_queries`` (checked), are broadcast against all items; each task keeps its own best ``k`` of a query before the
    shuffle, in a bounded top-k aggregate. With ``same`` only items that agree in that column are searched: an equi-join.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries; search in blocks")
    return _nearest(queries, items, k, same, metric)


def vector_top_k_in_blocks(queries: DataFrame, items: DataFrame, k: int, same: str | None = None, metric: str = "l2", most_queries: int = 10_000) -> DataFrame:
    """As ``vector_top_k``, for any number of queries: a block of at most ``most_queries`` after the other is broadcast.

    Rows that share a query_id may lie in two blocks, so what the blocks find is ranked once more.
    """
    if queries.limit(most_queries + 1).count() <= most_queries:
        return _nearest(queries, items, k, same, metric)
    spark = queries.sparkSession
    dealt = materialize(numbered(queries, F.col("query_id").asc_nulls_last()), "queries")
    path = new_path(spark, "nearest")
    for at in range(0, dealt.count(), most_queries):
        block = dealt.filter(F.col("place").between(at, at + most_queries - 1)).drop("place")
        found = _nearest(block, items, k, same, metric)
        found.write.mode("append").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    return _ranked(found.drop("rank"), k)


def _nearest(queries: DataFrame, items: DataFrame, k: int, same: str | None, metric: str) -> DataFrame:
    q = F.broadcast(queries)
    pairs = items.join(q, same) if same else items.crossJoin(q)
    far = squared_distance(F.col("vec"), F.col("query_vec")) if metric == "l2" else 1 - dot(F.col("vec"), F.col("query_vec"))
    return _ranked(pairs.select("query_id", "item_id", far.alias("distance")), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("query_id").orderBy("distance", "item_id")
    # Spark turns rank limits of this form into a partial top-k before the exchange
    return scored.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)


def bm25(pairs: DataFrame, query_id: str, query: str, item_id: str, text: str, prior: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi scores of retrieved items, each query's items being its corpus: (query_id, item_id, score, rank).

    Negative idf becomes ``epsilon`` times the mean idf; repeated query words count again; ties keep the prior order.
    """
    p = pairs.select(F.col(query_id).alias("q_"), F.col(item_id).alias("i_"), F.col(prior).alias("prior_"), words(query).alias("asked_"), words(text).alias("said_"))
    # read six times below: written once, so retrieval before it runs once
    p = materialize(p.withColumn("length_", F.size("said_")), "bm25")
    sizes = p.groupBy("q_").agg(F.count("*").alias("n_"), F.avg("length_").alias("mean_"))
    tf = p.select("q_", "i_", F.explode("said_").alias("t_")).groupBy("q_", "i_", "t_").agg(F.count("*").alias("tf_"))
    df = tf.groupBy("q_", "t_").agg(F.count("*").alias("df_")).join(sizes, "q_")
    idf = df.select("q_", "t_", (F.log(F.col("n_") - F.col("df_") + 0.5) - F.log(F.col("df_") + 0.5)).alias("idf_"))
    mean = idf.groupBy("q_").agg(F.avg("idf_").alias("mean_idf_"))
    idf = idf.join(mean, "q_").select("q_", "t_", F.when(F.col("idf_") < 0, epsilon * F.col("mean_idf_")).otherwise(F.col("idf_")).alias("idf_"))
    asked = p.select("q_", "i_", "length_", F.explode("asked_").alias("t_"))
    weighted = asked.join(tf, ["q_", "i_", "t_"]).join(idf, ["q_", "t_"]).join(sizes, "q_")
    part = F.col("idf_") * F.col("tf_") * (k1 + 1) / (F.col("tf_") + k1 * (1 - b + b * F.col("length_") / F.col("mean_")))
    scores = weighted.groupBy("q_", "i_").agg(F.sum(part).alias("score_"))
    out = p.select("q_", "i_", "prior_").join(scores, ["q_", "i_"], "left").withColumn("score", F.coalesce("score_", F.lit(0.0)))
    rank = Window.partitionBy("q_").orderBy(F.desc("score"), "prior_")
    return out.select(F.col("q_").alias(query_id), F.col("i_").alias(item_id), "score", F.row_number().over(rank).alias("rank"))


def bm25_in_rows(rows: DataFrame, query: str, texts: Column, order: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``rows`` with the places (from 0) of each row's ``texts``, best first by the scores of ``bm25``, the row being the corpus.

    Scores that are equal to nine places keep the order of the texts; no texts, no places. For lists that fit into a row: words
    never become rows, so nothing is shuffled, joined or broadcast, and numpy counts them for a batch of rows at a time.
    """
    ship(rows.sparkSession)
    n = len(rows.columns)
    cut = rows.select("*", words(query).alias("asked_"), F.transform(F.coalesce(texts, F.array().cast("array<string>")), words).alias("said_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = bm25_places(batch.column(n), batch.column(n + 1), k1, b, epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], places], names=[*batch.schema.names[:n], order])

    return cut.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(order, T.ArrayType(T.IntegerType()))]))


def bm25_places(asked: pa.ListArray, said: pa.ListArray, k1: float, b: float, epsilon: float) -> pa.ListArray:
    """Places of each row's texts, best first: the words of a batch's queries, and those of each row's texts."""
    sizes = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    each = said.flatten()
    length = pc.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
    mean = np.bincount(row, length, len(sizes)) / np.maximum(sizes, 1)
    coded = pa.concat_arrays([each.flatten(), asked.flatten()]).dictionary_encode()
    codes, n_words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    n_said = int(length.sum())
    pair, tf = np.unique(np.repeat(np.arange(len(row)), length) * n_words + codes[:n_said], return_counts=True)
    at, word = pair // n_words, pair % n_words
    term, which, df = np.unique(row[at] * n_words + word, return_inverse=True, return_counts=True)
    own = term // n_words
    idf = np.log(sizes[own] - df + 0.5) - np.log(df + 0.5)
    mean_idf = np.bincount(own, idf, len(sizes)) / np.maximum(np.bincount(own, minlength=len(sizes)), 1)
    idf = np.where(idf < 0, epsilon * mean_idf[own], idf)
    by_row = np.repeat(np.arange(len(sizes)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
    wanted, times = np.unique(by_row * n_words + codes[n_said:], return_counts=True)
    repeats = np.zeros(len(term), np.int64)
    _, here, there = np.intersect1d(term, wanted, assume_unique=True, return_indices=True)
    repeats[here] = times[there]
    part = repeats[which] * idf[which] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[at] / mean[row[at]]))
    score = np.bincount(at, part, len(row))
    first = np.cumsum(sizes) - sizes
    best = np.lexsort((np.arange(len(row)), -np.round(score, 9), row))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(best - first[row[best]], pa.int32()))


def sentences(text: Column) -> Column:
    """Where white space follows a full stop, exclamation or question mark, a text is cut; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: x != "")


def _numbered_sentences(docs: DataFrame, doc_id: str, question: str, text: str) -> DataFrame:
    """(row_, doc_id, asked_, sentence_no, sentence): rows that share an id stay apart by a number of their own."""
    rows = docs.select(doc_id, F.col(question).alias("asked_"), sentences(F.col(text)).alias("sentences_"), F.monotonically_increasing_id().alias("row_"))
    return materialize(rows, "rows").select("row_", doc_id, "asked_", F.posexplode("sentences_").alias("sentence_no", "sentence"))


def bm25_sentences(docs: DataFrame, doc_id: str, question: str, text: str, k: int) -> DataFrame:
    """The ``k`` sentences of each document that answer its question best by BM25, the document being the corpus:
    (doc_id, sentence_no, sentence, score, rank). Ties keep the order of the text; rows that share an id are documents apart."""
    cut = _numbered_sentences(docs, doc_id, question, text)
    best = bm25(cut.withColumn("prior_no", F.col("sentence_no")), "row_", "asked_", "sentence_no", "sentence", "prior_no").filter(F.col("rank") <= k)
    return cut.drop("asked_").join(best, ["row_", "sentence_no"]).select(doc_id, "sentence_no", "sentence", "score", "rank")


def vector_sentences(docs: DataFrame, doc_id: str, question: str, text: str, k: int) -> DataFrame:
    """As ``bm25_sentences``, by the distance of the (stand-in) embeddings: (doc_id, sentence_no, sentence, distance, rank)."""
    cut = _numbered_sentences(docs, doc_id, question, text)
    far = squared_distance(pseudo_embedding(F.col("sentence")), pseudo_embedding(F.concat(F.lit("query: "), F.col("asked_"))))
    near = Window.partitionBy("row_").orderBy("distance", "sentence_no")
    ranked = cut.withColumn("distance", far).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    return ranked.select(doc_id, "sentence_no", "sentence", "distance", "rank")


def tfidf_sentences(docs: DataFrame, doc_id: str, text: str, k: int | None) -> DataFrame:
    """The ``k`` sentences (None: all) of each document with the largest mean tf-idf of their words, ranked.

    idf is taken over the document's sentences; one without words scores 0; (doc_id, sentence_no, sentence, score, rank). All
    of it lies inside one row, so nothing is shuffled: the JVM cuts sentences and words, and numpy counts them for a batch of
    documents at a time. Rows that share an id are documents apart; null texts have no sentences.
    """
    ship(docs.sparkSession)
    cut = docs.select(doc_id, sentences(F.col(text)).alias("sentences")).select(doc_id, "sentences", F.transform("sentences", words).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, no, score, rank = sentence_ranks(batch.column(1), batch.column(2))
            best = np.arange(len(doc)) if k is None else np.flatnonzero(rank <= k)
            said = pa.array(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[best])), pa.array(no[best], pa.int32()), batch.column(1).flatten().take(said), pa.array(score[best]), pa.array(rank[best], pa.int32())],
                names=[doc_id, "sentence_no", "sentence", "score", "rank"],
            )

    more = (("sentence_no", T.IntegerType()), ("sentence", T.StringType()), ("score", T.DoubleType()), ("rank", T.IntegerType()))
    ranked = cut.mapInArrow(run, T.StructType([cut.schema[0], *(T.StructField(n, t) for n, t in more)]))
    return ranked.withColumn("score", F.round("score", 6))


def sentence_ranks(sentences: pa.ListArray, said: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, score and rank (from 1) of each sentence of a batch; equal scores rank by number."""
    sizes = pc.list_value_length(sentences).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.arange(len(doc))
    each = said.flatten()
    coded = each.flatten().dictionary_encode()
    n_words = max(1, len(coded.dictionary))
    at = np.repeat(row, pc.list_value_length(each).to_numpy(zero_copy_only=False))
    pair, tf = np.unique(at * n_words + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    at, word = pair // n_words, pair % n_words
    _, which, df = np.unique(doc[at] * n_words + word, return_inverse=True, return_counts=True)
    idf = np.log((1 + sizes[doc[at]]) / (1 + df[which]))
    score = np.bincount(at, tf * idf, len(doc)) / np.maximum(np.bincount(at, tf, len(doc)), 1)
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((row, -np.round(score, 9), doc))] = row - first + 1
    return doc, row - first, score, rank
