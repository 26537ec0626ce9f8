"""The queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import embedding_dedup, html_extract, mixing, ngram_join, packing, pieces, quality_classifier, quality_rules, runs, token_files, toxicity, vector_codes, warc
from evalloom.llm.common import bound, materialize, table, text_or_empty, word_array


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = materialize(quality_rules.with_measures(docs).drop("text"), "measures")
    judged = quality_rules.judge(measured, quality_rules.fences(measured))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op7_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.score(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(_partly_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")))
    top, decimal = F.col("top_run"), lambda r, name: r[name].cast("string")
    lines = F.transform("runs", lambda r: F.concat(decimal(r, "start"), F.lit(","), decimal(r, "length"), F.lit(","), decimal(r, "period"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * top_run.length div top_run.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_compress_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    found = vector_codes.with_label_errors(materialize(coded, "codes"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hashed(F.array_join("ids", ",")).alias("ids_sha256"),
        hashed(F.col("decoded")).alias("decoded_sha256"),
        hashed(F.concat_ws(";", F.array_join("span_starts", ","), F.array_join("span_ends", ","))).alias("spans_sha256"),
    )


def _partly_repeated(docs: DataFrame) -> DataFrame:
    """Every tenth document by the CRC-32 of its id repeats some of its words to its end, as the query's definition says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    docs = bound(docs, words=F.when(F.col("g").isNotNull(), word_array(text_or_empty("text"))))
    n, g = F.size("words").cast("long"), F.col("g")
    docs = bound(docs, a=F.when(n > 0, g % n), p=F.when(n > 0, 1 + F.floor((n - g % n) / (3 + g % 8))))
    a, p, i = F.col("a"), F.col("p"), lambda k: k.cast("long")
    from_place = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.get("words", F.when(i(k) < a, i(k)).otherwise(a + (i(k) - a) % p).cast("int")))
    return docs.select("doc_id", F.when(a.isNotNull(), F.array_join(from_place, " ")).otherwise(F.col("text")).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_sequences": op1_pack_sequences,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_token_files": op3_token_files,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_score_toxicity": op7_score_toxicity,
    "op8_extract_html": op8_extract_html,
    "op9_classify_quality": op9_classify_quality,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_compress_vectors": op12_compress_vectors,
    "op13_sentence_pieces": op13_sentence_pieces,
}


def _lloyd_sql(rounds: int) -> str:
    """Integer product quantisation by plain joins of all parts with all entries of their codebooks."""
    near = "SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT vec_id, t.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM t JOIN b{k} b ON t.p = b.p) GROUP BY 1, 2"
    moved = """SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(s ORDER BY i) AS c FROM
      (SELECT a.p, a.e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s FROM a{k} a JOIN t USING (vec_id, p), unnest(range(1, len(x) + 1)) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) m ON b.p = m.p AND b.e = m.e"""
    steps = ", ".join(f"a{k} AS MATERIALIZED ({near.format(k=k)}), b{k + 1} AS MATERIALIZED ({moved.format(k=k)})" for k in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS MATERIALIZED (SELECT vec_id, p, w[p * len(w) // 16 + 1:(p + 1) * len(w) // 16] AS x FROM v, unnest(range(16)) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM t WHERE vec_id IN (SELECT vec_id FROM v ORDER BY 1 LIMIT 64)),
{steps}, z AS MATERIALIZED ({near.format(k=rounds)}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z JOIN v USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


#: SQL twins: the definitions, by plain joins. The other operators' results (packings, files, learned scores, sketches, seeded
#: draws, trees) are held against brute force, round trips and held-out labels in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op12_compress_vectors": _lloyd_sql(2),
    "op2_warc_round_trip": """
WITH b AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM b),
x AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
max(page_id) OVER (PARTITION BY h) AS last FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM x""",
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id FROM m LEFT JOIN n ON n.doc_id = id""",
    "op6_quality_rules": r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, w[i:i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY 1),
b AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / n_words AS x1, n_repeat_words / n_words AS x2, n_dup_lines / greatest(n_words / 10, 1) AS x3, word_chars / n_words AS x4 FROM b),
q AS (SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, quantile_disc(x4, [0.25, 0.75]) AS q FROM m WHERE NOT base_failed AND n_words > 0 GROUP BY ROLLUP (lang, source)),
c AS (SELECT p.lang, p.source, list_transform([1, 2], lambda i: (p.n * p.q[i] + 8 * ((l.n * l.q[i] + 8 * e.q[i]) / (l.n + 8))) / (p.n + 8)) AS q
  FROM q p JOIN q l ON p.level = 0 AND l.level = 1 AND p.lang IS NOT DISTINCT FROM l.lang JOIN q e ON e.level = 3),
u AS (SELECT m.* FROM m JOIN c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
  WHERE NOT base_failed AND n_words > 0 AND x4 BETWEEN q[1] - 1.5 * (q[2] - q[1]) AND q[2] + 1.5 * (q[2] - q[1])),
t AS (SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, [quantile_disc(n_words::DOUBLE, [1 / 64, 0.5, 63 / 64]), quantile_disc(x1, [1 / 64, 0.5, 63 / 64]),
  quantile_disc(x2, [1 / 64, 0.5, 63 / 64]), quantile_disc(x3, [1 / 64, 0.5, 63 / 64]), quantile_disc(x4, [1 / 64, 0.5, 63 / 64])] AS q FROM u GROUP BY ROLLUP (lang, source)),
z AS (SELECT c.lang, c.source, coalesce(p.n, 0) AS pn, p.q AS pq, coalesce(l.n, 0) AS ln, l.q AS lq, e.q AS eq, [256, 256, 256, 256, 8] AS k FROM c LEFT JOIN t p ON p.level = 0 AND p.lang IS NOT DISTINCT FROM c.lang
  AND p.source IS NOT DISTINCT FROM c.source LEFT JOIN t l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM c.lang JOIN t e ON e.level = 3),
d AS (SELECT lang, source, list_transform([1, 2, 3, 4, 5], lambda j: list_transform([1, 2, 3],
  lambda i: (pn * coalesce(pq[j][i], 0) + k[j] * ((ln * coalesce(lq[j][i], 0) + k[j] * eq[j][i]) / (ln + k[j]))) / (pn + k[j]))) AS s FROM z),
f AS (SELECT lang, source, s[2][3] + 2 * greatest(s[2][3] - s[2][2], 1 / s[1][1]) AS h1, s[3][3] + 2 * greatest(s[3][3] - s[3][2], 6 / s[1][1]) AS h2,
  s[4][3] + 2 * greatest(s[4][3] - s[4][2], 1 / greatest(s[1][1] / 10, 1)) AS h3, s[5][3] + 2 * (s[5][3] - s[5][2]) AS h4, s[5][1] - 2 * (s[5][2] - s[5][1]) AS l4 FROM d)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words > 0
  AND coalesce(x1 <= h1 AND x2 <= h2 AND x3 <= h3 AND x4 BETWEEN l4 AND h4, false) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT id AS vec_id, coalesce(k.n, 0) AS n_links, c AS component_id, id = c AS kept FROM m LEFT JOIN k ON k.a = id""",
}
