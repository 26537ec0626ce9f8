"""End-to-end runs: field extraction (track 1), question answering (track 2), OCR bake-off. Offline models by default.

Each configuration sees the raw text; retrieval happens once a question, before the configurations are joined on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import prompts, redaction, routing, scores
from evalloom.functions.text import estimated_tokens, field_text, redaction_tokens
from evalloom.operators import alignment, chunking, logs, models, retrieval, stats
from evalloom.session import materialize

# Configurations, field lists, tables without cells.
EXTRACT_CONFIGS = (("A", False, "A", "cheap"), ("B", False, "B", "cheap"), ("D", True, "A", "cheap"), ("B+D", True, "B", "cheap"), ("D-strong", True, "A", "strong"))
ASK_CONFIGS = (("A", "A", False, False, "cheap"), ("B", "B", False, False, "cheap"), ("C", "A", True, False, "cheap"), ("D", "A", False, True, "cheap"), ("B+D", "B", False, True, "cheap"), ("C+D", "A", True, True, "cheap"), ("B+C+D", "B", True, True, "cheap"))
EXPECTED = ["contract_no", "sign_date", "seller_name", "seller_tax_id", "buyer_name", "buyer_phone", "buyer_email", "model", "version", "color", "vin", "unit_price_vnd", "total_price_words_vi"]
EXTRACT_ORDER = ["contract_no", "sign_date", "seller_name", "seller_address", "seller_tax_id", "seller_rep", "seller_rep_title", "buyer_name", "buyer_address", "buyer_phone", "buyer_email", "model", "version", "color", "vin", "includes_battery", "unit_price_vnd", "total_price_words_vi"]
ASK_ORDER = ["contract_no", "sign_date", "seller_name", "seller_address", "seller_tax_id", "buyer_name", "buyer_phone", "buyer_email", "buyer_id", "model", "version", "color", "vin", "unit_price_vnd", "delivery_date", "delivery_place", "special_offer_a", "special_offer_b", "special_offer_c", "special_offer_d", "payment_stage_1_vnd", "payment_method"]
API_ORDER = ["contract_no", "sign_date", "seller_name", "seller_address", "seller_tax_id", "seller_rep", "seller_rep_title", "buyer_name", "buyer_address", "buyer_phone", "buyer_email", "model", "version", "color", "vin", "unit_price_vnd", "total_price_words_vi", "delivery_date", "delivery_place", "special_offer_a", "special_offer_b", "special_offer_c", "special_offer_d"]
QUESTIONS = (("Hop dong co hieu luc tu ngay nao?", "sign_date", False), ("Toi co the mua bao hiem o dau?", None, True))
STUB_COST = 0.0001


def extract_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXTRACT_CONFIGS), "config string, redact boolean, variant string, tier string")


def ask_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASK_CONFIGS), "config string, variant string, use_rerank boolean, use_router boolean, tier string")


def fields_map(contract: Column, names: list[str]) -> Column:
    """Non-empty scalar fields as a map of strings."""
    pairs = [F.when(F.coalesce(contract[n].cast("string"), F.lit("")) != "", F.struct(F.lit(n).alias("key"), contract[n].cast("string").alias("value"))) for n in names]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def track1(contracts: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """EvalLog rows of extraction: one for each contract and configuration."""
    spark = contracts.sparkSession
    base = contracts.select("case_id", F.col("ground_truth_fields").alias("gt"), field_text(F.col("ground_truth_fields"), EXTRACT_ORDER).alias("raw"))
    # redacted once a contract, not once a configuration
    base = base.select("*", F.explode(F.array(redaction.redact(F.col("raw")))).alias("red"))
    rows = logs.across_configs(base, configs if configs is not None else extract_configs(spark))
    text = F.when(F.col("redact"), F.col("red.text")).otherwise(F.col("raw"))
    rows = rows.withColumn("redacted_text", text)
    prompt = F.when(F.col("variant") == "A", prompts.extraction("A", EXPECTED, F.col("redacted_text"))).otherwise(prompts.extraction("B", EXPECTED, F.col("redacted_text")))
    no_tables = F.array().cast("array<struct<cells:array<struct<col:int,text:string>>>>")
    features = routing.features_extraction(no_tables, F.col("redacted_text"), F.lit(len(EXPECTED)))
    reply = models.stub_extraction(F.col("redacted_text"))
    rows = rows.withColumns({"prompt": prompt, "features": features, "reply": reply})
    routed = routing.tier_extraction(F.col("features.n_fields"), F.col("features.has_tables"), F.col("features.n_table_rows"), F.col("features.n_table_cols"))
    return rows.select(
        F.lit("track1").alias("track"),
        "case_id",
        "config",
        F.lit("gemini-stub").alias("provider"),
        routing.deployment(F.col("tier")).alias("deployment_id"),
        estimated_tokens("prompt").alias("input_tokens"),
        estimated_tokens("reply").alias("output_tokens"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(STUB_COST).alias("cost_usd"),
        models.cache_status(F.lit("stub")).alias("cache_status"),
        F.from_json("reply", "map<string,string>").alias("extracted_fields"),
        fields_map(F.col("gt"), EXTRACT_ORDER).alias("ref_fields"),
        scores.expected_types(F.col("gt")).alias("ref_types"),
        F.substring("redacted_text", 1, 1000).alias("redacted_text"),
        F.when(F.col("redact"), F.col("red.spans")).alias("pii_spans"),
        F.col("tier"),
        F.col("features"),
        routing.rule(routed, 1).alias("rule"),
        routed.alias("routed_tier"),
    )


def score_track1(log: DataFrame, by_spans: bool = True) -> DataFrame:
    """Scores of extraction rows. Types come from the spans, or, as published, from the marks in the text."""
    found = F.transform(F.filter("pii_spans", lambda s: s["action"] != "keep_token"), lambda s: s["type"]) if by_spans else redaction_tokens("redacted_text")
    s = log.select("*", scores.field_f1(F.col("extracted_fields"), F.col("ref_fields")).alias("f"), scores.schema_conformance(F.col("extracted_fields"), F.col("ref_fields")).alias("s"), scores.type_scores(found, F.col("ref_types")).alias("p"), F.lit(1.0).alias("table_teds"))
    return s.select("case_id", "config", "deployment_id", "cost_usd", "latency_ms", (F.col("input_tokens") + F.col("output_tokens")).cast("double").alias("total_tokens"), "f.field_f1", "f.field_precision", "f.field_recall", "table_teds", "s.schema_conformance", "p.*")


def summary_track1(scored: DataFrame) -> DataFrame:
    return stats.config_summary(scored, ["config"], {"cost_usd": 6, "latency_ms": 1, "total_tokens": 1, "field_f1": 4, "table_teds": 4, "schema_conformance": 4, "pii_precision": 4, "pii_recall": 4, "pii_f1": 4})


def case_texts(contracts: DataFrame, order: list[str] = API_ORDER) -> DataFrame:
    """(case_id, text): the ``key: value`` lines of each contract that questions about one case are answered from."""
    return contracts.select("case_id", field_text(F.col("ground_truth_fields"), order).alias("text"))


def asked_of(fields: Column) -> Column:
    """The questions to a contract of these fields, an array: one that it answers, one to refuse."""
    return F.array(*[F.struct(F.lit(q).alias("question"), (fields[f] if f else F.lit("")).alias("answer"), F.lit(r).alias("is_refusable")) for q, f, r in QUESTIONS])


def questions(contracts: DataFrame) -> DataFrame:
    """Two questions a contract: one that it answers, one to refuse."""
    return contracts.select("case_id", F.inline(asked_of(F.col("ground_truth_fields"))))


def track2(contracts: DataFrame, top_k: int = 8, configs: DataFrame | None = None) -> DataFrame:
    """EvalLog rows of question answering: one for each question and configuration.

    A contract stays one row from its text to the ranked lists of its questions. Chunks or words as rows of their own would be
    joined back, and from the small files they compress to Spark takes them for tables to broadcast.
    """
    spark = contracts.sparkSession
    g = F.col("ground_truth_fields")
    # bound once: each pattern would put the text together again
    text = F.transform(F.array(field_text(g, ASK_ORDER)), lambda t: redaction.redact(t)["text"])[0]
    texts = contracts.select("case_id", asked_of(g).alias("asked"), text.alias("text"))
    cut = chunking.with_chunks(texts, "text").filter(F.size("chunks") > 0)
    chunk = lambda t, k: F.struct(F.format_string("%s-c%03d", F.col("case_id"), k).alias("chunk_id"), t.alias("text"), retrieval.pseudo_embedding(t).alias("vec"))
    asked = cut.select("case_id", "asked", F.transform("chunks", chunk).alias("chunks")).select("case_id", "chunks", F.posexplode("asked").alias("place", "q")).select("case_id", "chunks", "place", "q.*")
    vectors = spark.createDataFrame([(k, f"query: {q}") for k, (q, *_) in enumerate(QUESTIONS)], "place int, query string").select("place", retrieval.pseudo_embedding(F.col("query")).alias("query_vec"))
    far = F.transform("chunks", lambda c: F.struct(retrieval.squared_distance(c["vec"], F.col("query_vec")).alias("distance"), c["chunk_id"].alias("chunk_id"), c["text"].alias("text")))
    near = F.transform(F.slice(F.sort_array(far), 1, top_k), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text")))
    listed = asked.join(F.broadcast(vectors), "place").select("case_id", "question", "answer", "is_refusable", near.alias("by_distance"))
    ranked = retrieval.bm25_in_rows(listed, "question", F.transform("by_distance", lambda c: c["text"]), "order")
    both = ranked.withColumn("by_bm25", F.transform("order", lambda k: F.get("by_distance", k))).drop("order")
    rows = logs.across_configs(both, configs if configs is not None else ask_configs(spark)).withColumn("chunks", F.when(F.col("use_rerank"), F.col("by_bm25")).otherwise(F.col("by_distance")))
    rows = rows.withColumn("features", routing.features_question(F.col("question"), F.transform("chunks", lambda c: c["text"])))
    routed = routing.tier_question(F.col("features.est_tokens"), F.col("features.requires_multi_clause_synthesis"))
    prompt = F.when(F.col("variant") == "A", prompts.question("A", F.col("question"), F.col("chunks"))).otherwise(prompts.question("B", F.col("question"), F.col("chunks")))
    listed_lines = F.array_join(F.transform("chunks", lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("] "), F.regexp_replace(c["text"], r"\s+", " "))), "\n")
    rows = rows.withColumns({"prompt": prompt, "pred": models.stub_answer(F.col("question"), listed_lines)})
    tier = F.when(F.col("use_router"), routed).otherwise(F.col("tier"))
    return rows.select(
        F.lit("track2").alias("track"), "case_id", "config", "question", F.col("answer").alias("ref_answer"), "is_refusable", F.lit("gemini-stub").alias("provider"), routing.deployment(tier).alias("deployment_id"),
        estimated_tokens("prompt").alias("input_tokens"), estimated_tokens(F.to_json("pred")).alias("output_tokens"), F.lit(0.0).alias("latency_ms"), F.lit(STUB_COST).alias("cost_usd"), F.lit("bypass").alias("cache_status"),
        "pred", F.transform("chunks", lambda c: c["chunk_id"]).alias("valid_chunk_ids"), tier.alias("tier"), routing.rule(routed, 2).alias("rule"),
    )


def score_track2(log: DataFrame) -> DataFrame:
    s = log.select("*", scores.exact_match(F.col("pred.answer"), F.col("ref_answer")).alias("exact_match"), scores.token_f1(F.col("pred.answer"), F.col("ref_answer")).alias("t"), scores.refusal_accuracy(F.col("pred.refused"), F.col("is_refusable")).alias("refusal_accuracy"), scores.citation_precision(F.col("pred.citations"), F.col("valid_chunk_ids")).alias("c"))
    return s.select("case_id", "config", "question", "is_refusable", "cost_usd", "latency_ms", (F.col("input_tokens") + F.col("output_tokens")).cast("double").alias("total_tokens"), "exact_match", "t.token_f1", "refusal_accuracy", "c.citation_precision")


def summary_track2(scored: DataFrame) -> DataFrame:
    means = {"cost_usd": 6, "latency_ms": 1, "total_tokens": 1, "exact_match": 4, "token_f1": 4, "citation_precision": 4}
    return scored.groupBy("config").agg(F.count("*").alias("n_cases"), F.count_if("is_refusable").alias("n_refusal"), *[F.round(F.avg(c), k).alias(f"avg_{c}") for c, k in means.items()], F.round(stats.mean_where(F.col("refusal_accuracy"), F.col("is_refusable")), 4).alias("refusal_accuracy"))


def ask(asked: DataFrame, chunks: DataFrame, top_k: int = 8, variant: str = "A", make: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """Answers to questions: retrieve, re-rank, prompt, call, parse.

    asked (query_id, question[, case_id]), chunks (chunk_id, text, vec[, case_id]); a case_id in both limits the search to its
    own chunks. Returns (query_id, question, chunks, answer, citations, refused, refusal_reason, reply, error). Without a model
    the answer is a mark with the first three chunks cited; a reply that is no JSON object is the answer itself; a question
    without chunks is asked with none.
    """
    own = "case_id" if {"case_id"} <= set(asked.columns) & set(chunks.columns) else None
    more = [own] if own else []
    queries = asked.select("query_id", retrieval.pseudo_embedding(F.concat(F.lit("query: "), F.col("question"))).alias("query_vec"), *more)
    near = retrieval.vector_top_k_in_blocks(queries, chunks.select(F.col("chunk_id").alias("item_id"), "vec", *more), top_k, own)
    found = near.select("query_id", "item_id", F.struct("distance", "item_id").alias("prior"))
    pairs = materialize(found.join(asked.select("query_id", "question"), "query_id").join(chunks.select(F.col("chunk_id").alias("item_id"), "text"), "item_id"), "asked")
    ranked = retrieval.bm25(pairs, "query_id", "question", "item_id", "text", "prior").select("query_id", "item_id", "rank")
    lists = pairs.join(ranked, ["query_id", "item_id"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("item_id").alias("chunk_id"), "text"))).alias("listed"))
    plain = F.transform(F.coalesce("listed", F.array().cast("array<struct<rank:int,chunk_id:string,text:string>>")), lambda c: F.struct(c["chunk_id"].cast("string").alias("chunk_id"), c["text"].alias("text")))
    rows = asked.select("query_id", "question").join(lists, "query_id", "left").select("query_id", "question", plain.alias("chunks"))
    if make is None:
        cited = F.transform(F.slice("chunks", 1, 3), lambda c: c["chunk_id"])
        return rows.select("*", F.lit("[no-llm-set]").alias("answer"), cited.alias("citations"), F.lit(False).alias("refused"), *[F.lit(None).cast("string").alias(c) for c in ("refusal_reason", "reply", "error")])
    replies = models.call_model(rows.withColumn("prompt", prompts.question(variant, F.col("question"), F.col("chunks"))), "prompt", make)
    said = replies.withColumn("said", F.from_json("reply", "answer string, citations array<string>, refused boolean, refusal_reason string"))
    none = F.array().cast("array<string>")
    return said.select(
        "query_id", "question", "chunks", F.coalesce("said.answer", "reply").alias("answer"), F.coalesce("said.citations", none).alias("citations"),
        F.coalesce("said.refused", F.lit(False)).alias("refused"), "said.refusal_reason", "reply", "error",
    )


def bake_off(results: DataFrame, references: DataFrame) -> DataFrame:
    """Per provider: cases, means of valid results, text F1 and error rate against the references (case_id, text)."""
    text = F.array_join(F.transform("text_blocks", lambda b: b["text"]), "\n")
    confidence = F.try_divide(F.aggregate("text_blocks", F.lit(0.0), lambda s, b: s + F.coalesce(b["confidence"], F.lit(0.0))), F.size("text_blocks"))
    rows = results.join(references.select("case_id", F.col("text").alias("ref_text")), "case_id", "left").select("*", F.size("text_blocks").cast("double").alias("n_blocks"), confidence.alias("confidence"), text.alias("said"), scores.ocr_text(text, F.col("ref_text"))["text_f1"].alias("text_f1"))
    rows = alignment.with_error_rates(rows, "said", "ref_text", "rate")
    cer = F.when(F.coalesce(F.col("said"), F.lit("")) == "", 1.0).otherwise(F.bround("rate", 4))
    per = stats.provider_summary(rows, "ocr_provider", "n_blocks", "confidence", "latency_ms", "error")
    valid = F.col("text_f1") > 0
    quality = rows.groupBy("ocr_provider").agg(F.round(stats.mean_where(F.col("text_f1"), valid), 4).alias("avg_f1"), F.round(stats.mean_where(cer, valid), 4).alias("avg_cer"))
    return per.join(quality, "ocr_provider")


def winner(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("avg_f1"), F.asc("avg_latency_ms"), F.asc("ocr_provider")).limit(1)
