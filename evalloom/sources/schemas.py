"""Record schemas and a validator that returns violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<page:int,bbox:array<double>,text:string,confidence:double>>"
TABLES = "array<struct<page:int,bbox:array<double>,cells:array<struct<row:int,col:int,row_span:int,col_span:int,text:string,bbox:array<double>>>>>"
SPANS = "array<struct<type:string,start:int,end:int,original_hash:string,action:string,block_page:int>>"

# Columns of the records.
OCR_RESULT = f"case_id string, ocr_provider string, ocr_version string, page_count int, text_blocks {BLOCKS}, tables {TABLES}, latency_ms double, error string"
LLM_RESPONSE = "content string, usage map<string,bigint>, latency_ms double, cost_usd double, deployment_id string, cache_status string, pricing_effective_date string"
GT_EXTRACTION = f"case_id string, schema_version string, fields map<string,string>, tables array<struct<rows:array<array<string>>>>, pii_spans {SPANS}"
GT_RAG = "case_id string, question string, answer string, source_pages array<int>, is_refusable boolean, expected_citation_pages array<int>"
EVAL_LOG = (
    "ts string, track string, case_id string, config string, provider string, model string, deployment_id string, input_tokens bigint, output_tokens bigint, latency_ms double, cost_usd double, "
    f"cache_status string, pred string, ref string, score string, redacted_text string, pii_spans {SPANS}, error string"
)
LONGBENCH_RAW = "_id string, input string, context string, answers array<string>, length int, language string"
QUESTION = "id string, task string, dataset string, input string, context string, question string, answer string, length int, language string"
RUN = (
    "ts string, case_id string, task string, question string, gold string, pred string, status string, mode string, compress_ms double, origin_tokens int, compressed_tokens int, compress_ratio double, "
    "llm_model string, llm_latency_ms double, input_tokens int, output_tokens int, gemini_key_id string, gemini_attempts int, judge_correct boolean, judge_reason string, judge_model string, judge_latency_ms double, rate double, device string"
)
AUDIT = "id string, ts timestamp, case_id string, policy_version string, span_count map<string,bigint>, total_redactions int, source string"
RUN_METADATA = "run_id string, ts timestamp, phase string, track string, config string, provider string, args string"
# Enumerations.
ENUMS = {"ocr_provider": ("paddleocr", "tesseract", "easyocr"), "track": ("ocr", "track1", "track2", "redaction_smoke"), "cache_status": ("hit", "miss", "bypass", "error"), "judge_verdict": ("correct", "incorrect", "ambiguous", "error", "timeout")}
REQUIRED = {"eval_log": ("ts", "track", "case_id", "config", "provider", "model", "deployment_id", "input_tokens", "output_tokens", "latency_ms", "cost_usd", "cache_status", "pred", "ref", "score"), "ocr_result": ("case_id", "ocr_provider", "page_count"), "gt_rag": ("case_id", "question")}
SCHEMAS = {"ocr_result": OCR_RESULT, "llm_response": LLM_RESPONSE, "gt_extraction": GT_EXTRACTION, "gt_rag": GT_RAG, "eval_log": EVAL_LOG, "longbench_raw": LONGBENCH_RAW, "question": QUESTION, "run": RUN, "redaction_audit": AUDIT, "run_metadata": RUN_METADATA}


def violations(rows: DataFrame, record: str, key: str = "case_id") -> DataFrame:
    """(key, column, problem) for each broken rule: required, enumeration, minimum 0, boxes of four numbers. One pass."""
    checks: list[tuple[str, str, Column]] = [(c, "missing", F.col(c).isNull()) for c in REQUIRED.get(record, ()) if c in rows.columns]
    checks += [(c, "absent column", F.lit(True)) for c in REQUIRED.get(record, ()) if c not in rows.columns]
    checks += [(c, "not in enumeration", F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in ENUMS.items() if c in rows.columns]
    checks += [(c, "below 0", F.col(c) < 0) for c in ("input_tokens", "output_tokens", "latency_ms", "cost_usd", "page_count") if c in rows.columns]
    if "text_blocks" in rows.columns:
        checks.append(("text_blocks", "box without four numbers", F.exists("text_blocks", lambda b: b["bbox"].isNotNull() & (F.size(b["bbox"]) != 4))))
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("column"), F.lit(what).alias("problem"))) for c, what, bad in checks]))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("key", "v.column", "v.problem")
