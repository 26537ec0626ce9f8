"""Prompts as columns. The texts are fixed values: replies depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt texts; names in braces are filled in.
EVAL = "CONTEXT (reference document):\n{context}\n\nQUESTION:\n{question}\n\nAnswer concisely and accurately based on the context. If the answer is not present in the context, reply 'Unknown'."
EXTRACT_A = (
    "You are a contract field extractor. Read the OCR text below and extract the following fields.\n"
    "Output strict JSON with EXACTLY these keys (use null if not found):\n"
    "{fields}\n"
    "\n"
    "Contract text:\n"
    '"""\n'
    "{text}\n"
    '"""\n'
    "\n"
    "Output schema:\n"
    "{schema}\n"
    "\n"
    "Output JSON only, no prose."
)
EXTRACT_B = (
    "You are a contract field extractor. Read the OCR text below and extract the following fields.\n"
    "Output strict JSON with EXACTLY these keys (use null if not found).\n"
    "\n"
    "Example:\n"
    'Input text: "Hop dong so ABC ky ngay 2026-01-15 giua ong Nguyen Van A va Cong ty VINFAST. Gia: 700000000 VND."\n'
    'Output: {"contract_no": "ABC", "sign_date": "2026-01-15", "buyer_name": "Nguyen Van A", "total_price_vnd": 700000000}\n'
    "\n"
    "Now extract from this contract:\n"
    "{fields}\n"
    "\n"
    "Contract text:\n"
    '"""\n'
    "{text}\n"
    '"""\n'
    "\n"
    "Output schema:\n"
    "{schema}\n"
    "\n"
    "Output JSON only, no prose."
)
ASK_A = (
    "You are a contract Q&A assistant. Use ONLY the retrieved context below to answer the question.\n"
    "Cite the chunk IDs in square brackets at the end of each fact, e.g. [case-001-c003].\n"
    'If the answer is not in the context, respond: "I cannot answer this from the provided documents."\n'
    "If the question is out-of-scope (legal advice, financial advice, personal opinions), refuse politely.\n"
    "\n"
    "Context:\n"
    "{chunks}\n"
    "\n"
    "Question: {question}\n"
    "\n"
    "Output JSON:\n"
    '{"answer": "...", "citations": ["chunk-id-1", "..."], "refused": false, "refusal_reason": null}'
)
ASK_B = (
    "You are a contract Q&A assistant. Use ONLY the retrieved context below to answer the question.\n"
    "Example:\n"
    "Context: [case-001-c000] Hop dong so ABC ky ngay 2026-01-15.\n"
    'Question: "Hop dong co hieu luc tu ngay nao?"\n'
    'Output: {"answer": "Hop dong co hieu luc tu ngay 2026-01-15.", "citations": ["case-001-c000"], "refused": false, "refusal_reason": null}\n'
    "\n"
    "Now answer:\n"
    "\n"
    "Context:\n"
    "{chunks}\n"
    "\n"
    "Question: {question}\n"
    "\n"
    "Output JSON:\n"
    '{"answer": "...", "citations": ["chunk-id-1", "..."], "refused": false, "refusal_reason": null}'
)
JUDGE = (
    "You are an expert evaluator. Judge whether the system's answer is correct.\n\nRULES (mandatory):\n- Output JSON only — no explanation before or after\n- JSON must have exactly 3 keys: verdict, reason, confidence\n\n"
    'Evaluation criteria:\n- "correct": answer starts with correct info from ground truth, or is semantically\n  equivalent (e.g. "US" = "United States", "70%" = "70 percent")\n- "ambiguous": possibly correct but uncertain (confidence < 0.7)\n- "incorrect": main information is wrong or contradicts ground truth\n\n'
    "Input:\n---\nContext: {context}\nQuestion: {question}\nGround truth: {gold}\nPrediction: {pred}\n---\n\nRespond in the same language as the input. If the question/context is in Vietnamese,\nrespond in Vietnamese. Otherwise respond in English.\n\nJSON (no explanation):\n"
    '{"verdict": "correct"|"incorrect"|"ambiguous", "reason": "1-2 sentences", "confidence": 0.0-1.0}'
)


def fill(template: str, **values: Column) -> Column:
    """The template with ``{name}`` replaced, in one concatenation, so values may hold braces."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, name = found
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def extraction(variant: str, fields: list[str], text: Column) -> Column:
    """A: without an example, B: with one. The schema lists the keys as valid JSON."""
    schema = "{" + ", ".join(f'"{f}": null' for f in fields) + "}"
    return fill(EXTRACT_A if variant.upper() == "A" else EXTRACT_B, fields=F.lit(", ".join(fields)), text=text, schema=F.lit(schema))


def question(variant: str, asked: Column, chunks: Column) -> Column:
    """chunks: array of struct(chunk_id, text)."""
    listed = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("] "), c["text"])), "\n\n")
    return fill(ASK_A if variant.upper() == "A" else ASK_B, chunks=listed, question=asked)


def evaluation(context: Column, asked: Column) -> Column:
    return fill(EVAL, context=context, question=asked)


def judging(context: Column, asked: Column, gold: Column, pred: Column) -> Column:
    return fill(JUDGE, context=context, question=asked, gold=gold, pred=pred)
