"""Golden vectors of the scalar functions, scores, redaction and routing."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.functions import prompts, redaction, routing, scores, text


def one(spark, column, **values):
    kinds = {k: v for k, v in values.items()}
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, (list, dict)) else _literal(v).alias(k) for k, v in kinds.items()]).select(column.alias("x")).first()
    return row["x"]


def _literal(v):
    if isinstance(v, dict):
        if not v:
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        return F.create_map(*[F.lit(x) for kv in v.items() for x in kv])
    return F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")


@pytest.mark.parametrize(
    ("pred", "ref", "expected"),
    [
        ({"a": "1", "b": "X"}, {"a": "1", "b": "y", "c": "z"}, (0.4, 0.5, 0.3333, 1, 3)),
        ({}, {}, (1.0, 1.0, 1.0, 0, 0)),
        ({"a": " ABC "}, {"a": "abc"}, (1.0, 1.0, 1.0, 1, 1)),
    ],
)
def test_field_f1(spark, pred, ref, expected):
    assert tuple(one(spark, scores.field_f1(F.col("p"), F.col("r")), p=pred, r=ref)) == expected


@pytest.mark.parametrize(("p", "r", "f1"), [("a b b", "b b c", 0.6667), ("Giá 720 triệu", "Giá 720 triệu", 1.0), ("", "", 1.0), ("", "x", 0.0), (None, None, 1.0)])
def test_token_f1(spark, p, r, f1):
    assert one(spark, scores.token_f1(F.col("p").cast("string"), F.col("r").cast("string")), p=p, r=r)["token_f1"] == f1


def test_other_scores(spark):
    assert tuple(one(spark, scores.schema_conformance(F.col("p"), F.col("r")), p={"a": "1", "x": "2"}, r={"a": "1", "b": "2", "c": "3"})) == (0.3333, 3, 1)
    assert one(spark, scores.exact_match(F.lit(" Foo  bar"), F.lit("foo bar"))) == 1.0
    assert one(spark, scores.exact_match(F.lit(None).cast("string"), F.lit(""))) == 1.0
    assert one(spark, scores.refusal_accuracy(F.lit(True), F.lit(False))) == 0.0
    assert tuple(one(spark, scores.citation_precision(F.col("c"), F.col("v")), c=["c1", "c1", "c9"], v=["c1", "c2"])) == (0.6667, 3, 2, 2)
    assert one(spark, scores.citation_precision(F.col("c"), F.col("v")), c=[], v=["c1"])["citation_precision"] == 0.0
    assert tuple(one(spark, scores.type_scores(F.col("p"), F.col("r")), p=["email"], r=["email", "vin"])) == (1.0, 0.5, 0.6667)
    assert tuple(one(spark, scores.type_scores(F.col("p"), F.col("r")), p=[], r=[])) == (0.0, 0.0, 0.0)
    assert tuple(one(spark, scores.ocr_text(F.lit(""), F.lit("x")))) == (0.0, 1.0, 0.0)
    assert tuple(one(spark, scores.value_redaction(F.col("v"), F.lit("a b"), F.lit("[X] b")), v=["a", "b"])) == (1, 1)
    assert tuple(one(spark, scores.value_redaction(F.col("v"), F.lit("a b"), F.lit("[X] b"), F.array(F.lit("a"), F.lit("z"))), v=["a", "b"])) == (1, 1, 1)


def test_text(spark):
    fence = "```"
    assert one(spark, text.without_fence(F.lit(f'{fence}json\n{{"a":1}}\n{fence}'))) == '{"a":1}'
    assert one(spark, text.without_fence(F.lit("  x "))) == "x"
    assert one(spark, text.key_values(F.lit("a: 1\nnoise\nb : x y\na: 2"))) == {"a": "2", "b": "x y"}
    assert [tuple(r) for r in one(spark, text.bracketed_chunks(F.lit("[c-1] one\nx\n [c-2]  two ")))] == [("c-1", "one"), ("c-2", "two")]
    assert one(spark, text.ratio(F.lit("2.1x"), F.lit(1), F.lit(1))) == 2.1
    assert one(spark, text.ratio(F.lit(""), F.lit(100), F.lit(40))) == 2.5
    assert one(spark, text.error_rate(F.lit("é"), F.lit("e"))) == 1.0
    assert one(spark, text.tokens(F.lit("Điều 5, x"))) == ["điều", "5", ",", "x"]
    assert one(spark, text.blank_separated(F.lit("a b\tc "))) == 3
    assert one(spark, text.inline_verdict(F.lit("result: Incorrect - no"))) is False
    assert one(spark, text.inline_verdict(F.lit("?"))) is None
    assert one(spark, text.plain_case(text.case_key(F.lit("/x/contract_synth-ctr-001.pdf")))) == "synth-ctr-001"
    assert one(spark, text.redaction_tokens(F.lit("[REDACTED:EMAIL] [REDACTED:MST]"))) == ["email", "mst"]


def spans_of(spark, t):
    return [(r["type"], r["start"], r["end"]) for r in one(spark, redaction.spans(F.lit(t)))]


def test_redaction_golden(spark):
    assert spans_of(spark, "unit_price_vnd: 340000000") == [("cccd", 16, 25)]
    assert spans_of(spark, "unit_price_vnd: 1050000000") == [("phone_vn", 17, 26)]
    assert spans_of(spark, "MST: SYNTH1234567890") == []
    assert spans_of(spark, "vin: SYNTHQD6993976184") == []
    assert spans_of(spark, "mail a.b@c.vn, MST: 0123456789 và 59X-12345") == [("email", 5, 13), ("tax_id", 15, 30), ("license_plate", 34, 43)]
    r = one(spark, redaction.redact(F.lit("ông Nguyễn Văn An: a@b.vn a@b.vn")))
    assert r["text"] == "ông Nguyễn Văn An: [REDACTED:EMAIL] [REDACTED:EMAIL]"
    assert r["span_count_by_type"] == {"email": 2} and r["total"] == 2
    assert [s["action"] for s in r["spans"]] == ["keep_token", "mask", "mask"]
    hashed = redaction.Policy(categories={"email": redaction.Category("hash")})
    assert one(spark, redaction.redact(F.lit("a@b.vn"), hashed))["text"].startswith("[HASH:")
    assert one(spark, redaction.redact(F.lit(None).cast("string")))["text"] == ""
    with pytest.raises(ValueError, match="unknown action"):
        redaction.Category("drop")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a@b.vn", "123456789", "0912345678", "59X-12345", "MST: 0123456789", "ABCDEFGH123456789", " ", ",", "x"]), max_size=12))
def test_spans_never_overlap(spark, parts):
    found = spans_of(spark, "".join(parts))
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_blocks(spark):
    blocks = F.array(F.struct(F.lit(1).alias("page"), F.lit("x a@b.vn").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("y").alias("text")))
    r = one(spark, redaction.redact_blocks(blocks))
    assert r["redacted_text"] == "x [REDACTED:EMAIL]\ny" and [s["block_page"] for s in r["pii_spans"]] == [1]


@pytest.mark.parametrize(("fields", "rows", "cols", "tier"), [(8, 0, 0, "cheap"), (10, 0, 0, "cheap"), (15, 5, 4, "mid"), (50, 20, 8, "strong"), (5, 15, 2, "strong")])
def test_route_extraction(spark, fields, rows, cols, tier):
    assert one(spark, routing.tier_extraction(F.lit(fields), F.lit(rows > 0), F.lit(rows), F.lit(cols))) == tier


@pytest.mark.parametrize(("est", "synthesis", "tier"), [(1500, False, "cheap"), (5000, False, "mid"), (7000, False, "mid"), (10000, True, "strong"), (1500, True, "strong")])
def test_route_question(spark, est, synthesis, tier):
    assert one(spark, routing.tier_question(F.lit(est), F.lit(synthesis))) == tier


def test_features(spark):
    f = one(spark, routing.features_question(F.lit("a b"), F.col("c")), c=["section x", "clause y", "z"])
    assert tuple(f) == (7, True)


def test_prompts(spark):
    p = one(spark, prompts.evaluation(F.lit("{question}"), F.lit("why?")))
    assert "{question}" in p and "why?" in p
    assert '"a": null, "b": null' in one(spark, prompts.extraction("A", ["a", "b"], F.lit("t")))


def test_difflib_is_the_table_score():
    from evalloom.operators.models import table_similarity

    assert table_similarity(["a", "b"], ["a", "c"]) == 0.5
    assert table_similarity([], []) == 1.0 and table_similarity(["a"], []) == 0.0
    a, b = list("abcabba"), list("cbabac")
    assert table_similarity(a, b) == round(difflib.SequenceMatcher(None, a, b).ratio(), 4)


def test_table_cells_are_redacted(spark):
    t = F.array(F.struct(F.lit(2).alias("page"), F.array(F.struct(F.lit(0).alias("row"), F.lit(1).alias("col"), F.lit("mail a.b@example.test").alias("text"))).alias("cells")))
    r = spark.range(1).select(redaction.redact_cells(t).alias("r"), redaction.redact_cells(F.lit(None).cast("array<struct<page:int,cells:array<struct<row:int,col:int,text:string>>>>")).alias("e")).first()
    assert "example" not in r.r.tables[0].cells[0].text and (r.r.pii_spans[0].block_page, r.r.pii_spans[0].col) == (2, 1) and r.e.tables == []
