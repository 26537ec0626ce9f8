"""Row-level scores: (prediction, reference) -> struct, all in the JVM. Rounded half-even to four places as published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import error_rate, normal_text, normal_value, tokens


def _f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))


def _count(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, test))


def field_f1(pred: Column, ref: Column) -> Column:
    """Over the union of both maps' keys: equal values are hits; a differing value is a miss on both sides."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def sides(m: Column) -> Column:
        keys = F.array_union(F.map_keys(m["p"]), F.map_keys(m["r"]))
        return F.transform(keys, lambda k: F.struct(normal_value(F.try_element_at(m["p"], k)).alias("p"), normal_value(F.try_element_at(m["r"], k)).alias("r")))

    def counted(s: Column) -> Column:
        tp = _count(s, lambda x: (x["p"] != "") & (x["p"] == x["r"]))
        fp = _count(s, lambda x: (x["p"] != "") & (x["p"] != x["r"]))
        fn = _count(s, lambda x: (x["r"] != "") & (x["p"] != x["r"]))
        return F.struct(tp.alias("tp"), (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"), (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"), F.size(s).alias("n"))

    def scored(c: Column) -> Column:
        share = lambda x: F.when(c["n"] == 0, 1.0).otherwise(F.bround(x, 4))
        return F.struct(
            share(_f1(c["precision"], c["recall"])).alias("field_f1"),
            share(c["precision"]).alias("field_precision"),
            share(c["recall"]).alias("field_recall"),
            c["tp"].cast("long").alias("field_n_correct"),
            c["n"].cast("long").alias("field_n_total"),
        )

    # each step is bound once: a use of an unbound expression inside a lambda would run it again
    maps = F.struct(F.coalesce(pred, empty).alias("p"), F.coalesce(ref, empty).alias("r"))
    return F.transform(F.transform(F.transform(F.array(maps), sides), counted), scored)[0]


def schema_conformance(pred: Column, ref: Column) -> Column:
    expected = F.coalesce(F.map_keys(ref), F.array().cast("array<string>"))
    present = F.size(F.array_intersect(expected, F.coalesce(F.map_keys(pred), F.array().cast("array<string>"))))
    n = F.size(expected)
    return F.struct(F.when(n == 0, 1.0).otherwise(F.bround(present / F.greatest(n, F.lit(1)), 4)).alias("schema_conformance"), n.cast("long").alias("schema_n_expected"), present.cast("long").alias("schema_n_present"))


def exact_match(pred: Column, ref: Column) -> Column:
    return F.when(normal_text(pred) == normal_text(ref), 1.0).otherwise(0.0)


def _numbered(array: Column) -> Column:
    """The elements of an array of strings, each with its number among its equals: a set that stands for the multiset.

    A sort brings equals together; run starts and lengths come from neighbours, so the work is linear but for the sort.
    """

    def of(s: Column) -> Column:
        at = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        run = lambda b: F.flatten(F.transform(b, lambda i, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(b, k + 1), F.size(s)) - i), lambda j: F.concat(F.get(s, i), F.lit("\0"), j.cast("string")))))
        return F.transform(F.array(starts), run)[0]

    return F.transform(F.array(F.sort_array(array)), of)[0]


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings; nothing is exploded."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def token_f1(pred: Column, ref: Column, cased: bool = False, places: int = 4, rounding: Callable[[Column, int], Column] = F.bround) -> Column:
    p, r = tokens(pred, cased), tokens(ref, cased)

    def scored(s: Column) -> Column:
        precision, recall = s["same"] / F.greatest(s["p"], F.lit(1)), s["same"] / F.greatest(s["r"], F.lit(1))
        pick = lambda x: F.when((s["p"] == 0) & (s["r"] == 0), 1.0).when((s["p"] == 0) | (s["r"] == 0), 0.0).otherwise(rounding(x, places))
        return F.struct(pick(_f1(precision, recall)).alias("token_f1"), pick(precision).alias("token_precision"), pick(recall).alias("token_recall"))

    # bound once: three results use the overlap
    return F.transform(F.array(F.struct(F.size(p).alias("p"), F.size(r).alias("r"), multiset_overlap(p, r).alias("same"))), scored)[0]


def refusal_accuracy(refused: Column, is_refusable: Column) -> Column:
    return (F.coalesce(refused, F.lit(False)) == F.coalesce(is_refusable, F.lit(False))).cast("double")


def citation_precision(citations: Column, valid: Column) -> Column:
    """Share of the citations (repeats counted) among the valid ids; 0 without citations or valid ids."""
    c = F.coalesce(citations, F.array().cast("array<string>"))
    v = F.array_distinct(F.coalesce(valid, F.array().cast("array<string>")))
    hit = _count(c, lambda x: F.array_contains(v, x))
    none = (F.size(c) == 0) | (F.size(v) == 0)
    return F.struct(F.when(none, 0.0).otherwise(F.bround(hit / F.greatest(F.size(c), F.lit(1)), 4)).alias("citation_precision"), F.size(c).cast("long").alias("n_cited"), F.size(v).cast("long").alias("n_valid"), F.when(none, 0).otherwise(hit).cast("long").alias("n_correct"))


def type_scores(pred: Column, ref: Column) -> Column:
    """Precision, recall and F1 of two sets of types (tokens that are kept must be dropped before); 0 where both are empty."""
    p, r = F.array_distinct(F.coalesce(pred, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(ref, F.array().cast("array<string>")))
    tp, fp, fn = F.size(F.array_intersect(p, r)), F.size(F.array_except(p, r)), F.size(F.array_except(r, p))
    precision, recall = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return F.struct(F.bround(precision, 4).alias("pii_precision"), F.bround(recall, 4).alias("pii_recall"), F.bround(_f1(precision, recall), 4).alias("pii_f1"))


def ocr_text(hypothesis: Column, reference: Column) -> Column:
    """Case-sensitive token F1 and character error rate; an empty text gets 0 and 1."""
    empty = (F.coalesce(hypothesis, F.lit("")) == "") | (F.coalesce(reference, F.lit("")) == "")
    f1 = token_f1(hypothesis, reference, cased=True)["token_f1"]
    return F.struct(F.when(empty, 0.0).otherwise(f1).alias("text_f1"), F.when(empty, 1.0).otherwise(F.bround(error_rate(hypothesis, reference), 4)).alias("cer"), F.lit(0.0).alias("table_teds"))


def value_redaction(values: Column, text: Column, redacted: Column, found: Column | None = None) -> Column:
    """tp: reference values in the text that the redacted text no longer shows; fn: those it still shows; with the values
    ``found`` by the redaction also fp: those of them that hold no reference value and lie in none."""
    v = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
    tp = _count(v, lambda x: F.contains(text, x) & ~F.contains(redacted, x))
    fn = _count(v, lambda x: F.contains(redacted, x))
    parts = [tp.cast("long").alias("tp"), fn.cast("long").alias("fn")]
    if found is not None:
        known = lambda f: F.exists(v, lambda x: F.contains(f, x) | F.contains(x, f))
        parts.append(_count(F.filter(found, lambda f: f.isNotNull() & (f != "")), lambda f: ~known(f)).cast("long").alias("fp"))
    return F.struct(*parts)


# Contract field -> category.
FIELD_CATEGORY = (("buyer_email", "email"), ("buyer_phone", "phone_vn"), ("seller_tax_id", "tax_id"), ("vin", "vin"), ("buyer_id", "cccd"), ("seller_account", "bank_account"))


def expected_types(fields: Column) -> Column:
    """Categories whose field a contract has."""
    return F.array_compact(F.array(*[F.when(F.coalesce(fields[f].cast("string"), F.lit("")) != "", F.lit(c)) for f, c in FIELD_CATEGORY]))


def micro(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return F.struct(F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.bround(_f1(precision, recall), 4).alias("f1"))


#: Scores by name, the extension point: two columns in, one out.
REGISTRY: dict[str, Callable[..., Column]] = {
    "field_f1": field_f1,
    "schema_conformance": schema_conformance,
    "exact_match": exact_match,
    "token_f1": token_f1,
    "refusal_accuracy": refusal_accuracy,
    "citation_precision": citation_precision,
    "pii_precision_recall": type_scores,
    "ocr_text": ocr_text,
}


def register(name: str, score: Callable[..., Column]) -> None:
    REGISTRY[name] = score
