"""Text functions: Column -> Column, all in the JVM.

Unicode classes are spelled out (``\\p{L}\\p{N}_``), since Java's ``\\w`` knows ASCII only; white space includes U+00A0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s ]"
BLANK = r"[\s ]"
FENCE = "```"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space at both ends (``trim`` knows the space only)."""
    return F.regexp_replace(_col(text), rf"^{BLANK}+|{BLANK}+$", "")


def tokens(text: Column | str, cased: bool = False) -> Column:
    """Words and single other signs; small letters unless ``cased``."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.regexp_extract_all(t if cased else F.lower(t), F.lit(WORD_OR_SIGN), 0)


def words(text: Column | str) -> Column:
    """Small-letter words only."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD), 0)


def blank_separated(text: Column | str) -> Column:
    """How many pieces white space cuts a text into."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"[^\s ]+")).cast("long")


def estimated_tokens(text: Column | str) -> Column:
    """Four characters a token."""
    return F.floor(F.length(F.coalesce(_col(text), F.lit(""))) / 4).cast("long")


def normal_text(text: Column | str) -> Column:
    """Small letters, runs of white space as one space, none at the ends; null is empty."""
    return F.lower(strip(F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"{BLANK}+", " ")))


def normal_value(value: Column | str) -> Column:
    """A field value for comparison: small letters without white space at the ends; null is empty."""
    return F.lower(strip(F.coalesce(_col(value).cast("string"), F.lit(""))))


def without_fence(text: Column | str) -> Column:
    """The body of a Markdown code fence, or the stripped text where there is none."""
    t = strip(F.coalesce(_col(text), F.lit("")))
    at = F.instr(t, "\n")
    body = F.when(at > 1, t.substr(at + 1, F.length(t))).otherwise(t)
    body = F.when(F.endswith(body, F.lit(FENCE)), body.substr(F.lit(1), F.length(body) - 3)).otherwise(body)
    return F.when(F.startswith(t, F.lit(FENCE)), strip(body)).otherwise(t)


def hash_prefix(text: Column | str, n: int = 12) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, n)


def error_rate(hypothesis: Column | str, reference: Column | str) -> Column:
    """Character error rate: edit distance over the reference's length. Both empty 0, one empty 1."""
    h, r = (F.coalesce(_col(c), F.lit("")) for c in (hypothesis, reference))
    return F.when((h == "") & (r == ""), 0.0).when((h == "") | (r == ""), 1.0).otherwise(F.levenshtein(h, r) / F.length(r))


def redaction_tokens(text: Column | str) -> Column:
    """Types named in ``[REDACTED:TYPE]`` marks, in small letters."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"\[REDACTED:([A-Z_]+)\]"), 1), F.lower)


def key_values(text: Column | str) -> Column:
    """``key: value`` lines as a map; of repeated keys the last counts."""
    lines = F.split(F.coalesce(_col(text), F.lit("")), r"\r?\n")
    line = r"^\s*([A-Za-z_]+)\s*:\s*(.+)$"
    found = F.filter(lines, lambda x: x.rlike(line))
    pairs = F.transform(found, lambda x, i: F.struct(F.regexp_extract(x, line, 1).alias("key"), i.alias("at"), strip(F.regexp_extract(x, line, 2)).alias("value")))
    # sorted by key and place once: the last of each key is followed by another key
    last = F.transform(F.array(F.array_sort(pairs)), lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i + 1)["key"] == x["key"], F.lit(False))))[0]
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def bracketed_chunks(prompt: Column | str) -> Column:
    """``[id] text`` lines as an array of structs."""
    line = r"^\s*\[([\p{L}\p{N}_\-]+)\]\s*(.+)$"
    lines = F.filter(F.split(F.coalesce(_col(prompt), F.lit("")), r"\r?\n"), lambda x: x.rlike(line))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, line, 1).alias("chunk_id"), strip(F.regexp_extract(x, line, 2)).alias("text")))


def field_text(fields: Column | str, order: list[str]) -> Column:
    """``key: value`` lines of the named fields in order; missing and empty ones are left out."""
    f = _col(fields)
    line = [F.when(F.coalesce(f[k].cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), f[k].cast("string"))) for k in order]
    return F.array_join(F.array_compact(F.array(*line)), "\n")


def inline_verdict(text: Column | str) -> Column:
    """Tri-state of a ``RESULT: CORRECT | INCORRECT | ...`` reply."""
    t = F.upper(strip(F.coalesce(_col(text), F.lit(""))))
    return F.when(t.rlike(r"^RESULT:\s*CORRECT"), True).when(t.rlike(r"^RESULT:\s*INCORRECT"), False)


def ratio(text: Column | str, origin: Column | str, compressed: Column | str) -> Column:
    """"2.1x" as 2.1; without one, origin / compressed where both are positive, else 0."""
    said = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "x", "").try_cast("double")
    o, c = _col(origin), _col(compressed)
    return F.coalesce(F.nullif(said, F.lit(0.0)), F.when((o > 0) & (c > 0), o / c), F.lit(0.0))


def case_key(path: Column | str) -> Column:
    """A case id from a file path: last part, without ``.pdf``."""
    return F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"\.pdf$", "")


def plain_case(case_id: Column | str) -> Column:
    """``contract_synth-x`` as ``synth-x``."""
    return F.regexp_replace(_col(case_id), r"^contract_synth-", "synth-")


def money_words(amount: Column | str) -> Column:
    return F.concat(F.format_number(_col(amount).cast("long"), 0), F.lit(" đồng (SYNTH — số tiền bằng chữ tự sinh)"))


def utc_stamp(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
