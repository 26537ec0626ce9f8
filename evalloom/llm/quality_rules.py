"""Quality rules with thresholds that follow each language and source.

Main path: DataFrame functions only. Quantile sketches (percentile_approx: a mergeable Greenwald-Khanna digest, partly
aggregated before the shuffle) of the rule measures are built at three levels, (lang, source), lang and everything; the fences
derived from them are joined back and filter. No cutoff of a measure is written down here:

1. Sketches of word length among the documents that pass the base rules give quartiles. Documents within Tukey's fences of
   their group (1.5 interquartile ranges beyond the quartiles) are its usual ones, so junk does not shape the tails.
2. Sketches of all four ratios, and of the number of words, among the usual documents give the median and tail quantiles. A
   fence lies beyond the tail by ``spread`` times the distance of tail and median. Ratios of counted things (symbols, repeated
   words and lines) come in steps: the distance is at least one occurrence in a short document, as the lower tail of the same
   group's numbers of words has it, so a tail that coincides with the median leaves room for as much as can be told apart.

Every quantile is a blend of all three levels: a group of n documents has the weight n / (n + prior), its language shares the
rest with everything in the same way. So the sketch of every (lang, source) moves its own fences, however small it is, and a
small group's few odd documents move them little. Word length was trimmed by step 1, so few documents tell where it lies
(``length_prior``); the tail of counted things was not, and takes several times 1 / ``tail`` of them (``prior``).

The sketches are exact while a group has at most about ``accuracy`` documents; beyond, ranks are off by n / ``accuracy``.

Defined results
* null or empty text: no words, all measures 0, base rules fail (fewer words than ``min_words``).
* null lang or source: a group of its own (null-safe join).
* a group none of whose documents passes the base rules has no fences, and nothing of it is kept: all of them fail already. A
  group or a language without usual documents is judged by the levels above.
* ties and repeated rows: every row is judged on its own; equal rows get equal verdicts.
* an empty table gives an empty result; extra columns pass through, clashing names are avoided.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import SPACE_CLASS, SPACES, bound, materialize, private, text_or_empty, word_array

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Fixed base rules, and which quantiles make the fences (see above). ``tail`` is a fraction of two: ranks are exact."""

    min_words: int = 50
    max_repeat_percent: int = 50
    tail: float = 1 / 64
    spread: float = 2.0
    prior: int = 256
    length_prior: int = 8
    accuracy: int = 10_000


def with_measures(df: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """Add the five measures of every whole text, under ``names`` (measure -> column) where given.

    Repeated words: each window of three words becomes one long, its hash above its position; a sort brings equal windows
    together, and the words that such windows cover are counted. With n words the hash has 63 - log2(n) bits.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    words, bits, packed, twice, lines = private(df, "words_", "bits_", "packed_", "twice_", "lines_")
    body = text_or_empty(f"`{text}`")
    left = lambda x: F.call_function("shiftleft", x, F.col(bits))
    right = lambda x: F.call_function("shiftright", x, F.col(bits))
    n = F.size(words)
    window = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: left(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).bitwiseOR(i.cast("long")),
    )
    equal = lambda x, i: (right(x) == right(F.get(packed, i - 1))) | (right(x) == right(F.get(packed, i + 1)))
    place = lambda x: x.bitwiseAND(left(F.lit(1).cast("long")) - 1)
    df = bound(df, **{words: word_array(body)})
    df = bound(df, **{bits: F.length(F.bin(n.cast("long")))})
    df = bound(df, **{packed: F.sort_array(window)})
    df = bound(df, **{twice: F.transform(F.filter(packed, equal), place)})
    df = bound(df, **{lines: F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    values = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(body, SPACE_CLASS + "+", "")),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x, x + 1, x + 2))))),
    }
    return df.select(*keep, *[v.cast("long").alias((names or {}).get(k, k)) for k, v in values.items()])


#: Ratios that get fences: name, expression over the measures, what one occurrence is in a document of ``short`` words (of
#: repeats: a window of three words, twice), whether low values are rejected too.
RATIOS = (
    ("symbols", "n_symbols / n_words", "1 / short", False),
    ("repeats", "n_repeat_words / n_words", "6 / short", False),
    ("lines", "n_dup_lines / greatest(n_words / 10, 1)", "1 / greatest(short / 10, 1)", False),
    ("length", "word_chars / n_words", "0.0D", True),
)


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def _levels(some: DataFrame, names: list[str], at: list[float], rules: Rules, groups: DataFrame | None = None) -> DataFrame:
    """One row for each (lang, source) of ``groups``, or of ``some`` itself: ``names`` with the quantiles ``at``, blended of
    those of the group, of its language and of everything. A group or language that has no rows has no weight."""
    sketches = [F.percentile_approx(name, at, rules.accuracy).alias(name) for name in names]
    levels = materialize(some.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *sketches), "sketches")
    side = lambda level, mark: levels.filter(F.col("level") == level).select(*[F.col(c).alias(f"{c}_{mark}") for c in ("lang", "source", "n", *names)])
    wanted = (levels.filter("level = 0") if groups is None else groups).select("lang", "source")
    same = lambda key, mark: F.col(key).eqNullSafe(F.col(f"{key}_{mark}"))
    pairs = wanted.join(side(0, "own"), same("lang", "own") & same("source", "own"), "left").join(side(1, "wide"), same("lang", "wide"), "left")
    pairs = pairs.crossJoin(F.broadcast(side(3, "all")))  # one row
    some_of = lambda c: F.coalesce(c, F.lit(0))
    prior = lambda name: rules.length_prior if name == "length" else rules.prior
    blend = lambda name, k, mark, above: (some_of(F.col(f"n_{mark}")) * some_of(F.col(f"{name}_{mark}")[k]) + prior(name) * above) / (some_of(F.col(f"n_{mark}")) + prior(name))
    of = lambda name, k: blend(name, k, "own", blend(name, k, "wide", F.col(f"{name}_all")[k]))
    return pairs.select("lang", "source", *[F.array(*[of(name, k) for k in range(len(at))]).alias(name) for name in names])


def _with_group(rows: DataFrame, groups: DataFrame, lang: str, source: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with the columns of their group, under names of their own: two of its keys, then the others. The join is
    null-safe; Spark broadcasts the groups only below its size threshold, and splits hot ones otherwise."""
    names = private(rows, *(f"group_{c}" for c in groups.columns))
    groups = groups.toDF(*names)
    return rows.join(groups, rows[f"`{lang}`"].eqNullSafe(groups[names[0]]) & rows[f"`{source}`"].eqNullSafe(groups[names[1]]), "left"), names


def fences(measured: DataFrame, rules: Rules = Rules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """One row (lang, source, lo, hi) for each pair with documents that pass the base rules; lo and hi follow RATIOS.

    Documents that fail the base rules say nothing about what is usual and stay out of the sketches.
    """
    names = [name for name, *_ in RATIOS]
    ratios = [F.expr(e).cast("double").alias(name) for name, e, _, _ in RATIOS]
    passed = measured.filter(~base_failed(rules) & (F.col("n_words") > 0)).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.col("n_words").cast("double").alias("size"), *ratios)
    quartiles = materialize(_levels(passed, ["length"], [0.25, 0.75], rules), "quartiles")
    joined, (_, _, q) = _with_group(passed, quartiles, "lang", "source")
    beyond = 1.5 * (F.col(q)[1] - F.col(q)[0])  # Tukey's fences
    usual = joined.filter(F.col("length").between(F.col(q)[0] - beyond, F.col(q)[1] + beyond)).select("lang", "source", "size", *names)
    tails = _levels(usual, ["size", *names], [rules.tail, 0.5, 1 - rules.tail], rules, quartiles).withColumn("short", F.col("size")[0])
    lo, hi = [], []
    for name, _, one, both in RATIOS:
        x = F.col(name)
        lo.append(x[0] - rules.spread * (x[1] - x[0]) if both else F.lit(-1.0))
        hi.append(x[2] + rules.spread * F.greatest(x[2] - x[1], F.expr(one)))
    return tails.select("lang", "source", F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))


def judge(measured: DataFrame, limits: DataFrame, rules: Rules = Rules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """Add base_failed and kept."""
    joined, (lang_, source_, lo, hi) = _with_group(measured, limits.select("lang", "source", "lo", "hi"), lang, source)
    failed, kept = private(joined, "base_failed", "kept")
    inside = F.lit(True)
    for k, (_, e, _, _) in enumerate(RATIOS):
        inside = inside & F.expr(e).cast("double").between(F.col(lo)[k], F.col(hi)[k])
    fail = base_failed(rules) | (F.col("n_words") == 0)
    return joined.withColumns({failed: base_failed(rules), kept: F.when(fail, False).otherwise(F.coalesce(inside, F.lit(False)))}).drop(lang_, source_, lo, hi)


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns, whatever their names. Texts are measured once: rows and
    measures are written to the shared folder, and the sketches read only the measures."""
    body = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")] if docs.columns else []
    aside = docs.select(*[F.col(f"`{c}`").alias(c) for c in ("text", "lang", "source")], *body)
    measured = materialize(with_measures(aside).drop("text"), "measured")
    limits = materialize(fences(measured.drop("row_"), rules), "limits")
    return judge(measured, limits, rules).filter("kept").select("row_.*")
