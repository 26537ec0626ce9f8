"""Keyed run logs: latest row per case, resume, in-place updates, filters, joins of runs with verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("correct", "incorrect", "ambiguous")


def keep_latest(rows: DataFrame, key: list[str], ts: str, order: str) -> DataFrame:
    """The row of the latest ``ts`` for each key; of equal ones the first in file order. Rows without a key all stay.

    One aggregate with a map-side part (the largest struct of a key), instead of a window: a frequent key moves one row a
    task.
    """
    named = F.lit(True)
    for k in key:
        named = named & F.col(k).isNotNull()
    best = rows.filter(named).groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(ts), -F.col(order).cast("long"))).alias("r"))
    return best.select("r.*").unionByName(rows.filter(~named))


def dedup_report(rows: DataFrame, kept: DataFrame, key: str, source: str, most: int = 50) -> DataFrame:
    """One row: counts before and after, and up to ``most`` dropped ids."""
    n = rows.agg(F.count("*").alias("n_input"))
    k = kept.agg(F.count("*").alias("n_kept"))
    some = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(key).limit(most).agg(F.sort_array(F.collect_list(key)).alias("dropped_case_ids"))
    one = n.join(F.broadcast(k), F.lit(True)).join(F.broadcast(some), F.lit(True))
    return one.select(F.lit(source).alias("input"), "n_input", "n_kept", (F.col("n_input") - F.col("n_kept")).alias("n_dropped"), "dropped_case_ids", F.lit("keep_latest_ts").alias("strategy"))


def finished(status: Column, pred: Column) -> Column:
    """Rows that a resumed run skips."""
    return (F.coalesce(status, F.lit("")) == "ok") & (F.coalesce(pred, F.lit("")) != "")


def todo(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def update_rows(rows: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with those of ``changed`` in place of the ones with the same keys; write it to a new version folder."""
    return rows.join(changed.select(*key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def with_verdicts(runs: DataFrame, verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    return runs.join(verdicts, key)


def across_configs(cases: DataFrame, configs: DataFrame) -> DataFrame:
    """Every case under every configuration; configurations are a literal table of a few rows."""
    return cases.crossJoin(F.broadcast(configs))


def error_free(rows: DataFrame, error: str = "error") -> DataFrame:
    return rows.filter(F.coalesce(F.col(error), F.lit("")) == "")


def prediction(pred: Column, text: Column) -> Column:
    """The prediction: ``pred`` or ``text``; of a JSON object its ``text``."""
    p = F.coalesce(F.nullif(pred, F.lit("")), F.nullif(text, F.lit("")), F.lit(""))
    return F.coalesce(F.get_json_object(F.when(F.startswith(p, F.lit("{")), p), "$.text"), p)


def gold(answer_list: Column, answer: Column, answers: Column) -> Column:
    return F.coalesce(F.get(answer_list, F.lit(0)), answer, F.get(answers, F.lit(0)), F.lit(""))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that the table has, as a string."""
    return next((F.col(n).cast("string") for n in names if n in df.columns), F.lit(None).cast("string"))


def top_matches(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank_", F.row_number().over(w)).filter(F.col("rank_") <= n).drop("rank_")


def rate_limited(events: DataFrame, key: str, ts: str, order: str, most: int) -> DataFrame:
    """``allowed``: whether an event is among the first ``most`` of its key in its calendar minute."""
    w = Window.partitionBy(key, F.date_trunc("minute", F.col(ts))).orderBy(ts, order)
    return events.withColumn("allowed", F.row_number().over(w) <= most)


# Where a normalised question-answering record comes from.
MARK = "\n\nQuestion:"


def normal_record(rows: DataFrame, dataset: Column) -> DataFrame:
    """Raw question-answering rows (_id, input, context, answers, length, language) in the common form."""
    context, text = F.coalesce("context", F.lit("")), F.coalesce("input", F.lit(""))
    in_context, in_input = F.contains(context, F.lit(MARK)), F.contains(text, F.lit("\nQuestion:"))
    cut = lambda c, m: F.split(c, m, 2)
    plain = lambda c, what: F.replace(c, F.lit(what), F.lit(""))
    body = F.when(in_context, plain(cut(context, MARK)[0], "Context: ")).when(in_input, plain(cut(text, "\nQuestion:")[0], "Context: ")).otherwise(context)
    asked = F.when(in_context, F.substring_index(plain(cut(context, MARK)[1], "Question: "), "\n\nAnswer:", 1)).when(in_input, cut(text, "\nQuestion:")[1]).otherwise(F.when(context == "", text).otherwise(F.replace(text, context, F.lit(""))))
    return rows.select(
        F.concat(dataset, F.lit("_"), F.coalesce(F.col("_id"), F.lit(""))).alias("id"),
        dataset.alias("task"),
        F.lit("LongBench").alias("dataset"),
        text.alias("input"),
        body.alias("context"),
        F.regexp_replace(asked, r"^[\s ]+|[\s ]+$", "").alias("question"),
        F.coalesce(F.get("answers", F.lit(0)), F.lit("[]")).alias("answer"),
        F.coalesce("length", F.lit(0)).alias("length"),
        F.coalesce("language", F.lit("en")).alias("language"),
    )


def usable_questions(rows: DataFrame) -> DataFrame:
    return rows.filter((F.length(F.trim("question")) >= 10) & F.length(F.trim("answer")).between(1, 100) & (F.col("length") >= 500))


def first_rows(rows: DataFrame, line: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of a line number: a top-n of each task, then of these."""
    return rows.orderBy(line).limit(n)


def with_question(rows: DataFrame, question: str = "question", context: str | None = "context") -> DataFrame:
    """Rows that ask something about something: null, empty and blank questions go, and, where the table has that column,
    rows without a context (null or empty)."""
    rows = rows.filter(F.trim(F.coalesce(F.col(question), F.lit(""))) != "")
    return rows.filter(F.coalesce(F.col(context), F.lit("")) != "") if context in rows.columns else rows


def known_configurations(rows: DataFrame, known: list[str], config: str = "config") -> DataFrame:
    """``rows``, unless one names a configuration that is not ``known``; the error lists up to ten of these."""
    other = [r[0] for r in rows.filter(~F.coalesce(F.col(config).isin(known), F.lit(False))).select(config).distinct().limit(10).collect()]
    if other:
        raise ValueError(f"unknown configurations: {sorted(map(str, other))}")
    return rows
