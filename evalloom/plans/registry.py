"""Registered queries on the driver's tables, each with its SQL twin where SQL can express it.

Stand-ins: a document is a case, its label the judge's verdict, an event a run-log row (configuration = event_type, latency =
value), a part a point of cost and quality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions import prompts, redaction, routing, scores, text
from evalloom.operators import alignment, chunking, logs, models, pareto, redacting, retrieval, sampling, stats, stopping, windows
from evalloom.plans import tracks
from evalloom.session import new_path, numbered
from evalloom.sources import documents as scans
from evalloom.sources import collections, ordered, sinks, versioned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their verdicts; only the columns used are read."""
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    return d.join(v, "doc_id").withColumns({"judge_verdict": verdict, "judge_correct": F.when(F.col("toxic") == 1, None).otherwise(F.col("quality") == 1)})


WORDS_SQL = r"len(regexp_extract_all(text, '[^ \t\n\r\f\v ]+'))"
JUDGED_SQL = "SELECT *, CASE WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM documents JOIN labels USING (doc_id)"
ACCURACY_SQL = """count(*) AS n_records, count(*) AS n_judged, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'ambiguous') AS ambiguous"""


@query("SELECT event_type AS config, count(*) AS n_cases, round(avg(coalesce(value, 0)), 1) AS avg_latency_ms FROM events GROUP BY 1")
def eval_summary_by_config(spark, sf):  # noqa: ANN001, ANN201
    rows = table(spark, sf, "events").select(F.col("event_type").alias("config"), F.col("value").alias("latency_ms"))
    return stats.config_summary(rows, ["config"], {"latency_ms": 1})


@query("SELECT lang, count(*) AS n, round(coalesce(avg(CASE WHEN toxic = 1 THEN quality END), 0), 4) AS refusal_accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def conditional_refusal_mean(spark, sf):  # noqa: ANN001, ANN201
    return judged(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.round(stats.mean_where(F.col("quality").cast("double"), F.col("toxic") == 1), 4).alias("refusal_accuracy"))


@query(
    f"""WITH s AS (SELECT source, {ACCURACY_SQL} FROM ({JUDGED_SQL}) GROUP BY 1)
    SELECT *, round(correct / nullif(n_judged, 0), 4) AS acc_inclusive, round(correct / nullif(correct + incorrect, 0), 4) AS accuracy_excl_ambig, round(ambiguous / nullif(n_judged, 0), 4) AS rejection_rate,
    round(correct / nullif(correct + incorrect, 0) * (1 - ambiguous / nullif(n_judged, 0)), 4) AS composite FROM s"""
)
def verdict_accuracy(spark, sf):  # noqa: ANN001, ANN201
    return stats.verdict_summary(judged(spark, sf), ["source"])


@query("SELECT source, " + ", ".join(f"round(avg(quality) FILTER (lang = '{x}'), 4) AS {x}" for x in ("en", "fr", "de", "es")) + " FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def per_task_accuracy_pivot(spark, sf):  # noqa: ANN001, ANN201
    return stats.per_task(judged(spark, sf), "source", "lang", "quality", ["en", "fr", "de", "es"])


def _latency(kind: str, p95: str) -> None:
    sql = f"""WITH v AS (SELECT event_type AS config, list_sort(list(value)) AS v, avg(value) AS m, median(value) AS d, quantile_cont(value, 0.95) AS q FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT config, len(v) AS n, round(m, 1) AS mean, round(d, 1) AS median, round(v[1], 1) AS min, round(v[len(v)], 1) AS max, round({p95}, 1) AS p95 FROM v"""
    query(sql, f"latency_stats_p95_{kind}")(lambda spark, sf: stats.latency_stats(table(spark, sf, "events").withColumnRenamed("event_type", "config"), ["config"], "value", kind))


_latency("floor", "v[least(len(v), CAST(floor(0.95 * len(v)) AS BIGINT) + 1)]")
_latency("floor_minus1", "v[greatest(1, CAST(floor(0.95 * len(v)) AS BIGINT))]")
_latency("linear", "q")


@query(
    f"""WITH t AS (SELECT source, sum(n_chars // 4)::BIGINT AS origin_tokens, sum({WORDS_SQL})::BIGINT AS input_tokens FROM documents GROUP BY 1)
    SELECT *, round(100 * (1 - input_tokens / origin_tokens), 2) AS pct_saved_vs_origin, round(100 * (1 - input_tokens / (SELECT input_tokens FROM t WHERE source = 'src0')), 2) AS pct_saved_vs_baseline FROM t"""
)
def token_savings_vs_baseline(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select("source", F.floor(F.col("n_chars") / 4).alias("origin"), text.blank_separated("text").alias("used"))
    return stats.token_savings(d, "source", "origin", "used", "src0")


@query("SELECT source, round(coalesce(avg(CASE WHEN quality > 0 THEN quality END), 0), 4) AS avg_f1, round(avg(n_chars), 1) AS avg_latency_ms FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 1")
def best_provider(spark, sf):  # noqa: ANN001, ANN201
    return stats.best_provider(judged(spark, sf).withColumn("f1", F.col("quality").cast("double")), "source", "f1", "n_chars")


@query("SELECT event_type AS config, floor(median(value // 1))::BIGINT AS median, max(value) AS max, list_sort(list(value))[greatest(1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def token_stats_by_config(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").filter("value is not null").select(F.col("event_type").alias("config"), "value")
    return stats.token_stats(e, ["config"], "value")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def dedup_keep_latest(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return logs.keep_latest(e, ["user_id", "event_type"], "ts", "event_id").select("event_type", "user_id", "event_id")


@query("SELECT count(*) AS n_input, count(DISTINCT (user_id, event_type)) AS n_kept, count(*) - count(DISTINCT (user_id, event_type)) AS n_dropped FROM events")
def dedup_report(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    kept = logs.keep_latest(e, ["user_id", "event_type"], "ts", "event_id")
    return logs.dedup_report(e, kept, "user_id", "events").select("n_input", "n_kept", "n_dropped")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo_antijoin(spark, sf):  # noqa: ANN001, ANN201
    return logs.todo(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, source, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def update_in_place(spark, sf):  # noqa: ANN001, ANN201
    old = table(spark, sf, "documents").select("doc_id", "source", F.lit(-1).alias("quality"))
    return logs.update_rows(old, judged(spark, sf).select("doc_id", "source", "quality"), ["doc_id"])


@query(
    """WITH f AS (SELECT *, event_id % 3 < 2 AS early FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k, max(ts) FILTER (early) OVER (PARTITION BY user_id, event_type) AS first_ts FROM f)
    SELECT user_id, event_type, event_id, first_ts FROM k WHERE k = 1"""
)
def versioned_upsert(spark, sf):  # noqa: ANN001, ANN201
    """Two thirds of the events, then the rest, upserted into a versioned table; beside each latest row its time one version before."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    log = versioned.VersionedTable(spark, new_path(spark, "latest")).create(e.schema, ["user_id", "event_type"], "ts", buckets=16)
    first = log.upsert(e.filter(F.col("event_id") % 3 < 2), order="event_id")
    now = log.read(log.upsert(e.filter(F.col("event_id") % 3 == 2), order="event_id"))
    before = log.read(first).select("user_id", "event_type", F.col("ts").alias("first_ts"))
    return now.join(before, ["user_id", "event_type"], "left").select("user_id", "event_type", "event_id", "first_ts")


@query(
    """WITH b AS (SELECT lang, list_sort(list(coalesce(n_chars, 0))) AS v FROM documents GROUP BY 1),
    s AS (SELECT d.doc_id, d.lang, CASE WHEN n_chars <= v[len(v) // 4 + 1] THEN 0 WHEN n_chars <= v[len(v) // 2 + 1] THEN 1 WHEN n_chars <= v[3 * len(v) // 4 + 1] THEN 2 ELSE 3 END AS stratum_idx FROM documents d JOIN b USING (lang)),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang, stratum_idx ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) AS k FROM s),
    r AS (SELECT *, sum((k <= 7)::INT) OVER (PARTITION BY lang) AS taken, row_number() OVER (PARTITION BY lang, k <= 7 ORDER BY md5(doc_id::VARCHAR || '-43'), doc_id) AS r FROM k)
    SELECT doc_id, lang, stratum_idx FROM r WHERE k <= 7 OR r <= 28 - taken"""
)
def stratified_sample(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.stratified(d, ["lang"], "n_chars", "doc_id", sampling.quotas(200, 7)).select("doc_id", "lang", "stratum_idx")


@query("SELECT doc_id, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'dev' ELSE 'held_out' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || '-42'), 1, 8))::BIGINT % 100 AS p FROM documents)")
def hash_split(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "documents").select("doc_id", sampling.split_of(F.col("doc_id"), {"train": 70, "dev": 15, "held_out": 15}).alias("split"))


@query("SELECT doc_id, config, redact, variant, tier FROM labels CROSS JOIN (VALUES ('A', false, 'A', 'cheap'), ('B', false, 'B', 'cheap'), ('D', true, 'A', 'cheap'), ('B+D', true, 'B', 'cheap'), ('D-strong', true, 'A', 'strong')) c(config, redact, variant, tier)")
def case_config_cross(spark, sf):  # noqa: ANN001, ANN201
    return logs.across_configs(table(spark, sf, "labels").select("doc_id"), tracks.extract_configs(spark))


FRONTIER_SQL = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY round({x}, 6), round({y}, 6) ORDER BY {x}, {o}) AS k FROM {t} a WHERE NOT EXISTS (SELECT 1 FROM {t} b WHERE b.{x} <= a.{x} AND b.{y} >= a.{y} AND (b.{x} < a.{x} OR b.{y} > a.{y}))) WHERE k = 1"


@query(FRONTIER_SQL.format(c="p_partkey, p_retailprice, p_size", x="p_retailprice", y="p_size", o="p_partkey", t="part"))
def pareto_frontier(spark, sf):  # noqa: ANN001, ANN201
    return pareto.frontier(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size", "p_partkey")


SOURCE_POINTS_SQL = f"SELECT source, round(avg({WORDS_SQL} / 1e6 * 0.075), 8) AS avg_cost_usd, round(count(*) FILTER (verdict = 'correct') / nullif(count(*) FILTER (verdict <> 'ambiguous'), 0), 4) AS accuracy FROM ({JUDGED_SQL}) GROUP BY 1"


@query("WITH p AS (" + SOURCE_POINTS_SQL + ") " + FRONTIER_SQL.format(c="source, avg_cost_usd, accuracy", x="avg_cost_usd", y="accuracy", o="source", t="p"))
def pareto_by_source(spark, sf):  # noqa: ANN001, ANN201
    points = source_points(spark, sf)
    return pareto.frontier(points.filter("accuracy is not null"), "avg_cost_usd", "accuracy", "source")


def source_points(spark, sf):  # noqa: ANN001, ANN201
    j = judged(spark, sf)
    cost = F.avg(text.blank_separated("text") / 1e6 * 0.075)
    return j.groupBy("source").agg(F.round(cost, 8).alias("avg_cost_usd"), F.round(F.try_divide(F.count_if("judge_correct"), F.count("judge_correct")), 4).alias("accuracy"))


@query("SELECT doc_id, round(2 * (n_chars // 8) / 1e6 * 0.075 + (n_chars // 40) / 1e6 * 0.30, 8) AS cost_usd FROM documents")
def llm_cost_model(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents")
    return d.select("doc_id", models.cost(F.lit("gemini-3.5-flash-lite"), 2 * F.floor(F.col("n_chars") / 8), F.floor(F.col("n_chars") / 40)).alias("cost_usd"))


@query(
    f"""WITH c AS (SELECT source, round(avg((n_chars // 4) / 1e6 * 0.075), 8) AS avg_cost FROM documents GROUP BY 1), l AS (SELECT 'src' || (user_id % 20) AS source, round(median(value), 1) AS median_ms FROM events GROUP BY 1),
    a AS (SELECT source, round(count(*) FILTER (verdict = 'correct') / count(*), 4) AS acc_inclusive FROM ({JUDGED_SQL}) GROUP BY 1) SELECT source, avg_cost, median_ms, acc_inclusive FROM c JOIN l USING (source) JOIN a USING (source)"""
)
def tradeoff_table(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "documents").groupBy("source").agg(F.round(F.avg(F.floor(F.col("n_chars") / 4) / 1e6 * 0.075), 8).alias("avg_cost"))
    e = table(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), "value")
    e = stats.medians(e, ["source"], "value", "median_ms", 1)
    a = stats.verdict_summary(judged(spark, sf), ["source"]).select("source", "acc_inclusive")
    return stats.tradeoff(c, e, a, "source")


@query(
    """WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n_rows, coalesce(max(l_linenumber), 0) AS n_cols, count(l_orderkey) * 4 AS n_fields FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    t AS (SELECT o_orderkey, CASE WHEN n_rows = 0 AND n_fields <= 10 THEN 'cheap' WHEN n_fields <= 30 AND NOT (n_rows > 10 OR n_cols > 6) THEN 'mid' ELSE 'strong' END AS tier FROM c)
    SELECT o_orderkey, tier, 'T1-R' || CASE tier WHEN 'cheap' THEN '1' WHEN 'mid' THEN '2' ELSE '3' END AS rule FROM t"""
)
def route_track1(spark, sf):  # noqa: ANN001, ANN201
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.max("l_linenumber").alias("n_cols"))
    o = table(spark, sf, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["n_rows", "n_cols"])
    tier = routing.tier_extraction(F.col("n_rows") * 4, F.col("n_rows") > 0, F.col("n_rows"), F.col("n_cols"))
    return o.select("o_orderkey", tier.alias("tier"), routing.rule(tier, 1).alias("rule"))


@query(
    f"""WITH t AS (SELECT doc_id, {WORDS_SQL} AS est_tokens, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'điều khoản|khoản|mục|điều|section|clause|tion'))) >= 2 AS synth FROM documents)
    SELECT doc_id, est_tokens, CASE WHEN est_tokens < 2000 AND NOT synth THEN 'cheap' WHEN est_tokens < 8000 AND NOT synth THEN 'mid' ELSE 'strong' END AS tier FROM t"""
)
def route_track2(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents")
    synth = F.size(F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike("|".join((*routing.CLAUSE, "tion"))))) >= 2
    est = text.blank_separated("text")
    return d.select("doc_id", est.alias("est_tokens"), routing.tier_question(est, synth).alias("tier"))


@query(
    f"""WITH t AS (SELECT doc_id, 6 + {WORDS_SQL} AS est_tokens, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'điều khoản|khoản|mục|điều|section|clause'))) >= 2 AS synth FROM documents)
    SELECT doc_id, est_tokens, synth, CASE WHEN est_tokens < 2000 AND NOT synth THEN 'cheap' WHEN est_tokens < 8000 AND NOT synth THEN 'mid' ELSE 'strong' END AS tier FROM t"""
)
def route_by_features(spark, sf):  # noqa: ANN001, ANN201
    f = routing.features_question(F.lit("What does this document tell us?"), F.split("text", "\n"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(f)).alias("f")).select("doc_id", "f.*")
    synth = F.col("requires_multi_clause_synthesis")
    return d.select("doc_id", "est_tokens", synth.alias("synth"), routing.tier_question(F.col("est_tokens"), synth).alias("tier"))


@query("SELECT source, lang, round(avg(quality), 4) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def per_task_accuracy(spark, sf):  # noqa: ANN001, ANN201
    """The accuracy matrix in rows, for tasks that nobody has listed; rows without a task are one of their own."""
    return judged(spark, sf).groupBy("source", "lang").agg(F.round(F.avg(F.col("quality").cast("double")), 4).alias("accuracy"), F.count("*").alias("n"))


EMAIL_SQL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
EMAIL_ONLY = redaction.Policy(categories={"email": redaction.DEFAULT.categories["email"]})


@query(f"SELECT doc_id, substr(sha256(regexp_replace(text, '{EMAIL_SQL}', '[REDACTED:EMAIL]', 'g')), 1, 12) AS redacted_hash, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS n_email FROM documents")
def pii_email_redact(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(redaction.redact(F.col("text"), EMAIL_ONLY, {"email": redaction.PATTERNS["email"]}))).alias("r"))
    return d.select("doc_id", text.hash_prefix("r.text").alias("redacted_hash"), F.col("r.total").alias("n_email"))


def _spans_sql() -> str:
    """(doc_id, x: [priority, start, end]) of all accepted spans: places from the texts between matches, overlaps by a fold."""
    quoted = [p.replace("(?iu)", "(?i)").replace("'", "''") for p in redaction.PATTERNS.values()]
    hits = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM d" for k, p in enumerate(quoted))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, k, unnest(range(1, len(h) + 1)) AS i, h, g FROM ({hits}) WHERE len(h) > 0),
    s AS (SELECT doc_id, k, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS st, length(h[i]) AS n FROM m),
    o AS (SELECT doc_id, list([k, st, st + n] ORDER BY -n, st, k) AS v FROM s GROUP BY 1),
    a AS (SELECT doc_id, unnest(list_reduce(list_transform(v, lambda x: [x]), lambda a, s: CASE WHEN len(list_filter(a, lambda x: s[1][3] > x[2] AND s[1][2] < x[3])) > 0 THEN a ELSE a || s END)) AS x FROM o)"""


TYPE_SQL = "CASE k " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(redaction.PATTERNS)) + " END"


def pii_spans(spark, sf):  # noqa: ANN001, ANN201
    return redacting.redact_texts(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.explode("redacted.spans").alias("s"))


@query(_spans_sql() + f" SELECT {TYPE_SQL.replace('CASE k', 'CASE x[1]')} AS type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM a WHERE x[1] <> 7 GROUP BY 1")
def pii_span_counts(spark, sf):  # noqa: ANN001, ANN201
    return pii_spans(spark, sf).filter("s.action <> 'keep_token'").groupBy(F.col("s.type").alias("type")).agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


@query(_spans_sql() + f", p AS (SELECT a.doc_id, {TYPE_SQL.replace('CASE k', 'CASE x[1]')} AS type, x[2] AS span_start, x[3] AS span_end, substr(sha256(substr(t, (x[2] + 1)::INT, (x[3] - x[2])::INT)), 1, 12) AS original_hash FROM a JOIN d USING (doc_id)) SELECT * FROM p")
def pii_spans_all(spark, sf):  # noqa: ANN001, ANN201
    return pii_spans(spark, sf).select("doc_id", "s.type", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"), "s.original_hash")


@query(f"SELECT doc_id, sum(strlen(x)) AS email_bytes, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) AS x FROM documents) GROUP BY 1")
def pii_spans_positions(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select("doc_id", F.explode(redaction.spans(F.col("text"), EMAIL_ONLY, {"email": redaction.PATTERNS["email"]})).alias("s"))
    return d.groupBy("doc_id").agg(F.sum(F.col("s.end") - F.col("s.start")).alias("email_bytes"), F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT lang, source, list_distinct(list(CASE WHEN quality = 1 THEN 'email' ELSE 'vin' END)) AS pred, list_distinct(list(CASE WHEN toxic = 1 THEN 'vin' ELSE 'email' END)) AS ref FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
    c AS (SELECT lang, source, len(list_filter(pred, lambda x: list_contains(ref, x))) AS tp, len(pred) AS p, len(ref) AS r FROM p), s AS (SELECT lang, source, tp / greatest(1, p) AS pr, tp / greatest(1, r) AS re FROM c)
    SELECT lang, source, round(pr, 4) AS pii_precision, round(re, 4) AS pii_recall, round(2 * pr * re / greatest(pr + re, 1e-9), 4) AS pii_f1 FROM s"""
)
def pii_type_prf(spark, sf):  # noqa: ANN001, ANN201
    g = judged(spark, sf).groupBy("lang", "source").agg(F.collect_set(F.when(F.col("quality") == 1, "email").otherwise("vin")).alias("p"), F.collect_set(F.when(F.col("toxic") == 1, "vin").otherwise("email")).alias("r"))
    return g.select("lang", "source", F.explode(F.array(scores.type_scores(F.col("p"), F.col("r")))).alias("s")).select("lang", "source", "s.*")


def turn_pairs(spark, sf):  # noqa: ANN001, ANN201
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next")).filter("next is not null")


PAIRS_SQL = "SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations"


@query(f"SELECT conv_id, turn, CASE WHEN lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM ({PAIRS_SQL}) WHERE b IS NOT NULL")
def exact_match(spark, sf):  # noqa: ANN001, ANN201
    return turn_pairs(spark, sf).select("conv_id", "turn", scores.exact_match(F.col("text"), F.col("next")).alias("exact_match"))


def _token_f1_sql(cased: bool) -> str:
    t = lambda x: f"regexp_extract_all({x if cased else f'lower({x})'}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"
    return f"""WITH p AS (SELECT conv_id, turn, {t('a')} AS ta, {t('b')} AS tb FROM ({PAIRS_SQL}) WHERE b IS NOT NULL),
    x AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(ta) AS w FROM p) GROUP BY ALL), y AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(tb) AS w FROM p) GROUP BY ALL),
    c AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS same FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL),
    s AS (SELECT conv_id, turn, coalesce(same, 0) / greatest(1, len(ta)) AS p, coalesce(same, 0) / greatest(1, len(tb)) AS r, len(ta) AS na, len(tb) AS nb FROM p LEFT JOIN c USING (conv_id, turn))
    SELECT conv_id, turn, CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE round(2 * p * r / greatest(p + r, 1e-9), 3) END::DOUBLE AS token_f1 FROM s"""


def _token_f1(cased: bool):  # noqa: ANN202
    # three places, half up: half-even rounding of four places may differ from SQL's in a tie
    return lambda spark, sf: turn_pairs(spark, sf).select("conv_id", "turn", scores.token_f1(F.col("text"), F.col("next"), cased, 3, F.round)["token_f1"].alias("token_f1"))


query(_token_f1_sql(False), "token_f1")(_token_f1(False))
query(_token_f1_sql(True), "text_f1_cased")(_token_f1(True))

ASCII_SQL = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"


@query(f"SELECT item_id, round(levenshtein(a, b) / length(b), 6) AS cer FROM (SELECT item_id, {ASCII_SQL} AS a, lead({ASCII_SQL}) OVER (ORDER BY item_id) AS b FROM benchmark) WHERE length(a) > 0 AND length(b) > 0")
def cer_ascii(spark, sf):  # noqa: ANN001, ANN201
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("a"))
    # the next item is an equi-join of places, which have no gaps; no global window is needed
    b = numbered(b, F.col("item_id").asc_nulls_last())
    nxt = b.select((F.col("place") - 1).alias("place"), F.col("a").alias("b"))
    pairs = b.join(nxt, "place").filter("length(a) > 0 and length(b) > 0")
    return alignment.with_error_rates(pairs, "a", "b").select("item_id", F.round("cer", 6).alias("cer"))


PART_MAPS = "p_partkey, p_brand, p_type, p_size"


@query(
    """SELECT p_partkey, round(2 * p * r / greatest(p + r, 1e-9), 4) AS field_f1, n AS field_n_total FROM (SELECT p_partkey, hits / greatest(1, 3) AS p, hits / 4 AS r, 4 AS n FROM
    (SELECT p_partkey, 1 + (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT AS hits FROM part))"""
)
def field_f1(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part")
    ref = F.create_map(F.lit("key"), F.col("p_partkey").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    pred = F.create_map(F.lit("key"), F.col("p_partkey").cast("string"), F.lit("brand"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise("?"), F.lit("type"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_type"))).otherwise("?"))
    return p.select("p_partkey", F.explode(F.array(scores.field_f1(pred, ref))).alias("s")).select("p_partkey", "s.field_f1", "s.field_n_total")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS schema_conformance FROM part")
def schema_conformance(spark, sf):  # noqa: ANN001, ANN201
    keys = lambda *names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit("x")] * len(names)))
    pred = F.when(F.col("p_partkey") % 2 == 0, keys("key", "brand", "type", "other")).otherwise(keys("key", "other"))
    return table(spark, sf, "part").select("p_partkey", scores.schema_conformance(pred, keys("key", "brand", "type", "size"))["schema_conformance"].alias("schema_conformance"))


@query("SELECT doc_id, CASE WHEN (quality = 0) = (toxic = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS refusal_accuracy FROM labels")
def refusal_accuracy(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "labels").select("doc_id", scores.refusal_accuracy(F.col("quality") == 0, F.col("toxic") == 1).alias("refusal_accuracy"))


TOP_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label FROM embeddings WHERE vec_id % 20 = 0), i AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    d AS (SELECT query_id, item_id, list_sum(list_transform(list_zip(v, qv), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS distance FROM q JOIN i ON {on}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM d) """


def search(spark, sf, same=None, k=8):  # noqa: ANN001, ANN201
    e = table(spark, sf, "embeddings")
    more = ["label"] if same else []
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), *more)
    stored = collections.Collection.write(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), *more), new_path(spark, "collection"))
    return stored.nearest(q, k, same=same)[0]


@query(TOP_SQL.format(on="true") + "SELECT query_id, item_id, round(distance, 5) AS distance, rank FROM r WHERE rank <= 8")
def vector_topk(spark, sf):  # noqa: ANN001, ANN201
    return search(spark, sf).select("query_id", "item_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(TOP_SQL.format(on="q.label = i.label") + "SELECT query_id, item_id, round(distance, 5) AS distance, rank FROM r WHERE rank <= 8")
def vector_topk_filtered(spark, sf):  # noqa: ANN001, ANN201
    return search(spark, sf, "label").select("query_id", "item_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(TOP_SQL.format(on="true") + "SELECT query_id, round(count(*) FILTER (item_id % 2 = 0) / 8, 4) AS citation_precision FROM r WHERE rank <= 8 GROUP BY 1")
def citation_precision(spark, sf):  # noqa: ANN001, ANN201
    g = search(spark, sf).groupBy("query_id").agg(F.collect_list(F.col("item_id").cast("string")).alias("cites"), F.collect_list(F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string"))).alias("valid"))
    return g.select("query_id", scores.citation_precision(F.col("cites"), F.col("valid"))["citation_precision"].alias("citation_precision"))


@query("SELECT doc_id::VARCHAR AS case_id, ordinal::INT AS ordinal, printf('%s-c%03d', doc_id::VARCHAR, ordinal) AS chunk_id, substr(text, ordinal * 360 + 1, 400) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 40) / 360)::BIGINT))) AS ordinal FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark, sf):  # noqa: ANN001, ANN201
    return chunking.chunk_fixed(table(spark, sf, "documents"), "doc_id", "text")


@query()
def chunk_recursive(spark, sf):  # noqa: ANN001, ANN201
    return chunking.chunk_documents(table(spark, sf, "documents"), "doc_id", "text")


@query()
def pseudo_embed(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "benchmark").select("item_id", retrieval.pseudo_embedding(F.col("text")).alias("vec"))


W_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(
    f"""WITH c AS (SELECT conv_id, turn, {W_SQL} AS w FROM conversations), q AS (SELECT conv_id, unnest(w) AS t FROM c WHERE turn = 0), i AS (SELECT conv_id, turn, w, len(w) AS dl FROM c WHERE turn > 0),
    z AS (SELECT conv_id, count(*) AS n, avg(dl) AS m FROM i GROUP BY 1), tf AS (SELECT conv_id, turn, t, count(*) AS tf FROM (SELECT conv_id, turn, unnest(w) AS t FROM i) GROUP BY ALL), df AS (SELECT conv_id, t, count(*) AS df FROM tf GROUP BY ALL),
    f AS (SELECT conv_id, t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN z USING (conv_id)), g AS (SELECT conv_id, avg(idf) AS mi FROM f GROUP BY 1), h AS (SELECT conv_id, t, CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END AS idf FROM f JOIN g USING (conv_id)),
    s AS (SELECT conv_id, turn, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))) AS score FROM q JOIN tf USING (conv_id, t) JOIN h USING (conv_id, t) JOIN i USING (conv_id, turn) JOIN z USING (conv_id) GROUP BY ALL)
    SELECT conv_id, turn, round(coalesce(score, 0), 4) AS score FROM i LEFT JOIN s USING (conv_id, turn)"""
)
def bm25_rerank(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "conversations")
    q = c.filter("turn = 0").select("conv_id", F.col("text").alias("question"))
    pairs = q.join(c.filter("turn > 0").select("conv_id", "turn", "text"), "conv_id")
    return retrieval.bm25(pairs.withColumn("prior", F.col("turn")), "conv_id", "question", "turn", "text", "prior").select("conv_id", "turn", F.round("score", 4).alias("score"))


SENTENCES_SQL = r"""s AS (SELECT doc_id, unnest(x) AS sentence, unnest(range(len(x))) AS no FROM (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS x FROM documents)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), w AS (SELECT doc_id, no, t, count(*) AS tf FROM (SELECT doc_id, no, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')) AS t FROM s) GROUP BY ALL),
    f AS (SELECT doc_id, t, ln((1 + any_value(n)) / (1 + count(*))) AS idf FROM w JOIN n USING (doc_id) GROUP BY ALL), c AS (SELECT doc_id, no, sum(tf * idf) / sum(tf) AS score FROM w JOIN f USING (doc_id, t) GROUP BY ALL),
    r AS (SELECT doc_id, no, sentence, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(score, 0), 9) DESC, no) AS rank FROM s LEFT JOIN c USING (doc_id, no))"""


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, no::INT AS sentence_no, sentence, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def tfidf_preselect(spark, sf):  # noqa: ANN001, ANN201
    return retrieval.tfidf_sentences(table(spark, sf, "documents"), "doc_id", "text", 10)


@query("SELECT conv_id, sha256('CONTEXT (reference document):' || chr(10) || coalesce(b, '') || chr(10) || chr(10) || 'QUESTION:' || chr(10) || a || chr(10) || chr(10) || 'Answer concisely and accurately based on the context. If the answer is not present in the context, reply ''Unknown''.') AS prompt_hash FROM (" + PAIRS_SQL + ") WHERE turn = 0")
def prompt_build(spark, sf):  # noqa: ANN001, ANN201
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next")).filter("turn = 0")
    return c.select("conv_id", F.sha2(prompts.evaluation(F.col("next"), F.col("text")), 256).alias("prompt_hash"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def props_json_extract(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, trim(props) AS body FROM events")
def fence_strip(spark, sf):  # noqa: ANN001, ANN201
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("  "), F.col("props"), F.lit("\n")))
    return table(spark, sf, "events").select("event_id", text.without_fence(fenced).alias("body"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last_ts, -(arg_max(-event_id, (ts, -event_id))) AS last_event FROM events GROUP BY 1")
def audit_latest_by_case(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", -F.col("event_id"))).alias("last_event"))


@query(
    """WITH r AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'track1' ELSE 'track2' END AS track, event_type AS config, value, event_id, user_id FROM events), f AS (SELECT track, arg_min(user_id, event_id) AS u FROM r GROUP BY 1)
    SELECT track, config, count(*) AS n, round(avg(coalesce(value, 0)), 1) AS avg_latency_ms, any_value('d' || u) AS deployment_id FROM r JOIN f USING (track) GROUP BY 1, 2"""
)
def inspect_case(spark, sf):  # noqa: ANN001, ANN201
    track = F.when(F.col("event_type").isin("click", "view"), "track1").otherwise("track2")
    rows = table(spark, sf, "events").select(track.alias("track"), F.col("event_type").alias("config"), F.lit(0.0).alias("cost_usd"), F.col("value").alias("latency_ms"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("deployment_id"), "event_id")
    return stats.inspect(rows, "event_id").select("track", "config", "n", "avg_latency_ms", "deployment_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def rate_limit_fixed_window(spark, sf):  # noqa: ANN001, ANN201
    return logs.rate_limited(table(spark, sf, "events"), "user_id", "ts", "event_id", 1).select("event_id", "allowed")


@query(
    """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS start FROM events GROUP BY 1 UNION ALL SELECT user_id, start FROM (SELECT a.user_id, min(e.ts) AS start FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.start + INTERVAL 3600 SECOND GROUP BY 1)),
    w AS (SELECT e.event_id, e.user_id, e.ts, max(a.start) AS start FROM events e JOIN a ON e.user_id = a.user_id AND a.start <= e.ts GROUP BY 1, 2, 3)
    SELECT event_id, epoch_us(start) AS window_us, row_number() OVER (PARTITION BY user_id, start ORDER BY ts, event_id) <= 1 AS allowed FROM w"""
)
def rate_limit_first_hit(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    limited = windows.rate_limited_from_first_hit(e, "user_id", "ts", "event_id", 1, seconds=3600)
    return limited.select("event_id", F.unix_micros("window_start").alias("window_us"), "allowed")


@query(
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day DESC, place) AS k FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM p))
    SELECT event_id, place FROM k WHERE k = 1"""
)
def log_file_order(spark, sf):  # noqa: ANN001, ANN201
    """Events written as a JSONL log and read back: the latest day's row of each user and type, ties by the earlier line."""
    path = new_path(spark, "log")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    sinks.overwrite_ordered(e, path, "event_id")
    rows = ordered.ordered_jsonl(spark, path, "event_id long, user_id long, event_type string, day string", "fail")
    return logs.keep_latest(rows, ["user_id", "event_type"], "day", "place").select("event_id", "place")


@query("SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def ts_range(spark, sf):  # noqa: ANN001, ANN201
    return stats.time_range(table(spark, sf, "events"), ["event_type"], "ts")


@query("SELECT lang, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / greatest(1, sum(tp) + sum(fp)), 4) AS precision, round(sum(tp) / greatest(1, sum(tp) + sum(fn)), 4) AS recall FROM (SELECT lang, (quality = 1 AND toxic = 0)::INT AS tp, (quality = 1 AND toxic = 1)::INT AS fp, (quality = 0 AND toxic = 0)::INT AS fn FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def micro_prf(spark, sf):  # noqa: ANN001, ANN201
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    rows = judged(spark, sf).select("lang", (q & ~t).cast("int").alias("tp"), (q & t).cast("int").alias("fp"), (~q & ~t).cast("int").alias("fn"))
    return stats.micro_scores(rows, ["lang"]).drop("f1")


@query("SELECT source, count(*) AS n_cases, count(*) FILTER (quality = 1) AS n_valid, round(coalesce(sum(n_chars) FILTER (quality = 1), 0) / greatest(1, count(*) FILTER (quality = 1)), 2) AS avg_blocks FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def provider_summary(spark, sf):  # noqa: ANN001, ANN201
    rows = judged(spark, sf).select("source", F.col("n_chars").cast("double").alias("blocks"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("ms"), F.when(F.col("quality") == 0, "bad").alias("error"))
    return stats.provider_summary(rows, "source", "blocks", "confidence", "ms", "error").select("source", "n_cases", "n_valid", "avg_blocks")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def task_counts(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT source, round(median(n_chars / nullif(n_words, 0)), 4) AS median_ratio, round(min(n_chars / nullif(n_words, 0)), 4) AS min_ratio, round(max(n_chars / nullif(n_words, 0)), 4) AS max_ratio FROM (SELECT source, n_chars, " + WORDS_SQL + " AS n_words FROM documents) GROUP BY 1")
def compression_ratio(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select("source", (F.col("n_chars") / F.nullif(text.blank_separated("text"), F.lit(0))).alias("r"))
    return stats.ratio_stats(d, ["source"], "r")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS judge_verdict, CASE WHEN toxic = 1 THEN NULL ELSE coalesce(quality = 1, false) END AS judge_correct, least(doc_id % 3, 1)::DOUBLE AS judge_confidence, 'r' AS judge_reason FROM labels")
def judge_parse(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "labels")
    verdict = F.when(F.col("toxic") == 1, "Ambiguous").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    reply = F.concat(F.lit('noise {"verdict": "'), verdict, F.lit('", "confidence": "'), (F.col("doc_id") % 3).cast("string"), F.lit('", "reason": "r"} x'))
    return models.parse_verdicts(d.select("doc_id", reply.alias("reply")), "reply").drop("reply")


@query()
def table_teds(spark, sf):  # noqa: ANN001, ANN201
    return models.table_teds(turn_pairs(spark, sf).select("conv_id", "turn", F.split("text", " ").alias("a"), F.split("next", " ").alias("b")), "a", "b").select("conv_id", "turn", "teds.*")


STOP_RUNS_SQL = "SELECT l_orderkey AS case_id, l_linenumber::VARCHAR AS config, l_discount::DOUBLE AS quality, l_extendedprice::DOUBLE AS cost, l_quantity::DOUBLE AS latency_ms, CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS refusal_ok FROM lineitem"


def _stop_sql(steps: int = 8, rounds: int = 200, seed: int = 7) -> str:
    first = lambda key, salt: f"((({key}) % {stopping.PRIME} * 48271 + ({salt}) * 69621 + 12345) % {stopping.PRIME})"
    batch = " + ".join(f"(lot >= {stopping.PRIME >> j})::INT" for j in range(1, steps))
    weight = " + ".join(f"(u > {e * stopping.PRIME!r})::INT" for e in stopping.POISSON)
    return f"""WITH r AS ({STOP_RUNS_SQL}), t AS (SELECT config, row_number() OVER (ORDER BY round(avg(quality), 9) DESC, round(avg(cost), 9), config) AS k FROM r GROUP BY 1),
    d AS (SELECT case_id, max(quality) FILTER (k = 1) - max(quality) FILTER (k = 2) AS quality, max(cost) FILTER (k = 1) - max(cost) FILTER (k = 2) AS cost FROM r JOIN t USING (config) WHERE k <= 2 GROUP BY 1),
    a AS (SELECT *, {first('case_id', str(seed))} AS x FROM d WHERE quality IS NOT NULL AND cost IS NOT NULL), a2 AS (SELECT *, (x * x + {seed}) % {stopping.PRIME} AS y FROM a), a3 AS (SELECT *, (y * y + case_id % {stopping.PRIME}) % {stopping.PRIME} AS lot FROM a2),
    g AS (SELECT case_id, quality, cost, {batch} AS step FROM a3), b AS (SELECT *, unnest(range(-1, {rounds})) AS b FROM g),
    u1 AS (SELECT *, {first('case_id + 1', f'b + {seed * 1000}')} AS x FROM b), u2 AS (SELECT *, (x * x + b + {seed * 1000}) % {stopping.PRIME} AS y FROM u1), u3 AS (SELECT *, (y * y + (case_id + 1) % {stopping.PRIME}) % {stopping.PRIME} AS u FROM u2),
    w AS (SELECT *, CASE WHEN b < 0 THEN 1 ELSE {weight} END AS w FROM u3), s AS (SELECT step, b, sum((b < 0)::INT) AS n, sum(quality * w) AS q, sum(cost * w) AS c, sum(w) AS w FROM w GROUP BY 1, 2),
    e AS (SELECT st.step, ro.b FROM range({steps}) st(step), range(-1, {rounds}) ro(b)), z AS (SELECT step, b, sum(n) OVER o AS n, sum(q) OVER o / nullif(sum(w) OVER o, 0) AS quality, sum(c) OVER o / nullif(sum(w) OVER o, 0) AS cost FROM e LEFT JOIN s USING (step, b) WINDOW o AS (PARTITION BY b ORDER BY step)),
    v AS (UNPIVOT z ON quality, cost INTO NAME delta VALUE m), i AS (SELECT delta, step, max(n) FILTER (b < 0) AS n, max(m) FILTER (b < 0) AS mean, quantile_cont(m, 0.025) FILTER (b >= 0) AS lo, quantile_cont(m, 0.975) FILTER (b >= 0) AS hi FROM v GROUP BY 1, 2),
    f AS (SELECT delta, first(struct_pack(met := ap, mean := mean, n := n) ORDER BY NOT ap, CASE WHEN ap THEN step ELSE -step END) AS f FROM (SELECT *, coalesce(n >= 2 AND (lo > 0 OR hi < 0), false) AS ap FROM i) GROUP BY 1),
    ap AS (SELECT bool_and(f.met) AS met, max(f.mean) FILTER (delta = 'quality') AS value, max(f.n) AS n FROM f),
    p AS (SELECT quantile_cont(latency_ms, 0.95) AS p FROM r WHERE config = '1'), sl AS (SELECT count(*) FILTER (latency_ms > 2 * p) / count(*) AS value, count(*) AS n FROM r JOIN t USING (config), p WHERE k = 1),
    ri AS (SELECT avg(refusal_ok::INT) AS value, count(refusal_ok) AS n FROM r), fu AS (SELECT count(*) FILTER (own = al) AS value, sum(own) AS n FROM (SELECT config, count(DISTINCT case_id) AS own FROM r GROUP BY 1), (SELECT count(DISTINCT case_id) AS al FROM r)),
    o AS (SELECT 'S1' AS rule, NOT met AS met, value, n FROM ap UNION ALL SELECT 'C1', met, value, n FROM ap UNION ALL SELECT 'S2', value >= 0.1, value, n FROM sl UNION ALL SELECT 'C2', value < 0.1, value, n FROM sl
    UNION ALL SELECT 'S3', value < 0.85, value, n FROM ri UNION ALL SELECT 'C3', value >= 0.85, value, n FROM ri UNION ALL SELECT 'C4', value = 7, value, n FROM fu) SELECT rule, met, round(value, 6) AS value, n::BIGINT AS n FROM o"""


@query(_stop_sql())
def stop_rules(spark, sf):  # noqa: ANN001, ANN201
    """Orders as cases, their line numbers as seven configurations."""
    i = table(spark, sf, "lineitem")
    ok = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    runs = i.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("config"), F.col("l_discount").cast("double").alias("quality"), F.col("l_extendedprice").cast("double").alias("cost"), F.col("l_quantity").cast("double").alias("latency_ms"), ok.alias("refusal_ok"))
    return stopping.stop_rules(runs, [str(k) for k in range(1, 8)], "1").select("rule", "met", F.round("value", 6).alias("value"), "n")


@query()
def bootstrap_ci(spark, sf):  # noqa: ANN001, ANN201
    return stats.bootstrap_interval(table(spark, sf, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") - F.col("toxic")).alias("d")), "d")


@query(
    r"""WITH x AS (SELECT conv_id, turn, lower(trim(regexp_replace(a, '\s+', ' ', 'g'))) AS p, lower(trim(regexp_replace(b, '\s+', ' ', 'g'))) AS r, regexp_extract_all(lower(a), '{t}') AS ta, regexp_extract_all(lower(b), '{t}') AS tb FROM ({pairs}) WHERE b IS NOT NULL),
    y AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(ta), lambda w: least(len(list_filter(ta, lambda u: u = w)), len(list_filter(tb, lambda u: u = w))))), 0) AS same,
    list_transform(regexp_extract_all(p, '{n}'), lambda u: replace(u, ',', '')::DOUBLE) AS np, list_transform(regexp_extract_all(r, '{n}'), lambda u: replace(u, ',', '')::DOUBLE) AS nr FROM x)
    SELECT conv_id, turn, CASE WHEN p = '' OR r = '' THEN 'ambiguous' WHEN CASE WHEN regexp_full_match(r, '(yes|no)[.!]?') THEN ta[1] = tb[1] WHEN regexp_full_match(r, '{n}%?') THEN list_contains(np, nr[1])
    ELSE p = r OR contains(p, r) OR 4 * same >= len(ta) + len(tb) END THEN 'correct' ELSE 'incorrect' END AS verdict FROM y""".format(t=r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", n=models.NUMBER, pairs=PAIRS_SQL)
)
def heuristic_judge(spark, sf):  # noqa: ANN001, ANN201
    return turn_pairs(spark, sf).select("conv_id", "turn", models.heuristic_verdict(F.col("text"), F.col("next")).alias("verdict"))


@query(
    rf"""WITH {SENTENCES_SQL}, l AS (SELECT doc_id, rank, len(regexp_extract_all(sentence, '[^ \t\n\x0B\f\r]+')) AS words FROM r),
    b AS (SELECT doc_id, words, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(words) OVER (PARTITION BY doc_id) AS every FROM l)
    SELECT doc_id, any_value(every)::BIGINT AS origin_tokens, sum(words)::BIGINT AS compressed_tokens, round(any_value(every) / sum(words), 4) AS compress_ratio FROM b WHERE ahead < 0.5 * every GROUP BY 1"""
)
def compress_offline(spark, sf):  # noqa: ANN001, ANN201
    return models.compress_offline(table(spark, sf, "documents"), "doc_id", "text", 0.5).select("doc_id", "origin_tokens", "compressed_tokens", "compress_ratio")


@query("SELECT lang, count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'ambiguous') AS ambiguous, round(100 * count(*) FILTER (verdict = 'correct') / count(*), 2) AS pct_correct, round(100 * count(*) FILTER (verdict = 'incorrect') / count(*), 2) AS pct_incorrect, round(100 * count(*) FILTER (verdict = 'ambiguous') / count(*), 2) AS pct_ambiguous FROM (" + JUDGED_SQL + ") GROUP BY 1")
def verdict_shares(spark, sf):  # noqa: ANN001, ANN201
    return stats.verdict_shares(judged(spark, sf), ["lang"])


@query("SELECT event_type AS config, count(*) AS n, round(60 * count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 4) AS per_minute FROM events GROUP BY 1")
def throughput(spark, sf):  # noqa: ANN001, ANN201
    return stats.throughput(table(spark, sf, "events").withColumnRenamed("event_type", "config"), ["config"], "ts")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 200")
def first_rows(spark, sf):  # noqa: ANN001, ANN201
    return logs.first_rows(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 200)


def contracts(spark, sf):  # noqa: ANN001, ANN201
    """A contract for each supplier: its name, place, number and balance, the rest drawn by hashes of its key."""
    # dealt out while rows are short: a file of suppliers is one task, and what a contract costs is not seen in it
    suppliers = table(spark, sf, "supplier").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    s = suppliers.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    known = {
        "contract_no": F.concat(F.lit("SYNTH-CTR-"), F.col("s_suppkey").cast("string")),
        "seller_name": F.col("s_name"),
        "seller_address": F.concat(F.lit("SYNTH street, "), F.coalesce("n_name", F.lit("?"))),
        "unit_price_vnd": F.greatest(F.lit(1), F.round(F.abs("s_acctbal") * 100_000)).cast("long"),
    }
    return scans.contracts_of(s, "s_suppkey", known)


@query()
def synthetic_contracts(spark, sf):  # noqa: ANN001, ANN201
    return contracts(spark, sf).select("case_id", "source_pdf", "source_scan_pdf", F.to_json("ground_truth_fields").alias("ground_truth"))


@query()
def track1_summary(spark, sf):  # noqa: ANN001, ANN201
    return tracks.summary_track1(tracks.score_track1(tracks.track1(contracts(spark, sf))))


@query()
def track2_summary(spark, sf):  # noqa: ANN001, ANN201
    return tracks.summary_track2(tracks.score_track2(tracks.track2(contracts(spark, sf))))


@query()
def track1_frontier(spark, sf):  # noqa: ANN001, ANN201
    s = tracks.summary_track1(tracks.score_track1(tracks.track1(contracts(spark, sf))))
    return pareto.frontier_by_join(s.select("config", F.col("avg_total_tokens").alias("x"), F.col("avg_field_f1").alias("y")), "x", "y")
