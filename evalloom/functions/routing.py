"""Deterministic routing of a case to a model tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import blank_separated

# Words that mark a clause, and the deployment of each tier.
CLAUSE = ("điều khoản", "khoản", "mục", "điều", "section", "clause")
DEPLOYMENTS = {"cheap": "gemini-3.5-flash-lite", "mid": "gemini-3.5-flash-lite", "strong": "gemini-3.5-flash-lite"}


def tier_extraction(n_fields: Column, has_tables: Column, rows: Column, columns: Column) -> Column:
    return F.when(~has_tables & (n_fields <= 10), "cheap").when((n_fields <= 30) & ~((rows > 10) | (columns > 6)), "mid").otherwise("strong")


def tier_question(est_tokens: Column, synthesis: Column) -> Column:
    return F.when((est_tokens < 2000) & ~synthesis, "cheap").when((est_tokens < 8000) & ~synthesis, "mid").otherwise("strong")


def rule(tier: Column, track: int) -> Column:
    return F.concat(F.lit(f"T{track}-R"), F.when(tier == "cheap", "1").when(tier == "mid", "2").otherwise("3"))


def deployment(tier: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in DEPLOYMENTS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, tier), F.lit(DEPLOYMENTS["cheap"]))


def features_extraction(tables: Column, text: Column, n_fields: Column) -> Column:
    """tables: array of struct(cells: array of struct(col, ...)). n_table_rows is the largest number of cells."""
    t = F.coalesce(tables, F.array().cast("array<struct<cells:array<struct<col:int,text:string>>>>"))
    cells = F.transform(t, lambda x: F.coalesce(F.size(x["cells"]), F.lit(0)))
    columns = F.transform(t, lambda x: F.coalesce(F.array_max(F.transform(x["cells"], lambda c: F.coalesce(c["col"], F.lit(0)))), F.lit(0)) + 1)
    return F.struct(
        n_fields.cast("long").alias("n_fields"),
        (F.size(t) > 0).alias("has_tables"),
        F.coalesce(F.array_max(cells), F.lit(0)).cast("long").alias("n_table_rows"),
        F.coalesce(F.array_max(columns), F.lit(0)).cast("long").alias("n_table_cols"),
        F.greatest(F.lit(1).cast("long"), blank_separated(text)).alias("est_tokens"),
    )


def features_question(question: Column, chunks: Column) -> Column:
    clause = "|".join(CLAUSE)
    several = F.size(F.filter(chunks, lambda c: F.lower(c).rlike(clause))) >= 2
    est = blank_separated(question) + F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + blank_separated(c))
    return F.struct(est.alias("est_tokens"), several.alias("requires_multi_clause_synthesis"))
