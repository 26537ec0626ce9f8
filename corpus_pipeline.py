"""Corpus pipeline: quality rules, toxicity, near duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and but for the last returns the columns of
documents. Between stages the documents are written to the shared folder and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm import mixing, ngram_join, packing, quality_rules, toxicity
from evalloom.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: No SQL: learned scores and genetic packing. Tests hold the stages against plain versions, but mixing only to known ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
