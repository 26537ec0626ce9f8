"""Readers: JSONL logs (strict and tolerant), globbed task files, mixed score files, documents, configuration."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.sources.ordered import scores_with_summary
from evalloom.sources.schemas import SCHEMAS


def jsonl(spark: SparkSession, path: str, record: str | None = None, tolerant: bool = True) -> DataFrame:
    """JSON lines by a record's schema (else inferred). Blank lines are skipped; bad ones are dropped, or fail the read."""
    reader = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return (reader.schema(SCHEMAS[record]) if record else reader).json(path)


def jsonl_with_errors(spark: SparkSession, path: str, record: str) -> DataFrame:
    """All lines; those that do not parse have ``_corrupt_record`` set."""
    return spark.read.schema(SCHEMAS[record] + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def of_case(rows: DataFrame, case_id: str, newest_first: bool = False) -> DataFrame:
    found = rows.filter(F.col("case_id") == case_id)
    return found.orderBy(F.desc("ts")) if newest_first else found


def by_stem(spark: SparkSession, pattern: str, record: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Files of a pattern with their stem as ``dataset``."""
    rows = spark.read.schema(SCHEMAS[record]).json(pattern).withColumn("dataset", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))
    return rows.filter(~F.col("dataset").isin(*skip)) if skip else rows


def scores_and_summary(spark: SparkSession, path: str, record: str) -> tuple[DataFrame, DataFrame]:
    """A score file with a trailing ``{"SUMMARY": ...}`` line: the score rows, and the first summary as JSON."""
    rows, summary = scores_with_summary(spark, path, record)
    return rows.drop("file", "line", "place"), summary


def run_pairs(spark: SparkSession, summaries: str, details: str) -> tuple[DataFrame, DataFrame]:
    """Summary JSON files and detail JSONL files, each with ``slug`` from the file name."""
    slug = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:-summary)?\.[^./]+$", 1)
    return spark.read.option("multiLine", True).json(summaries).withColumn("slug", slug), spark.read.json(details).withColumn("slug", slug)


def objects(spark: SparkSession, folder: str, prefix: str = "", pattern: str = "*") -> DataFrame:
    """Files as rows (path, length, content), by path, without metadata sidecars."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.filter(F.startswith(name, F.lit(prefix)) & ~F.endswith(name, F.lit(".meta.json"))).orderBy("path")


def interpolated(value: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` replaced from the environment until none is left; unknown names are empty."""
    env = dict(os.environ) if env is None else env
    for _ in range(32):
        new = re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value)
        if new == value:
            break
        value = new
    return value


def settings(path: str, env: dict[str, str] | None = None) -> dict:
    """A YAML file with every string interpolated."""
    import yaml

    def walk(x):  # noqa: ANN001, ANN202
        if isinstance(x, str):
            return interpolated(x, env)
        return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else [walk(v) for v in x] if isinstance(x, list) else x

    with open(path, encoding="utf-8") as f:
        return walk(yaml.safe_load(f) or {})


def first_path(*candidates: str | None) -> str:
    """The first path that exists: argument, environment, default."""
    for c in candidates:
        if c and os.path.exists(c):
            return c
    raise FileNotFoundError(f"none of {candidates}")


def profile_path(name: str, folder: str) -> str:
    """The file of a named profile: an absolute path, one below the working folder, ``folder/name.yaml``, ``folder/name``."""
    tried = [name] if os.path.isabs(name) else []
    tried += [os.path.join(os.getcwd(), name), os.path.join(folder, f"{name}.yaml"), os.path.join(folder, name)]
    found = next((t for t in tried if os.path.isfile(t)), None)
    if found is None:
        raise FileNotFoundError(f"no profile {name!r}: looked for {tried}")
    return found


def profile(name: str, folder: str, env: dict[str, str] | None = None) -> dict:
    return settings(profile_path(name, folder), env)


def profile_chain(folder: str, config: str | None = None, env: dict[str, str] | None = None) -> list[dict]:
    """The profiles that a list file names, in order; ``folder/config.yaml`` by default."""
    names = settings(config or os.path.join(folder, "config.yaml"), env)
    return [profile(n, folder, env) for n in names or []]
