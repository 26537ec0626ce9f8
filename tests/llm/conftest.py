import random

import pytest
from pyspark.sql import types as T

#: Columns of documents, and one whose name clashes with result columns.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("n_words", T.StringType())])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    rng = random.Random(5)
    out = []
    for i in range(60):
        out.append((i, sentence(rng, rng.randint(60, 400)) + ".\n" + sentence(rng, 30), rng.choice(["en", "fr"]), f"s{i % 3}"))
    base = out[0][1].split(" ")
    near = list(base)
    near[-1] = "changed"
    out += [(100, " ".join(base), "en", "s0"), (101, " ".join(near), "en", "s1"), (102, " ".join(base).upper(), "en", None)]
    out += [(103, None, None, None), (104, "", "en", ""), (105, " \n\t ", "en", "s0"), (106, "one", "en", "s0"), (107, "One", "fr", "s1"), (None, "two words", "en", "s0"), (108, "### $$$ *** " * 80, "en", "s0"), (109, "dup dup dup " * 60, "en", "s1")]
    out += [(110, "é日本 <|endoftext|> don't STOP " * 40, "fr", "s2"), (111, sentence(rng, 60_000), "en", "s2"), (7, out[7][1], "en", "s1"), (7, out[7][1], "en", "s1")]
    return [(a, b, c, d, None if b is None else len(b), "x", "y") for a, b, c, d in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
