import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def table(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: table(spark, rows)


@pytest.fixture
def clashing(spark):
    """The rows with more columns, some of a name that a result or another column has."""

    def make(rows):
        more = [f"d.{c}" for c in SCHEMA.names]
        table(spark, rows).createOrReplaceTempView("d")
        return spark.sql(f"SELECT {', '.join(more)}, 1 AS shard, 'x' AS TEXT, 2 AS n_words, 3 AS size, 4 AS `key`, 5 AS part, 6 AS Doc_Id FROM d")

    return make


@pytest.fixture
def odd():
    """Null and empty texts, white space alone, null and repeated ids, a repeated row and a long text."""
    r = random.Random(5)
    words = "alpha beta gamma delta épsilon zeta eta theta 12 3.4 x".split()
    long = " ".join(r.choice(words) for _ in range(40_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "no id here at all"), (5, "repeated row"), (5, "repeated row"), (6, long), (7, "ß" * 3000), (8, "a b c d"), (9, "日本語 テキスト 😀"), (5, "other text of 5")]
