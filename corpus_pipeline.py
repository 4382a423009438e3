"""A training-data pipeline over documents: each stage is one of the operators at work.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import jaccard, langid, packing, pii, substrings
from sparkvane.llm.common import Stage, pick, read

#: By how much the mean log-probability of a text's n-grams must be above the background's; below, for names and foreign phrases.
LEAST_ABOVE = -1.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that was learned; others, null texts and those without a letter go.

    Repeated rows and rows without a doc_id are judged like others; an empty table gives no rows.
    """
    docs = pick(docs, *COLUMNS)
    return langid.keep_known(spark, docs, langid.fit(docs), LEAST_ABOVE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, Jaccard 0.8): the smallest doc_id.

    Of repeated rows one stays. Null and empty texts and rows without a doc_id are in no group and stay.
    """
    return jaccard.keep_first(pick(docs, *COLUMNS), 5, 80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that stand earlier too; the documents stay, and so do their lines.

    Null texts stay null; rows that share a doc_id are one place in order, so repeated rows are cut alike.
    """
    return substrings.without_repeats(pick(docs, *COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in text; each row gives a row, null texts stay null."""
    docs = pick(docs, *COLUMNS)
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids; each row is a document, a null or empty text the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_each_group),
    ("passages", without_repeated_passages),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Language ID and learned span classifiers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result staged in the shared folder."""
    stage = Stage(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage.put(docs)
    return docs
