"""A corpus pipeline over ``documents``: each stage applies one operator to all that its predecessor kept.

Quality rules drop documents, near-duplicate search keeps one of each group,
personal data is masked, sources are mixed to target weights, and the mix is
encoded. Every stage's rows are written to the shared folder and reread, so a
lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tricklens.llm import apportion, chunk_table, coordinate_join, disclosure, quality_rules
from tricklens.llm.common import stored, table

PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return coordinate_join.first_of_each(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are masked; n_chars follows the text."""
    return recounted(disclosure.sanitised(docs, "text", lambda df: stored(df, "disclosure")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often, and with those blocks of words, as its source's share takes it."""
    return recounted(apportion.mix(docs, store=lambda df: stored(df, "mix")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian int32, end id included) and decoded text of every row of the mix."""
    return chunk_table.encoded(docs, public_tokenizers.path(PIECES))


def recounted(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("personal data", privacy),
    ("source mixture", mixture),
    ("token ids", tokens),
]

# SQL cannot express the tokenizer stage: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
