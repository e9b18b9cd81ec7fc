"""From documents to token ids: quality, exact copies, near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept; all but the
last return the columns of ``documents``. A stage's result is written as Parquet before the next
one starts, so a lost executor costs at most the stage at work. An empty table passes through all
stages; columns beside the id and the text are carried and never looked at.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mensura.llm import bpe, decontamination, exact_dedup, jaccard_join, quality
from mensura.llm.common import fold, labelled_texts, shared_dir, table

#: Least quality score that stays.
LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from four folds of the labels.

    Null and empty texts have the score of an empty text. Rows are judged one by one: equal texts
    stay or go together, repeated rows and null ids need no care.
    """
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return quality.accepted(docs, quality.train(labelled_texts(docs, labels, "quality", quality.SAMPLE_ROWS)), LEAST_QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; null texts are equal to empty ones.

    Of equal texts without any id all rows stay, and so do repeated rows of the id that stays.
    """
    return exact_dedup.drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id.

    Texts without words and rows with a null id link with nothing and stay; repeated rows of an id
    stay or go together.
    """
    return jaccard_join.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none, rows with a null id aren't looked at, and both stay;
    repeated rows stay or go together. Items without words match nothing.
    """
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document, row by row; a null or empty text has no ids."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontamination", no_benchmark),
    ("bpe", token_ids),
]

#: SQL cannot express the classifier or the encoder; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
