"""Corpus pipeline: five stages over ``documents``, each written and read again.

All stages but the last return the columns of ``documents``; each works on all rows that
the one before kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textjudge.llm import bpe, compression, exact_dedup, mixing, ngram_join
from textjudge.llm.common import documents
from textjudge.llm.queries import digests
from textjudge.operators.lineage import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    return compression.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_join.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once or more, so that the sources have their target weights.

    The budget is the least in which no document is lost.
    """
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the text they decode to."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return digests(encoded, F.col("ids"))


#: (name, function) in order; a function takes (spark, docs, sf_dir).
STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: Byte-pair encoding has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written as Parquet in the shared folder and reread."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
