"""Queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textjudge.llm import bpe, compression, concat_cut, ctw, exact_dedup, histogram_sort, merkle, mixing, ngram_join, oracles, packing, rules, secret_scan, trie
from textjudge.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


@query(
    "op2_exact_dedup",
    r"""
    WITH rows AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(content) AS text_sha256
    FROM rows WINDOW w AS (PARTITION BY content)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


@query("op4_compression_bands")
def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(documents(spark, sf_dir))


@query("op5_entropy_secrets")
def op5_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


@query("op9_histogram_sort")
def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort.shard_by_bytes(documents(spark, sf_dir), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def digests(encoded: DataFrame, *more: Column) -> DataFrame:
    """Counts and digests of encoded documents with their decoded texts."""
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_forced_boundary_bpe")
def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), decoded=True))


@query("op3_temperature_mix")
def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placements(documents(spark, sf_dir))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_rule_ensemble")
def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op10_heavy_light_join", oracles.NEAR)
def op10_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(documents(spark, sf_dir))


@query("op1_context_tree")
def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(documents(spark, sf_dir))


@query("op12_concatenate_cut")
def op12_concatenate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = concat_cut.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op11_merkle_climb", oracles.MERKLE)
def op11_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(documents(spark, sf_dir))


@query("op13_prefix_trie", oracles.TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), borrow=trie.Borrow(group=100, limit=6))
