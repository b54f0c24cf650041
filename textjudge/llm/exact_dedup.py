"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Three stages, each grouping by the whole content next to its digest, so texts are never
taken for equal because of a digest alone:

1. local: the salt follows the input partition, so the map side of the first aggregation
   merges the copies that a task reads;
2. salted: copies of a text meet per (digest, content, salt), so a text that a third of all
   rows hold is spread over many tasks, even if those rows share their id as well;
3. global: of each salt group only the smallest id and the number of rows meet, and the
   smallest id wins.

The answer goes back to the salt groups, which still hold the ids of their rows: at no
time do all ids of a text meet. The number of salts is at most the square root of the number
of rows, so neither a salt group nor a global group grows faster than that (a salt group
never holds less than a share of one input partition).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textjudge.llm.common import SPACE, id_and_text, whole_text

KEY = ["text_sha256", "content"]
#: salts that the copies read by one task may get
PARTS = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def salt_count(docs: DataFrame) -> int:
    return max(1, math.isqrt(docs.count()))


def salt_groups(rows: DataFrame, salts: int) -> DataFrame:
    """(text_sha256, content, salt, members): the ids of a text that share a salt."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id(), part), F.lit(salts)))
    hashed = salted.withColumn("text_sha256", F.sha2("content", 256))
    return hashed.groupBy(*KEY, "salt").agg(F.collect_list(F.struct("doc_id")).alias("members"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space. Null
    counts as empty text. The row with the smallest id stays; null ids come last; of rows
    that also share the id exactly one stays. An empty table gives an empty result; other
    columns of ``docs`` are not read.

    The answer finds a salt group by its digest, salt and smallest id. Contents are not sent
    back; two that differ could only be mixed up if their SHA-256, salt and smallest id were
    all equal.
    """
    salts = salts or salt_count(docs)
    rows = id_and_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("content"))
    # both uses need all of members, so the exchange of the contents is one and reused
    groups = salt_groups(rows, salts).withColumn("ids", F.col("members")["doc_id"])
    smallest = F.array_min("ids")
    entry = F.struct(smallest.isNull().alias("none"), smallest.alias("id"), F.col("salt"))
    winners = (
        groups.select(*KEY, entry.alias("entry"), F.size("members").cast("long").alias("n"))
        .groupBy(*KEY)
        .agg(F.min("entry").alias("best"), F.sum("n").alias("group_size"), F.collect_list("entry").alias("entries"))
    )
    answers = winners.select(F.col("text_sha256").alias("digest"), "best", "group_size", F.explode("entries").alias("entry"))
    held = groups.select("text_sha256", entry.alias("own"), "ids")
    # null-safe: else a filter on null digests is pushed below one of the two uses only
    same = (
        F.col("text_sha256").eqNullSafe(F.col("digest"))
        & (F.col("own.salt") == F.col("entry.salt"))
        & F.col("own.id").eqNullSafe(F.col("entry.id"))
    )
    merged = held.join(answers, same, "left").select(
        "text_sha256",
        F.col("best.id").alias("keep_id"),
        # a group without an answer stops the job: none is ever left out
        F.coalesce("group_size", F.raise_error(F.lit("salt group without answer")).cast("long")).alias("group_size"),
        (F.col("own.salt") == F.col("best.salt")).alias("here"),
        "ids",
    )
    first = F.when(F.col("here"), F.coalesce(F.array_position("ids", F.col("keep_id")), F.lit(1)) - 1)
    opened = merged.select("text_sha256", "keep_id", "group_size", first.alias("first"), F.posexplode("ids").alias("pos", "doc_id"))
    kept = F.coalesce(F.col("pos") == F.col("first"), F.lit(False))
    return opened.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The same three stages; a whole row travels with its content, so no join follows.
    Rows equal in content and id are ordered by their other columns; one of them stays.
    """
    salts = salts or salt_count(docs)
    names = docs.columns
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    number = names.index(id_col)
    order = [F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), *others]
    rows = docs.select(normalised(whole_text(text_col)).alias("content"), F.struct(*order).alias("row"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64(F.col("row")[f"c{number}"]), F.lit(salts)))
        .withColumn("text_sha256", F.sha2("content", 256))
        .groupBy(*KEY, "salt")
        .agg(F.min("row").alias("row"))
    )
    winners = salted.groupBy(*KEY).agg(F.min("row").alias("row"))
    return winners.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)])
