"""Judged JSONL trees: scan, quarantine, failure sidecars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import keys as K
from textjudge.functions import verdicts as J
from textjudge.functions.columns import let
from textjudge.sources.files import numbered_lines, split_lines

FAILURES = ".failures.jsonl"


def problem(verdict: Column, score: Column) -> Column:
    """Why a record cannot be used, or null."""
    bad = F.concat(
        F.lit("invalid or missing faithfulness_score: "),
        F.coalesce(score.cast("string"), F.lit("None")),
    )
    usable = F.coalesce(score.isin(*fixed.SCORE_VALUES), F.lit(False))
    return F.when(verdict.isNull(), F.lit("malformed or missing verdict")).when(~usable, bad)


def quarantine(df: DataFrame, raw: str, keep: Sequence[str]) -> DataFrame:
    """Rows whose judge text holds no valid verdict, with the reason."""

    def reason(verdict: Column) -> Column:
        score = F.try_variant_get(verdict, "$.faithfulness_score", "int")
        return let(score, lambda s: problem(verdict, s))

    # the filter is pushed below the projection: the text stands in it only once
    found = let(J.extract_verdict(F.col(raw)), reason)
    return df.select(*keep, found.alias("problem")).filter(F.col("problem").isNotNull())


def _filled(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, without the space around them."""
    return lines.withColumn("line", F.trim("line")).where("line <> ''")


def read_judged(
    spark: SparkSession, root: str, score_key: str = "faithfulness_score", glob: str = "*.jsonl"
) -> DataFrame:
    """All judgment records below ``root`` with their key and the raw record as VARIANT.

    Sidecars with failed calls are skipped; malformed lines stay with a null record so
    that ``bad_lines`` can report them. ``line_no`` counts all lines of a file, from 1.
    """
    lines = _filled(numbered_lines(spark, root, glob)).where(~F.endswith("path", F.lit(FAILURES)))
    rows = lines.withColumn("record", F.try_parse_json("line"))
    text = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    label = F.coalesce(F.nullif(text("source_label"), F.lit("")), K.file_stem(F.col("path")))
    source_id = F.coalesce(text("source_id"), F.lit(""))
    prefix = F.split_part(source_id, F.lit("__"), F.lit(1))
    model = F.when(F.contains(source_id, F.lit("__")), prefix).otherwise(K.parent_name(F.col("path")))
    keyed = rows.withColumn("_combo", K.parse_combo(label))
    return keyed.select(
        K.canonical_model(model).alias("model"),
        "_combo.*",
        F.coalesce(text("eid"), F.lit("")).alias("eid"),
        J.score_in_range(J.field(F.col("record"), "$.parsed"), score_key).alias("score"),
        F.coalesce(text("timestamp"), F.lit("")).alias("timestamp"),
        text("sentence").alias("sentence"),
        "record",
        "line",
        "path",
        "line_no",
    )


def latest_order() -> list[Column]:
    """Newest first; of equal time stamps the later line of the later file."""
    return [F.desc("timestamp"), F.desc("path"), F.desc("line_no")]


def bad_lines(judged: DataFrame, bad_files: DataFrame | None = None) -> DataFrame:
    """Quarantine table (path, line_no, line, problem).

    Malformed lines and records without a valid score; ``bad_files`` (path, problem) of
    other trees are added without a line.
    """
    why = F.when(F.col("record").isNull(), F.lit("malformed JSON")).when(
        F.col("score").isNull(), F.lit("invalid or missing score")
    )
    lines = judged.select("path", "line_no", "line", why.alias("problem")).filter("problem IS NOT NULL")
    if bad_files is None:
        return lines
    return lines.unionByName(bad_files.select("path", "problem"), allowMissingColumns=True)


def read_failures(spark: SparkSession, root: str, glob: str = "*" + FAILURES) -> DataFrame:
    """Failure sidecars as a table; ``details`` stays loose JSON."""
    rows = _filled(split_lines(spark, root, glob)).withColumn("r", F.try_parse_json("line"))
    names = (
        "timestamp eid source_label source_id requested_judge_model error_type error"
    ).split()
    fields = [F.try_variant_get("r", f"$.{n}", "string").alias(n) for n in names]
    details = F.try_variant_get("r", "$.details", "variant").alias("details")
    return rows.select(*fields, details, "path")


def failures_by_type(failures: DataFrame) -> DataFrame:
    return failures.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
