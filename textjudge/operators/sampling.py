"""Stratified blind samples for human annotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.keys import KEY, row_uid, size_bucket, stratum
from textjudge.operators.index import hash_number

SPLIT = ["variant", "size_bucket", "language"]
CELL = [*SPLIT, "stratum", "model", "dataset", "fluency"]
QUOTA = fixed.ROWS_PER_STRATUM * len(fixed.STRATA)


def candidates(faith: DataFrame, fluency: DataFrame, params: DataFrame) -> DataFrame:
    """Outputs with both scores, their stratum and model size; one row per key."""
    both = faith.withColumnRenamed("score", "faithfulness").join(
        fluency.select(*KEY, F.col("score").alias("fluency")), KEY
    )
    sized = both.join(params, "model")
    return sized.withColumns(
        {
            "uid": row_uid(*[F.col(k) for k in KEY]),
            "size_bucket": size_bucket(F.col("params_b")),
            "stratum": stratum(F.col("faithfulness")),
        }
    )


def _draw(seed: int):
    return hash_number(F.lit(str(seed)), "uid")


def _ranked(rows: DataFrame, steps, quota: int) -> DataFrame:
    """Apply ranks (name, group, order) one after the other, each cut at ``quota``.

    The rows behind the first ``quota`` of a group can never enter a larger group's
    first ``quota``, so every step sees bounded groups.
    """
    for name, group, order in steps:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        rows = rows.withColumn(name, rank).filter(F.col(name) <= quota)
    return rows


def stratified(rows: DataFrame, quota: int = QUOTA, seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    """``quota`` rows per split by nested turns.

    Fluency scores take turns inside a data set, data sets inside a model, models inside a
    stratum and strata inside a split; rows of one cell come in hash order. The model that
    begins moves on from stratum to stratum by as many places as a stratum has rows, so the
    turns left over in one stratum are made up in the next.
    """
    inner = [
        ("_fluency", CELL, ["draw", "uid"]),
        ("_dataset", [*SPLIT, "stratum", "model", "dataset"], ["_fluency", "draw", "uid"]),
        ("_model", [*SPLIT, "stratum", "model"], ["_dataset", "draw", "uid"]),
    ]
    drawn = _ranked(rows.withColumn("draw", _draw(seed)), inner, quota)
    split = Window.partitionBy(*SPLIT)
    numbered = drawn.withColumns({
        "_model_no": F.dense_rank().over(split.orderBy("model")) - 1,
        "_stratum_no": F.dense_rank().over(split.orderBy("stratum")) - 1,
    })
    first = F.col("_stratum_no") * (quota // len(fixed.STRATA))
    turned = numbered.withColumn("_place", F.pmod(F.col("_model_no") - first, F.max("_model_no").over(split) + 1))
    outer = [("_turn", [*SPLIT, "stratum"], ["_model", "_place"]), ("_split", SPLIT, ["_turn", "stratum"])]
    return _ranked(turned, outer, quota).select(*rows.columns)


def round_robin(rows: DataFrame, quota: int = QUOTA, seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    """The declarative variant: turns by model inside a stratum, by stratum inside a split.

    Model and data set are not balanced beyond that; ``stratified`` does it.
    """
    drawn = rows.withColumn("draw", _draw(seed))
    steps = [
        ("_a", [*SPLIT, "stratum", "model"], ["draw", "uid"]),
        ("_b", [*SPLIT, "stratum"], ["_a", "draw", "uid"]),
        ("_c", SPLIT, ["_b", "stratum", "uid"]),
    ]
    return _ranked(drawn, steps, quota).drop("draw", "_a", "_b", "_c")


def sheets(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blind sheet without model and judge columns, and the key sheet."""

    def project(names: Sequence[str]) -> DataFrame:
        have = set(sample.columns)
        return sample.select(*[F.col(n) if n in have else F.lit("").alias(n) for n in names])

    return project(fixed.BLIND_COLUMNS), project(fixed.KEY_SHEET_COLUMNS)


def cell_counts(sample: DataFrame) -> DataFrame:
    return sample.groupBy(*SPLIT, "stratum").agg(F.count(F.lit(1)).alias("n"))
