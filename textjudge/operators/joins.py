"""Keyed joins with their integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge.functions.keys import KEY


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "input") -> DataFrame:
    """Fail the job when a key occurs twice.

    Copies are counted by an aggregation on the join key, one row of each key kept: a key
    with any number of copies is one row per task before the shuffle, and the following
    join on the same key reuses the partitioning.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = [F.any_value(F.struct(*rest)).alias("_row")] if rest else []
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), *kept)
    message = F.lit(f"{what}: key ({', '.join(keys)}) is not unique")
    good = F.when(F.col("_copies") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return counted.filter(good).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def join_one_to_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY, how: str = "inner"
) -> DataFrame:
    """Equi join that fails when either side repeats a key."""
    return assert_unique(left, keys, "left side").join(
        assert_unique(right, keys, "right side"), list(keys), how
    )


def join_left_default(
    left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, Column]
) -> DataFrame:
    """Left join; the given columns get a default where the right side has no row."""
    joined = left.join(right, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left side that have no partner."""
    return left.select(*keys).distinct().join(right, list(keys), "left_anti")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column missing from one source is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def join_by_model_alias(
    judged: DataFrame, summary: DataFrame, keys: Sequence[str] = KEY
) -> DataFrame:
    """Left join on the record key where model names may differ by one dot or underscore.

    Only the summary side is unfolded, to at most three names per row; an exact name
    wins over a derived one.
    """
    from textjudge.functions.keys import model_candidates

    names = summary.select(
        F.posexplode(model_candidates(F.col("model"))).alias("_rank", "_name"), "*"
    )
    named = names.drop("model").withColumnRenamed("_name", "model")
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    single = named.withColumn("_best", best).filter("_best = 1").drop("_best", "_rank")
    return judged.join(single, list(keys), "left")
