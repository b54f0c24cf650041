"""Data-quality checks as tables of violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from textjudge.operators.index import chunked_index, hash_bucket


def unbalanced(df: DataFrame, key: str, check: str) -> DataFrame:
    """All group sizes when they are not equal."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # one row per group of a fixed condition set
    all_ = Window.partitionBy(F.lit(0))
    spread = sizes.withColumn("_spread", F.max("n").over(all_) - F.min("n").over(all_))
    return spread.filter("_spread > 0").select(F.lit(check).alias("check"), F.col(key).alias("detail"), "n")


def watched(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with counters of the rows that break a rule.

    The job that uses ``df`` fills them on its way: the checks read nothing themselves.
    """
    seen = Observation()
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *broken), seen


def observed(spark: SparkSession, seen: Observation) -> DataFrame:
    """What a finished job has counted: broken rules, or that there were no rows."""
    counts = dict(seen.get)
    rows = counts.pop("rows")
    found = [(name, "rows", n) for name, n in counts.items() if n] if rows else [("no rows", "empty table", 0)]
    return spark.createDataFrame(found, "check string, detail string, n long")


def missing_columns(df: DataFrame, required: Sequence[str], check: str) -> DataFrame:
    absent = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(
        [(check, c, 0) for c in absent], "check string, detail string, n long"
    )


def violations(parts: Sequence[DataFrame]) -> DataFrame:
    """All findings; an empty table means that every check holds."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def keyword_batches(keywords: DataFrame, column: str, size: int) -> DataFrame:
    """Keywords in numbered groups of ``size``, in a fixed order independent of partitioning."""
    numbered = chunked_index(keywords, [], [column], hash_bucket(column), "_n")
    batch = F.floor(F.col("_n") / size).alias("batch")
    listed = F.sort_array(F.collect_list(F.struct("_n", column)))
    return numbered.groupBy(batch).agg(
        F.transform(listed, lambda x: x[column]).alias("keywords")
    )
