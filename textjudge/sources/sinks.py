"""Report sinks: partitioned trees instead of one driver loop per group."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textjudge.operators.lineage import shared_folder
from textjudge.sources.tables import BOM

REPORT_KEYS = ["generator_model", "dataset", "variant"]


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder of the session."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def write_report(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "csv") -> None:
    """One report, partitioned into sub-folders; rows of a folder are brought together first.

    Rows are spread by the folder keys and a hash of the row, so a folder that holds
    most of the rows is written by many tasks.
    """
    options = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    if by:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        plain = [c for c in df.columns if c not in by]
        part = F.pmod(F.xxhash64(*[F.col(c) for c in plain]), F.lit(max(2, width // 4)))
        df = df.repartition(*[F.col(c) for c in by], part)
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_report_tree(reports: dict[str, DataFrame], root: str, by: Sequence[str] = REPORT_KEYS, fmt: str = "csv") -> None:
    """Named reports below ``root``; those with all folder keys are partitioned by them."""
    for name, df in reports.items():
        keys = [k for k in by if k in df.columns] if set(by) <= set(df.columns) else []
        write_report(df, f"{root}/{name}", keys, fmt)


def write_bronze(df: DataFrame, path: str, by: Sequence[str] = ("model", "dataset", "variant", "language")) -> None:
    """Parsed records as partitioned parquet, so later scans can prune by key."""
    write_report(df, path, by, "parquet")


def write_annotations(df: DataFrame, path: str) -> None:
    """Annotation sheet with a byte order mark in front of the first header."""
    first, *rest = df.columns
    df.toDF(BOM + first, *rest).write.mode("overwrite").option("header", "true").option(
        "escape", '"'
    ).csv(path)
