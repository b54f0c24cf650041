"""Dense zero-based numbering inside groups that may be too large for one task.

Rows are numbered inside chunks of a group; the size of all earlier chunks is added
from a small table of chunk sizes. No window ever spans more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def hash_number(*parts: Column | str, digits: int = 15) -> Column:
    """Deterministic draw from text parts: the first hex digits of their md5."""
    columns = [F.col(p) if isinstance(p, str) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", *columns).cast("binary"))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash_bucket(*parts: Column | str, buckets: int = BUCKETS) -> Column:
    return hash_number(*parts) % buckets


def chunked_index(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], chunk: Column, name: str,
    total: str | None = None,
) -> DataFrame:
    """Position of each row in its group, ordered by chunk and then by ``order``.

    ``chunk`` is either non-decreasing in ``order`` (the numbering then follows
    ``order``) or a hash bucket (a fixed arbitrary numbering). ``total`` also adds the
    group size.
    """
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*group, "_chunk")
    local = rows.withColumn("_local", F.row_number().over(inside.orderBy(*order)) - 1)
    sizes = rows.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    # one row per chunk: small enough to be ordered inside the group
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    if total is not None:
        starts = starts.withColumn(total, F.sum("_size").over(Window.partitionBy(*group)))
    joined = local.join(starts.drop("_size"), [*group, "_chunk"])
    return joined.withColumn(name, F.col("_start") + F.col("_local")).drop(
        "_chunk", "_local", "_start"
    )
