"""Files of a tree: their places, numbered lines, first rows in file order.

Files stay split. Rows are counted per split, the counts of earlier splits of a file are
added up from one row per split, and a row's number is that sum plus its place in its own
split. The same sums over all files give places in file order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textjudge.operators.lineage import materialize

#: tables of one row per split are broadcast up to this many rows (about 150 bytes each)
BROADCAST_SPLITS = 100_000


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, file_path, length) of the files below ``root``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("_metadata.file_path").alias("file_path"), "length")


def split_lines(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """(path, block, row, line): ``row`` grows inside a split, ``block`` is where it begins."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths)
    return in_splits(lines).withColumnRenamed("value", "line")


def in_splits(rows: DataFrame) -> DataFrame:
    """Rows just read from files, with the columns path, block and row."""
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "*",
    )


def split_starts(rows: DataFrame) -> DataFrame:
    """(path, block, first, n, before, place): rows of a split, and those before it in the file and in all."""
    splits = rows.groupBy("path", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row per split
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_file, in_tree = Window.partitionBy("path").orderBy("block"), Window.orderBy("path", "block")
    return materialize(splits.select("*", earlier(in_file).alias("before"), earlier(in_tree).alias("place")))


def numbered(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds line_no (from 1, inside the file) and place (from 0, in file order)."""
    small = F.broadcast(starts) if starts.count() <= BROADCAST_SPLITS else starts
    local = F.col("row") - F.col("first")
    joined = rows.join(small, ["path", "block"]).withColumns({"line_no": F.col("before") + local + 1, "place": F.col("place") + local})
    return joined.drop("block", "row", "first", "n", "before")


def numbered_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, line, line_no, place) of all lines below ``root``, blank ones counted.

    The files are read twice; only the line count of each split is kept from the first time.
    """
    rows = split_lines(spark, root, glob)
    return numbered(rows, split_starts(rows))


def in_batches(paths: list[str]) -> Iterator[list[str]]:
    """The files in order: one, then two, four and so on."""
    size, at = 1, 0
    while at < len(paths):
        yield paths[at : at + size]
        at, size = at + size, size * 2


def first_rows(spark: SparkSession, root: str, n: int, read: Callable[[list[str]], DataFrame], glob: str = "*") -> DataFrame:
    """The first ``n`` rows in file order, with line_no and place.

    ``read`` turns paths into rows with path, block and row. Files are counted in order
    until they hold ``n`` rows; later ones are never opened.
    """
    paths = [r.path for r in list_files(spark, root, glob).orderBy("path").select("path").toLocalIterator()]
    used, held = [], 0
    for batch in in_batches(paths):
        used += batch
        held += read(batch).count()
        if held >= n:
            break
    rows = read(used or paths[:1] or [root])
    return numbered(rows, split_starts(rows)).where(F.col("place") < n)


def first_lines(spark: SparkSession, root: str, n: int, glob: str = "*") -> DataFrame:
    """The first ``n`` lines in file order: (path, line, line_no, place)."""
    return first_rows(spark, root, n, lambda paths: split_lines(spark, paths), glob)
