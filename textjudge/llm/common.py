"""Shared pieces of the text operators: white space, input table, batches, text blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textjudge.operators.lineage import materialize

#: White space between words; ``bytes.split()`` uses the same six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text_col: str = "text") -> Column:
    """The text, empty when null."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so other columns can have any name."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).alias("text"))


def map_texts(df: DataFrame, function, schema: str) -> DataFrame:
    """``function(id, text) -> tuple`` for each row, in Arrow batches.

    ``df`` has the columns doc_id and text; ``schema`` names doc_id first and then the
    members of the tuple.
    """
    fields = [f.split()[0] for f in schema.split(",")]
    out = pa.schema(_arrow_fields(df.sparkSession, schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                rows = [function(t) for t in part.column("text").to_pylist()]
                columns = list(zip(*rows)) if rows else [[] for _ in fields[1:]]
                arrays = [part.column("doc_id")]
                arrays += [pa.array(c, out.field(i + 1).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([out.field(0).with_type(arrays[0].type), *list(out)[1:]]))

    return df.mapInArrow(run, schema)


def _arrow_fields(spark: SparkSession, schema: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(schema)]


def small_batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that only a few texts are held as Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()


def width(df: DataFrame) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_blocks(docs: DataFrame, block_bytes: int, *more: str) -> tuple[DataFrame, int]:
    """(block, doc_id, text and ``more``) and the number of blocks.

    Rows are dealt by a hash into blocks of about ``block_bytes``. The number of blocks
    follows the bytes of all texts, so a block fits in one task at any size. Which block a
    row is in depends on the row alone.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(width(docs), math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), "doc_id", "text", *more), blocks


def range_parts(df: DataFrame, order: list[str | Column], rows_per_part: int = 1 << 18) -> DataFrame:
    """``df`` sorted as a whole and dealt into ranges of about ``rows_per_part`` rows.

    Checkpointed, with the column ``part`` (ranges in order). Rows that are equal in
    ``order`` are told apart by their place in the input, so repeated rows spread as well;
    no key, however frequent, makes a range larger than the others.
    """
    rows = materialize(df.withColumn("_place", F.monotonically_increasing_id()))
    parts = max(width(df), math.ceil(rows.count() / rows_per_part))
    ranged = rows.repartitionByRange(parts, *order, "_place").sortWithinPartitions(*order, "_place")
    return materialize(ranged.withColumn("part", F.spark_partition_id()))
