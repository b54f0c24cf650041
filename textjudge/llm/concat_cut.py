"""Packing by concatenation: all documents in one row of ids, cut into fixed windows.

Two passes. The first encodes every document inside the task that reads it, notes how many
ids of that task come before it, and writes ids and places as a table in the shared
folder. The second turns the id totals of the tasks into offsets by a prefix sum over one
row per task; with them every document knows its place in the whole row of ids, and is
cut at the borders of the windows by plain column arithmetic. Nothing is shuffled but the
totals, and no document meets another before ``sequences`` builds the windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge.llm.common import id_and_text, id_type, small_batches
from textjudge.llm.ids import encoder
from textjudge.operators.lineage import shared_folder

#: bytes of an id in the binary columns: unsigned, little-endian
WIDTH = 4
#: task totals are broadcast up to this number of tasks (16 bytes each), joined beyond it
BROADCAST_TASKS = 1_000_000


def encoded_table(docs: DataFrame, vocabulary_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, written in the shared folder: doc_id, part, first, doc_tokens, ids.

    ``part`` is the task that read the document, ``first`` the ids before it in that task.
    """
    if not 0 <= end_id < 1 << 8 * WIDTH:
        raise ValueError("ids are unsigned 32-bit numbers")
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = encoder(source.value).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in small_batches(batch):
                found = [np.append(encode(t), end_id).astype("<u4") for t in rows.column("text").to_pylist()]
                counts = np.array([len(x) for x in found], np.int64)
                before = first + np.cumsum(counts) - counts
                first += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([part] * len(found), pa.int32()), pa.array(before), pa.array(counts), pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["doc_id", "part", "first", "doc_tokens", "ids"],
                )

    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    schema = f"doc_id {id_type(docs, id_col)}, part int, first long, doc_tokens long, ids binary"
    id_and_text(docs, id_col, text_col).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def placed(table: DataFrame) -> DataFrame:
    """The table with ``place``: the ids of all documents before, over all tasks."""
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # one row per task of the first pass
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if starts.count() <= BROADCAST_TASKS:
        starts = F.broadcast(starts)
    return table.join(starts, "part").select("doc_id", "doc_tokens", "ids", (F.col("start") + F.col("first")).alias("place"))


def pack_documents(
    docs: DataFrame, vocabulary_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    Documents are the ids of their whole text and ``end_id``; null counts as empty text, so
    it is ``end_id`` alone. All windows but the last are full. ``start`` counts from the
    document's first id, ``offset`` from the window's; ``ids`` are little-endian unsigned
    32-bit numbers. Null ids and repeated rows are packed like others, a text longer than a
    window is cut; an empty table gives an empty result; other columns are not read.
    """
    if length < 1:
        raise ValueError("a window holds one id at least")
    rows = placed(encoded_table(docs, vocabulary_path, end_id, id_col, text_col))
    end = F.col("place") + F.col("doc_tokens")
    whole = lambda c: F.floor(c / F.lit(length)) if length & (length - 1) else F.shiftright(c, length.bit_length() - 1)
    cut = rows.select("*", F.explode(F.sequence(whole(F.col("place")), whole(end - 1))).alias("sequence_id"))
    left = F.col("sequence_id") * length
    first, last = F.greatest("place", left), F.least(end, left + length)
    ids = F.substring("ids", (WIDTH * F.col("start") + 1).cast("int"), (WIDTH * F.col("length")).cast("int"))
    return cut.select(
        "doc_id", (first - F.col("place")).alias("start"), (last - first).alias("length"), "doc_tokens", "sequence_id", (first - left).alias("offset"), "ids",
    ).withColumn("ids", ids)


def joined(parts: Column) -> Column:
    """Binary values of an array, one after the other."""
    return F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part))


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 50256) -> DataFrame:
    """The windows: sequence_id, n_tokens, ids (padded to ``length``) and boundary records.

    A boundary record (doc_id, start, offset, length) stands for each piece, in order. A
    window meets its at most ``length`` pieces and nothing else.
    """
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    windows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_tokens"))
    pad = pad_id.to_bytes(WIDTH, "little").hex()
    missing = F.unhex(F.repeat(F.lit(pad), (F.lit(length) - F.col("n_tokens")).cast("int")))
    record = lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))
    return windows.select(
        "sequence_id", "n_tokens", F.concat(joined(F.transform("p", lambda x: x["ids"])), missing).alias("ids"), F.transform("p", record).alias("boundaries"),
    )
