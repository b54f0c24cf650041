"""Shards of near-equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by a 63-bit key: the checksum of the text, then a hash of the row's place
in the input, so equal texts stand together, and a text that a third of all rows hold can
still be cut, even if those rows have one id. Keys are written once, before they are
counted, so a task that is repeated later finds the same ones.
Splitters are found by counting: each pass counts the exact bytes and rows in the
sub-ranges of every range that still holds an unsettled splitter, and narrows that range,
until what is left in it is below the tolerance or a single row. Then rows are exchanged
once, by piece, and numbered inside their piece.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge.llm.common import id_and_text
from textjudge.operators.lineage import materialize

KEY_BITS = 63
#: ranges that one counting pass may report to the driver, whatever the size of the input
REPORT = 1 << 18
ROWS_PER_PIECE = 1_000_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32 and the sort key."""
    crc = F.crc32("text")
    return id_and_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text").cast("long") + 16).alias("size"),
        crc.alias("text_crc32"),
        F.shiftleft(crc, 31).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 33)).alias("key"),
    )


def splitters(rows: DataFrame, pieces: int, tolerance: float) -> list[tuple[int, int]]:
    """(first key, rows below it) of the pieces after the first, by repeated counting."""
    total, n = rows.agg(F.sum("size"), F.count("key")).first()
    if not n or pieces < 2:
        return []
    targets = [total * (k + 1) / pieces for k in range(pieces - 1)]
    allowed = tolerance * total / pieces
    bits = max(2, min(12, int(math.log2(REPORT / pieces))))
    settled: list[tuple[int, int] | None] = [None] * len(targets)
    # range of a splitter: its prefix, and the bytes and rows below the range
    ranges = [(0, 0, 0)] * len(targets)
    depth = 0
    while depth < KEY_BITS and None in settled:
        step = min(bits, KEY_BITS - depth)
        open_ = sorted({ranges[i][0] for i, s in enumerate(settled) if s is None})
        prefix = F.shiftright("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")
        counted = (
            rows.where(prefix.isin(open_) if depth else F.lit(True))
            .groupBy(F.shiftright("key", KEY_BITS - depth - step).alias("part"))
            .agg(F.sum("size").alias("bytes"), F.count("key").alias("n"))
            .collect()
        )
        inside: dict[int, list] = {}
        for r in sorted(counted):
            inside.setdefault(r["part"] >> step, []).append(r)
        depth += step
        for i, s in enumerate(settled):
            if s is None:
                settled[i], ranges[i] = narrowed(inside[ranges[i][0]], ranges[i], targets[i], allowed, KEY_BITS - depth)
    return settled


def narrowed(parts: list, bounds: tuple[int, int, int], target: float, allowed: float, shift: int):
    """The settled splitter, if any, and the sub-range that holds the target."""
    _, below_bytes, below_rows = bounds
    for r in parts:
        if below_bytes + r["bytes"] >= target or r is parts[-1]:
            break
        below_bytes += r["bytes"]
        below_rows += r["n"]
    before, after = target - below_bytes, below_bytes + r["bytes"] - target
    settled = None
    if min(before, after) <= allowed or r["n"] == 1 or not shift:
        low = before <= after
        settled = (r["part"] << shift, below_rows) if low else ((r["part"] + 1) << shift, below_rows + r["n"])
    return settled, (r["part"], below_bytes, below_rows)


def longs(values: list[int]) -> Column:
    """All values as one literal."""
    return F.lit(np.array(values, dtype=np.int64))


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, tolerance: float = 0.002, pieces_per_shard: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard and slot.

    Bytes of the shards differ by no more than twice the tolerance and one row. Slots of a
    shard are gapless from 0, in key order. Null text counts 16 bytes and checksum 0; null
    ids and repeated rows are placed like others; an empty table gives an empty result;
    other columns are not read. Which rows of one text go to which of its shards depends on
    their place in the input.
    """
    rows = materialize(keyed(docs, id_col, text_col))
    each = pieces_per_shard or max(8, math.ceil(rows.count() / shards / ROWS_PER_PIECE))
    cuts = [(min(key, 2**63 - 1), n) for key, n in splitters(rows, shards * each, tolerance)]
    cuts += [(2**63 - 1, 0)] * (shards * each - 1 - len(cuts))
    keys = [k for k, _ in cuts]
    below = [0, *(n for _, n in cuts)]
    edges = keys[each - 1 :: each]
    shard = sum(((F.col("key") >= e).cast("int") for e in edges), F.lit(0))
    inner = F.array(*[longs(keys[s * each : s * each + each - 1]) for s in range(shards)])
    place = F.size(F.filter(F.element_at(inner, F.col("shard") + 1), lambda k: k <= F.col("key")))
    starts = longs([below[s * each + p] - below[s * each] for s in range(shards) for p in range(each)])
    placed = rows.withColumn("shard", shard).withColumn("piece", F.col("shard") * each + place)
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("key", "doc_id", "size"))
    slot = F.element_at(starts, F.col("piece") + 1) + rank - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def shard_of(key: int, edges: list[int]) -> int:
    """The same placement for one key, for checks outside Spark."""
    return bisect.bisect_right(edges, key)


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """All columns of ``docs`` as one folder per shard, in slot order inside each file.

    Rows meet their place by id, so ids have to be unique here.
    """
    where = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    part = F.floor(F.col("slot") / ROWS_PER_PIECE)
    joined = docs.join(where, id_col).repartition("shard", part).sortWithinPartitions("shard", "slot")
    joined.write.partitionBy("shard").parquet(path)
