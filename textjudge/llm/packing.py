"""Token ids packed into rows of fixed length, best fit first, as binary columns.

Documents are dealt into blocks of bounded size; each block is encoded and packed in one
task. Pieces are taken by decreasing length, and each goes to the row with the least free
space that still holds it; a segment tree over free space finds that row in logarithmic
time. Overlong documents are split into pieces that join again without loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textjudge.llm.common import id_and_text, id_type, in_blocks
from textjudge.llm.ids import encoder


class FreeSpace:
    """Rows by free space: a segment tree of counts over the amounts 0..length."""

    def __init__(self, length: int):
        self.half = 1 << length.bit_length()
        self.count = [0] * (2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._change(space, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(space, row) of the row with the least free space of at least ``least``."""
        k = least + self.half
        while not self.count[k]:
            while k & 1:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            if k == self.half << 1:
                return None
        while k < self.half:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        space = k - self.half
        self._change(space, -1)
        return space, self.rows[space].pop()

    def _change(self, space: int, by: int) -> None:
        k = space + self.half
        while k:
            self.count[k] += by
            k >>= 1


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Members of each row; no length may exceed the capacity."""
    rows: list[list[int]] = []
    free = FreeSpace(capacity)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if found := free.take(lengths[k]):
            space, row = found
            rows[row].append(k)
        else:
            space, row = capacity, len(rows)
            rows.append([k])
        if space > lengths[k]:
            free.add(space - lengths[k], row)
    return rows


def pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of a document, in order, without loss."""
    return [(s, min(capacity, length - s)) for s in range(0, length, capacity)]


def pack_documents(
    docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256,
    block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per packed row of the id matrix of its block.

    block, row, n_tokens; ids and positions (binary, little-endian uint16, ``capacity``
    numbers each, positions restart at 0 with each segment); cumulative segment lengths
    from 0; and the segments (doc_id, start in the document, length) in row order. Every
    document ends with ``end_id``; null and empty texts are that id alone, so no document
    is lost. Repeated rows are packed one by one; an empty table gives an empty result;
    other columns are not read.
    """
    if not 0 < capacity <= 65535:
        raise ValueError("positions are 16-bit")
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    if max(encoder(text).size - 1, end_id, pad_id) > 65535:
        raise ValueError("ids are 16-bit")
    source = docs.sparkSession.sparkContext.broadcast(text)

    def pack_block(table: pa.Table) -> pa.Table:
        encode = encoder(source.value).encode
        table = table.sort_by([("doc_id", "ascending")])
        ids = [np.append(encode(t.as_py()), end_id).astype(np.uint16) for t in table.column("text")]
        parts = [(d, s, n) for d, x in enumerate(ids) for s, n in pieces(len(x), capacity)]
        ramp = np.arange(capacity, dtype=np.uint16)
        out: dict[str, list] = {c: [] for c in ("n", "ids", "positions", "ends", "docs", "starts", "lengths", "segments")}
        for members in pack([n for _, _, n in parts], capacity):
            row, place = np.full(capacity, pad_id, np.uint16), np.zeros(capacity, np.uint16)
            ends = [0]
            for k in members:
                d, s, n = parts[k]
                row[ends[-1] : ends[-1] + n] = ids[d][s : s + n]
                place[ends[-1] : ends[-1] + n] = ramp[:n]
                ends.append(ends[-1] + n)
                out["docs"].append(d)
                out["starts"].append(s)
                out["lengths"].append(n)
            out["n"].append(ends[-1])
            out["ids"].append(row.astype("<u2").tobytes())
            out["positions"].append(place.astype("<u2").tobytes())
            out["ends"].append(ends)
            out["segments"].append(len(members))
        size = len(out["n"])
        offsets = pa.array(np.cumsum([0, *out["segments"]]), pa.int32())
        segment = pa.StructArray.from_arrays(
            [table.column("doc_id").combine_chunks().take(pa.array(out["docs"], pa.int64())), pa.array(out["starts"], pa.int64()), pa.array(out["lengths"], pa.int32())],
            names=["doc_id", "start", "length"],
        )
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * size, pa.int32()), "row": pa.array(range(size), pa.int32()), "n_tokens": pa.array(out["n"], pa.int32()),
                "ids": pa.array(out["ids"], pa.binary()), "positions": pa.array(out["positions"], pa.binary()),
                "cumulative_lengths": pa.array(out["ends"], pa.list_(pa.int32())), "segments": pa.ListArray.from_arrays(offsets, segment),
            }
        )

    kind = id_type(docs, id_col)
    schema = (
        "block int, row int, n_tokens int, ids binary, positions binary, cumulative_lengths array<int>, "
        f"segments array<struct<doc_id: {kind}, start: bigint, length: int>>"
    )
    blocks, _ = in_blocks(id_and_text(docs, id_col, text_col), block_bytes)
    return blocks.groupBy("block").applyInArrow(pack_block, schema)
