"""Prefix trie of conversations as a table of nodes with minimal perfect hash slots.

A node is a distinct sequence of first turns. Turns are reduced to 128-bit digests and
sorted as a whole into shards: ranges of about equal size, whatever the size of a
conversation. Inside a shard the digests of all prefixes are running exclusive-or sums of
the turn digests, each mixed with its depth; the little that a conversation has before its
shard (a depth and a running sum) is carried over from the totals of earlier shards.

Each shard enumerates its distinct prefixes; their rank is the slot, so a shard of n nodes
has exactly the slots 0 to n-1. Every row on a slot has to show the same parent, depth and
turn digest, otherwise two sequences collide and the job fails; the same check is made
when the shards' nodes meet. Counts are scattered into flat arrays by slot and added up
through the parent slots, deepest nodes first. A node that many shards know, such as a
first turn of most conversations, reaches the common table once per shard, already summed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textjudge.llm.common import range_parts
from textjudge.operators.lineage import materialize

KEY, PARENT = ["k1", "k2"], ["p1", "p2"]
DIGEST = 16


@dataclass(frozen=True)
class Borrow:
    """Conversation c begins with the first ``turns(c)`` turns of the first of its ``group``."""

    group: int = 100
    limit: int = 6

    def base(self, convs: np.ndarray) -> np.ndarray:
        return convs - convs % self.group

    def turns(self, convs: np.ndarray) -> np.ndarray:
        drawn = np.array([zlib.crc32(b"%d" % c) % self.limit for c in convs.tolist()], np.int64)
        return np.where(convs == self.base(convs), 0, drawn)


@dataclass
class Carry:
    """What a shard needs from earlier ones, for the conversation and the group it begins in."""

    rows: int = 0
    sums: tuple[int, int] = (0, 0)
    head: list[tuple[bytes, int]] = field(default_factory=list)
    #: whether the last conversation goes on in the next shard
    goes_on: bool = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (fixed values: the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair among the distinct pairs, and the first place of each of them."""
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    ranks = np.empty(len(a), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks, order[new]


class Shard:
    """The turns of one range, as rebuilt sequences with their running digests."""

    def __init__(self, table: pa.Table, carry: Carry, borrow: Borrow, seed: int):
        conv = table.column("conv_id").to_numpy()
        digests = np.frombuffer(b"".join([d for d, _ in carry.head] + table.column("digest").to_pylist()), "<u8").reshape(-1, 2)
        chars = np.concatenate((np.array([n for _, n in carry.head], np.int64), table.column("chars").to_numpy()))
        early = len(carry.head)
        start = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        size = np.diff(np.append(start, len(conv)))
        self.convs = convs = conv[start]
        offset = np.zeros(len(convs), np.int64)
        offset[0] = carry.rows
        base, wanted = borrow.base(convs), borrow.turns(convs)
        # head of each conversation's group: place among all turns held here, and turns it has
        found = np.minimum(np.searchsorted(convs, base), len(convs) - 1)
        here = convs[found] == base
        head = np.where(here, start[found] + early, 0)
        there = np.where(here, size[found], 0)
        if early:
            first = base == base[0]
            head = np.where(first, 0, head)
            there = np.where(first, early + (size[0] if carry.rows and convs[0] == base[0] else 0), there)
        taken = np.minimum(wanted, there)
        self.new = offset == 0
        before = np.where(self.new, 0, taken + np.maximum(0, offset - wanted))
        skipped = np.clip(wanted - offset, 0, size)
        lent, own = np.where(self.new, taken, 0), size - skipped
        self.size = lent + own
        self.end = np.cumsum(self.size)
        self.segment = np.repeat(np.arange(len(convs)), self.size)
        self.depth = np.arange(len(self.segment)) - np.repeat(self.end - self.size, self.size) + np.repeat(before, self.size)
        inside = np.arange(len(self.segment)) - np.repeat(self.end - self.size, self.size)
        borrowed = inside < lent[self.segment]
        place = np.where(borrowed, head[self.segment] + inside, early + (start + skipped - lent)[self.segment] + inside)
        self.digest, self.chars = digests[place], chars[place]
        deep = mixed(self.depth.astype(np.uint64) + np.uint64(seed << 32 | 1))
        step = np.stack([mixed(self.digest[:, 0] ^ deep), mixed(self.digest[:, 1] + deep)], 1)
        run = np.bitwise_xor.accumulate(step, 0) if len(step) else step
        earlier = np.concatenate((np.zeros((1, 2), np.uint64), run))[self.end - self.size]
        earlier[0] ^= np.array(carry.sums, np.uint64) if carry.rows else np.uint64(0)
        self.key = run ^ np.repeat(earlier, self.size, 0)
        self.parent = self.key ^ step
        # running sums and depth of each conversation at the end of this shard
        total = np.concatenate((np.zeros((1, 2), np.uint64), run))[self.end]
        self.sums, self.reached = total ^ earlier, before + self.size
        self.closed = np.ones(len(convs), bool)
        self.closed[-1] = not carry.goes_on

    def nodes(self) -> dict[str, np.ndarray | list]:
        """The distinct prefixes of this shard, by slot, with what its conversations say of them."""
        roots = np.flatnonzero(self.new)
        key = np.concatenate((np.zeros((len(roots), 2), np.uint64), self.key))
        parent = np.concatenate((np.zeros((len(roots), 2), np.uint64), self.parent))
        depth = np.concatenate((np.zeros(len(roots), np.int64), self.depth + 1))
        digest = np.concatenate((np.zeros((len(roots), 2), np.uint64), self.digest))
        chars = np.concatenate((np.zeros(len(roots), np.int64), self.chars))
        conv = np.concatenate((self.convs[roots], self.convs[self.segment]))
        # the last row of each conversation here; its root if it begins here and has no turn
        last = np.where(self.size > 0, len(roots) + self.end - 1, np.cumsum(self.new) - 1)
        known = (self.size > 0) | self.new
        closing = np.flatnonzero(self.closed & ~known)
        slot, first = slots(key[:, 0], key[:, 1])
        same = (parent == parent[first][slot]).all(1) & (depth == depth[first][slot]) & (digest == digest[first][slot]).all(1)
        if not same.all():
            raise ValueError("two sequences of turns have one digest; choose another seed")
        # a conversation that ends here without a turn of its own here is the first one
        early = [int(self.convs[k]) for k in closing]
        where = np.flatnonzero((key[first] == self.sums[closing[0]]).all(1)) if early else []
        lists: dict[int, list[int]] = {int(k): early for k in where}
        for c in np.flatnonzero(self.closed & known).tolist():
            lists.setdefault(int(slot[last[c]]), []).append(int(self.convs[c]))
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, slot, conv)
        out = {
            "key": key[first], "parent": parent[first], "depth": depth[first], "digest": digest[first], "chars": chars[first],
            "n_convs": np.bincount(slot, minlength=len(first)), "least": least,
            "ends": [np.array(lists[k], "<i8").tobytes() if k in lists else None for k in range(len(first))],
            "last": np.zeros(len(first), bool),
        }
        if known[-1]:
            out["last"][slot[last[-1]]] = True
        if early and not len(where):
            out["closing"] = {"key": self.sums[closing], "depth": self.reached[closing], "ends": [np.array(early, "<i8").tobytes()]}
        return out


NODE = "part int, k1 long, k2 long, p1 long, p2 long, depth long, d1 long, d2 long, chars long, n_convs long, least long, last boolean, ends binary"


def node_batch(part: int, n: dict) -> Iterator[pa.RecordBatch]:
    def batch(key, parent, depth, digest, chars, n_convs, least, last, ends):
        lanes = [a[:, k].astype(np.uint64).view(np.int64) for a in (key, parent) for k in (0, 1)]
        sides = [digest[:, k].astype(np.uint64).view(np.int64) for k in (0, 1)]
        columns = [np.full(len(depth), part, np.int32), *lanes, depth, *sides, chars, n_convs, least, last]
        names = [f.split()[0] for f in NODE.split(",")]
        return pa.RecordBatch.from_arrays([*map(pa.array, map(np.ascontiguousarray, columns)), pa.array(ends, pa.binary())], names=names)

    if len(n["depth"]):
        yield batch(*(n[c] for c in ("key", "parent", "depth", "digest", "chars", "n_convs", "least", "last", "ends")))
    if "closing" in n:  # a row that only closes: no member is counted by it
        x, none = n["closing"], np.zeros((1, 2), np.uint64)
        yield batch(x["key"], none, x["depth"], none, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, np.iinfo(np.int64).max), np.zeros(1, bool), x["ends"])


def per_shard(ranged: DataFrame, function, schema: str) -> DataFrame:
    """``function(part, table) -> batches`` over each range of rows as one bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from function(table.column("part")[0].as_py(), table)

    return ranged.mapInArrow(run, schema)


def carries(ranged: DataFrame, borrow: Borrow, seed: int) -> dict[int, Carry]:
    """Carry of each shard. One short row per shard and pass reaches the driver."""
    limit = borrow.limit - 1

    def borders(part: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        conv = table.column("conv_id").to_numpy()
        first, last = int(conv[0]), int(conv[-1])
        base = int(borrow.base(conv[-1:])[0])
        at = np.flatnonzero(conv == base)[:limit]
        head = table.select(["digest", "chars"]).take(pa.array(at))
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "first": first, "last": last, "rows": int((conv == last).sum()), "digests": head.column("digest").to_pylist(), "chars": head.column("chars").to_pylist()}],
            schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("rows", pa.int64()), ("digests", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64()))]),
        )

    columns = ["part", "conv_id", "digest", "chars"]
    found = per_shard(ranged.select(columns), borders, "part int, first long, last long, rows long, digests array<binary>, chars array<long>").collect()
    found.sort(key=lambda r: r.part)
    out: dict[int, Carry] = {}
    last, base, rows, head = None, None, 0, []
    base_of = lambda c: int(borrow.base(np.array([c]))[0])
    for r, following in zip(found, [*found[1:], None]):
        carry = out[r.part] = Carry(rows if r.first == last else 0, (0, 0), head if base_of(r.first) == base else [], following is not None and following.first == r.last)
        own = [(bytes(d), n) for d, n in zip(r.digests, r.chars)]
        head = (carry.head if base_of(r.last) == base else []) + own
        head, rows = head[:limit], r.rows + (carry.rows if r.last == r.first else 0)
        last, base = r.last, base_of(r.last)
    if not any(c.rows for c in out.values()):
        return out
    shared = ranged.sparkSession.sparkContext.broadcast(out)

    def sums(part: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        # without the sums of earlier shards: those are added on the driver
        shard = Shard(table, shared.value[part], borrow, seed)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array(shard.sums[-1:, k].view(np.int64)) for k in (0, 1)]], names=["part", "s1", "s2"])

    lanes = {r.part: (r.s1 & (1 << 64) - 1, r.s2 & (1 << 64) - 1) for r in per_shard(ranged.select(columns), sums, "part int, s1 long, s2 long").collect()}
    state = (0, 0)
    for r in found:
        carry = out[r.part]
        carry.sums = state if carry.rows else (0, 0)
        onward = carry.sums if r.first == r.last else (0, 0)
        state = (lanes[r.part][0] ^ onward[0], lanes[r.part][1] ^ onward[1])
    return out


def same_key(a: str, b: str, left: list[str] = KEY, right: list[str] = KEY) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{x}") == F.col(f"{b}.{y}") for x, y in zip(left, right)])


def accumulate(rows: dict[str, np.ndarray], extra: tuple[int, int] = (0, 0), orphan_parent: int | None = None) -> dict[str, np.ndarray]:
    """Sums over the subtrees of one shard: flat arrays by slot, deepest nodes first.

    ``extra`` comes from the later part of the last conversation; ``orphan_parent`` is the
    conversation of the one node whose parent is in an earlier shard.
    """
    n = len(rows["depth"])
    rank, first = slots(np.concatenate((rows["k1"], rows["p1"])), np.concatenate((rows["k2"], rows["p2"])))
    slot_of = np.full(len(first), -1)
    slot_of[rank[:n]] = np.arange(n)
    parent = np.where(rows["depth"] > 0, slot_of[rank[n:]], -1)
    leaves, saved = (rows["own"] & rows["leaf"]).astype(np.int64), np.where(rows["own"], rows["weight"], 0)
    last = np.flatnonzero(rows["last"])
    leaves[last] += extra[0]
    saved[last] += extra[1]
    order = np.argsort(-rows["depth"], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(rows["depth"][order])) + 1):
        up = level[parent[level] >= 0]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    orphan = (parent < 0) & (rows["depth"] > 0)
    above = np.where(parent >= 0, rows["conv_id"][parent], -1 if orphan_parent is None else orphan_parent)
    return {"leaves": leaves, "saved": saved, "parent_conv": above, "has_parent": rows["own"] & (rows["depth"] > 0), "orphan": orphan}


BACK = ["k1", "k2", "p1", "p2", "depth", "conv_id", "own", "weight", "leaf", "last"]


def arrays(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in BACK}


def borders_of(back: DataFrame) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """What each shard gets from later ones, and the parent conversation of its orphan."""

    def summary(table: pa.Table) -> pa.Table:
        rows = arrays(table)
        found = accumulate(rows)
        orphan, last = found["orphan"], rows["last"]
        # a shard within one conversation hands on what it gets itself
        whole = bool(orphan.any()) and not (rows["depth"] == 0).any()
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "orphan": [bool(orphan.any())], "whole": [whole],
            "leaves": pa.array([int(found["leaves"][orphan].sum())], pa.int64()), "saved": pa.array([int(found["saved"][orphan].sum())], pa.int64()),
            "last": pa.array([int(rows["conv_id"][last][0]) if last.any() else None], pa.int64()),
        })

    found = back.groupBy("part").applyInArrow(summary, "part int, orphan boolean, whole boolean, leaves long, saved long, last long").collect()
    found.sort(key=lambda r: r.part)
    extra, parents, state = {}, {}, (0, 0)
    for r in reversed(found):
        extra[r.part] = state
        handed = state if r.whole else (0, 0)
        state = (r.leaves + handed[0], r.saved + handed[1]) if r.orphan else (0, 0)
    before = None
    for r in found:
        if r.orphan:
            parents[r.part] = before
        before = r.last if r.last is not None else before
    return extra, parents


def ends_digest(local: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of a node's listed conversations, as one stream.

    A shard gives a node one row, its ids in order; shards of a node follow each other, so
    a task reads the ids once and holds those of one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for k1, k2, ends in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ends"))):
                text = ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode()
                if key == (k1, k2):
                    state.update(b"," + text)
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(text)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), d)) for d in done])
                done = []
        if key is not None:
            done.append((*key, state.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), d)) for d in done])

    rows = local.where("ends IS NOT NULL").select(*KEY, "part", F.col("ends")).repartition(*KEY).sortWithinPartitions(*KEY, "part")
    return rows.select(*KEY, "ends").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, borrow: Borrow | None = None, seed: int = 0, rows_per_shard: int = 1 << 18,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node stands for the distinct sequence of (role, text) of first turns; conv_id is its
    smallest member, n_convs counts members, saved_tokens adds up, over its subtree,
    members but one times code points of the last text. Turns stand in the order of their
    number, null first, equal numbers in the order of their digests; null role or text is
    empty; repeated rows are turns of their own. With ``borrow``, conversations first take
    over turns of the first of their group (remainders are never negative). Rows without a
    conversation id belong to no conversation. An empty table gives an empty result. Other
    columns are not read.
    """
    borrow = borrow or Borrow(1, 1)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    said = F.concat(F.octet_length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col))
    turns = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, DIGEST).alias("digest"), F.length(text(text_col)).cast("long").alias("chars"),
    )
    ranged = range_parts(turns, ["conv_id", "turn", "digest"], rows_per_shard)
    shared = ranged.sparkSession.sparkContext.broadcast(carries(ranged, borrow, seed))

    def local_nodes(part: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from node_batch(part, Shard(table, shared.value[part], borrow, seed).nodes())

    local = materialize(per_shard(ranged.select("part", "conv_id", "digest", "chars"), local_nodes, NODE))
    met = local.where("n_convs > 0")
    said_once = F.struct(*PARENT, "depth", "d1", "d2", "chars")
    grouped = met.groupBy(*KEY).agg(F.sum("n_convs").alias("n_convs"), F.min("least").alias("conv_id"), F.min(said_once).alias("a"), F.max(said_once).alias("b"))
    clash = F.raise_error(F.lit("two sequences of turns have one digest; choose another seed")).cast("long")
    nodes = materialize(grouped.select(*KEY, "conv_id", "a.p1", "a.p2", "a.depth", "a.chars", F.when(F.col("a") == F.col("b"), F.col("n_convs")).otherwise(clash).alias("n_convs")))
    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.alias("n").join(children.alias("c"), same_key("n", "c", KEY, PARENT), "left").select(
        *[f"n.{c}" for c in (*KEY, "conv_id", "depth", "n_convs", "chars")], F.coalesce("c.n_children", F.lit(0)).alias("n_children")
    )
    known = materialize(known)
    weight = ((F.col("k.n_convs") - 1) * F.col("k.chars")).alias("weight")
    back = met.alias("l").join(known.alias("k"), same_key("l", "k")).select(
        "l.part", *[f"l.{c}" for c in (*KEY, *PARENT, "depth")], "k.conv_id", (F.col("l.least") == F.col("k.conv_id")).alias("own"),
        weight, (F.col("k.n_children") == 0).alias("leaf"), "l.last",
    )
    back = materialize(back)
    extra, parents = borders_of(back)
    handed = ranged.sparkSession.sparkContext.broadcast((extra, parents))

    def sums(table: pa.Table) -> pa.Table:
        rows, part = arrays(table), table.column("part")[0].as_py()
        found = accumulate(rows, handed.value[0][part], handed.value[1].get(part))
        above = pa.array(found["parent_conv"], pa.int64(), mask=~found["has_parent"])
        return pa.table({"k1": rows["k1"], "k2": rows["k2"], "leaves": found["leaves"], "saved": found["saved"], "parent_conv_id": above})

    partial = back.groupBy("part").applyInArrow(sums, "k1 long, k2 long, leaves long, saved long, parent_conv_id long")
    totals = partial.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("parent_conv_id").alias("parent_conv_id"))
    joined = known.join(totals, KEY).join(ends_digest(local), KEY, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
