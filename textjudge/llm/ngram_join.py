"""Exact Jaccard self-join of word-shingle sets: a size-aware heavy-light join.

**Sharing.** Only shingles that some other document has can be in an overlap, and a linked
document shares at least three quarters of its set. Blocks of documents send the sorted
40-bit prefixes of their shingles, delta-coded, to ranges of the hash space; each range
answers in how many blocks a prefix occurs. Documents with too few shared shingles have no
link. (A chance collision of prefixes only keeps a document longer.)

**Light sets.** Two sets of sizes a and b are linked exactly if they share a subset of the
size of the required overlap. Small sets enumerate these subsets; all who meet at one are
linked without any comparison and without listing pairs.

**Heavy sets.** Larger sets put their rarest shared shingles (the shortest list that must
meet any partner) into inverted lists. Lists are scanned in rounds: each member is compared
with one pivot, linked members merge, and at the end all pairs of one list that are still
in different components are compared exactly. No pair is dropped, and a large group of
near copies is linked through its pivots.

The boundary between light and heavy is the size with the least total cost, the number of
enumerated subsets against the lists to scan and the sets to compare.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textjudge.llm.common import id_and_text, in_blocks, width
from textjudge.llm.components import components
from textjudge.llm.packed import pack_sorted, unpack_sorted
from textjudge.llm.shingles import mixed, shingle_sets
from textjudge.operators.lineage import materialize, stored

#: bits of a shingle that are compared between blocks, and blocks answered by one range
PREFIX_BITS, BLOCKS_PER_RANGE = 40, 16
#: largest set size for which enumerating subsets is considered at all
MOST_LIGHT = 16


def required(a: int, b: int) -> int:
    """Least overlap of linked sets: 100 * i >= 75 * (a + b - i)."""
    return -(-3 * (a + b) // 7)


def partners(n: int) -> range:
    """Sizes that a set of size ``n`` can be linked with."""
    return range(-(-3 * n // 4), 4 * n // 3 + 1)


def block_sets(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sets of the documents of a block; its distinct prefixes and how many sets have each."""
    sets = shingle_sets([(t.as_py() or "").encode() for t in table.column("text")])
    every = np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - PREFIX_BITS)
    return sets, *np.unique(every, return_counts=True)


def shared_sets(docs: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id, n, digests of the set, shared shingles (rarest first) and their needed prefix.

    ``tokens`` is null for documents that cannot have a link.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks, n_blocks = in_blocks(docs, block_bytes)
    ranges = max(width(docs), math.ceil(n_blocks / BLOCKS_PER_RANGE))
    edges = np.array([(k << PREFIX_BITS) // ranges for k in range(ranges + 1)], np.uint64)

    def send(table: pa.Table) -> pa.Table:
        _, distinct, _ = block_sets(table)
        cuts = np.searchsorted(distinct, edges).tolist()
        rows = [(k, pack_sorted(distinct[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        block = table.column("block")[0].as_py()
        return pa.table({"range": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "values": pa.array([r[1] for r in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(v.as_py()) for v in table.column("values")]
        distinct, index, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        levels = np.minimum(counts, 255).astype(np.uint8)[index]
        cuts = np.cumsum([0, *map(len, parts)]).tolist()
        answers = [levels[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.table({"block": table.column("block"), "range": table.column("range"), "levels": pa.array(answers, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, distinct, counts = block_sets(left)
        answers = right.sort_by("range").column("levels")
        levels = np.frombuffer(b"".join(a.as_py() for a in answers), np.uint8)
        common = (levels > 1) | (counts > 1)
        out: list[tuple] = []
        for s in sets:
            n, need = len(s), -(-3 * len(s) // 4)
            place = np.searchsorted(distinct, s >> np.uint64(64 - PREFIX_BITS))
            kept = s[common[place]] if n else s
            digest = mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
            if not n or len(kept) < need:
                out.append((n, *digest, None, 0))
                continue
            rank = np.lexsort((kept, levels[place[common[place]]]))
            out.append((n, *digest, kept[rank].view(np.int64), len(kept) - need + 1))
        offsets = pa.array(np.cumsum([0, *(0 if r[3] is None else len(r[3]) for r in out)]), pa.int32())
        values = pa.array(np.concatenate([np.empty(0, np.int64), *(r[3] for r in out if r[3] is not None)]))
        missing = pa.array([r[3] is None for r in out], pa.bool_())
        signed = [np.array([r[k] for r in out], np.uint64).view(np.int64) for k in (1, 2)]
        return pa.table({
            "doc_id": left.column("doc_id"), "n": pa.array([r[0] for r in out], pa.int32()), "digest": pa.array(signed[0]), "digest2": pa.array(signed[1]),
            "tokens": pa.ListArray.from_arrays(offsets, values, mask=missing), "needed": pa.array([r[4] for r in out], pa.int32()),
        })

    sent = blocks.groupBy("block").applyInArrow(send, "range int, block int, values binary")
    answers = sent.groupBy("range").applyInArrow(answer, "block int, range int, levels binary")
    schema = f"doc_id {kind}, n int, digest long, digest2 long, tokens array<long>, needed int"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def light_boundary(sets: DataFrame) -> int:
    """The size up to which sets enumerate subsets, by total cost.

    A subset costs one row; an entry of a list costs one row and a comparison of two sets,
    which reads as many shingles as a set has. At most ``MOST_LIGHT`` rows reach the driver.
    """
    small = sets.where(F.col("n") <= MOST_LIGHT)
    lists = small.select("n", F.explode(F.slice("tokens", 1, F.col("needed"))).alias("token"))
    lengths = lists.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *[F.count(F.when(F.col("n") == k, 1)).alias(f"s{k}") for k in range(1, MOST_LIGHT + 1)])
    scan = lengths.agg(*[F.sum(F.col("df") * F.col(f"s{k}")).alias(f"s{k}") for k in range(1, MOST_LIGHT + 1)]).first()
    shared = small.groupBy("n", F.size("tokens").alias("m")).agg(F.count(F.lit(1)).alias("sets")).collect()
    subsets = dict.fromkeys(range(1, MOST_LIGHT + 1), 0)
    for r in shared:
        subsets[r["n"]] += r["sets"] * sum(math.comb(r["m"], required(r["n"], b)) for b in partners(r["n"]))
    costs = [sum(subsets[k] for k in range(1, x + 1)) + sum((k + 1) * (scan[f"s{k}"] or 0) for k in range(x + 1, MOST_LIGHT + 1)) for x in range(MOST_LIGHT + 1)]
    return costs.index(min(costs))


def subset_links(sets: DataFrame, light: int) -> DataFrame:
    """Edges (u, v) among the sets that meet at a common subset of the required size."""
    kind = sets.schema["doc_id"].dataType.simpleString()
    if not light:
        return sets.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).limit(0)

    def enumerate_(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows: list[tuple] = []
            for k, (n, tokens) in enumerate(zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist())):
                values = mixed(np.array(sorted(tokens), np.int64).view(np.uint64)).tolist()
                for b in partners(n):
                    if min(n, b) > light:
                        continue
                    tag = min(n, b) * 1000 + max(n, b)
                    for chosen in itertools.combinations(values, required(n, b)):
                        rows.append((k, n <= b, tag, _signed(sum(chosen)), _signed(sum(x * x | 1 for x in chosen))))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int32()),
                pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()),
            ], names=["doc_id", "smaller", "tag", "key", "key2"])

    near = sets.where(F.col("n") <= 4 * light // 3).select("doc_id", "n", "tokens")
    keys = near.mapInArrow(enumerate_, f"doc_id {kind}, smaller boolean, tag int, key long, key2 long")
    at = ["tag", "key", "key2"]
    # two larger sets that meet need not be linked; with a smaller one in between they are
    meet = keys.groupBy(*at).agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("last"), F.max("smaller").alias("linked"))
    meet = meet.where("linked and v < last").drop("linked", "last")
    return keys.select("doc_id", *at).join(meet, at).select(F.col("doc_id").alias("u"), "v").where("u > v").distinct()


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (u, v, ...) whose sets overlap enough.

    ``sets`` lies partitioned by id: only the pairs move, the second time with one set.
    """
    left = sets.select(F.col("doc_id").alias("u"), F.col("n").alias("n_u"), F.col("tokens").alias("tokens_u"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("n").alias("n_v"), F.col("tokens").alias("tokens_v"))
    joined = pairs.join(left, "u").join(right, "v")
    overlap = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return joined.where(7 * overlap >= 3 * (F.col("n_u") + F.col("n_v"))).select(*pairs.columns)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after the components at the ends of ``links`` (of labels) became one."""
    moved = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stored(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def inverted(sets: DataFrame) -> DataFrame:
    """(doc_id, n, token, room): the inverted lists of the needed shingles.

    ``room`` is the number of shingles of the set from this one on, in the common order.
    """
    tokens = sets.select("doc_id", "n", F.size("tokens").alias("shared"), F.posexplode(F.slice("tokens", 1, F.col("needed"))).alias("place", "token"))
    return tokens.select("doc_id", "n", "token", (F.col("shared") - F.col("place")).alias("room"))


def reachable(n_u: str, room_u: str, n_v: str, room_v: str, light: int) -> Column:
    """Whether two sets of a list can be linked with its shingle as the first they share.

    The first common shingle leaves no more common ones than the shorter rest; every
    linked pair passes at its first common shingle, so nothing is lost.
    """
    enough = 7 * F.least(room_u, room_v) >= 3 * (F.col(n_u) + F.col(n_v))
    return enough & (F.greatest(n_u, n_v) > light)


def heavy_links(sets: DataFrame, labels: DataFrame, light: int) -> DataFrame:
    """``labels`` (node, label) with all links merged that involve a heavy set."""
    lists = inverted(sets.where(F.col("n") >= -(-3 * (light + 1) // 4)))
    order = [F.col("doc_id"), F.xxhash64("doc_id")]
    for key in order:
        named = with_labels(lists, labels)
        pivots = named.groupBy("token").agg(
            F.min_by(F.struct("doc_id", "n", "room", "label"), key).alias("p"), F.min("label").alias("least"), F.max("label").alias("most")
        ).where("least < most")
        pivots = pivots.select("token", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("n_p"), F.col("p.room").alias("room_p"), F.col("p.label").alias("label_p"))
        met = named.join(pivots, "token").where((F.col("label") != F.col("label_p")) & reachable("n", "room", "n_p", "room_p", light))
        # each set is compared with the pivot it meets most often
        often = met.groupBy("doc_id", "label", "pivot", "label_p").agg(F.count(F.lit(1)).alias("times"))
        best = often.groupBy("doc_id", "label").agg(F.max_by(F.struct("pivot", "label_p"), F.struct("times", "pivot")).alias("p"))
        pairs = best.select(F.col("doc_id").alias("u"), F.col("p.pivot").alias("v"), F.col("label").alias("label_u"), F.col("p.label_p").alias("label_v"))
        ok = links_of(pairs, sets)
        if ok.isEmpty():
            break
        labels = merged(labels, ok)
        lists = stored(open_lists(lists, labels))
    ok = links_of(materialize(open_pairs(lists, labels, light)), sets)
    return labels if ok.isEmpty() else merged(labels, ok)


def with_labels(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id")


def links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): the labels of the pairs whose sets overlap enough."""
    return stored(verified(pairs, sets).select(F.col("label_u").alias("u"), F.col("label_v").alias("v")).distinct())


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose members are not yet in one component."""
    found = with_labels(lists, labels).groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    return lists.join(found.where("least < most").select("token"), "token")


def open_pairs(lists: DataFrame, labels: DataFrame, light: int) -> DataFrame:
    """All pairs of a list whose components differ; pairs inside a component never arise."""
    named = with_labels(lists, labels)
    # nothing of a label can meet what needs more room than its best member has
    groups = named.groupBy("token", "label").agg(F.min("n").alias("low"), F.max("room").alias("room"))
    mixed_ = groups.groupBy("token").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token")
    groups = groups.join(mixed_, "token")
    other = groups.select("token", F.col("label").alias("label_v"), F.col("low").alias("low_v"), F.col("room").alias("room_v"))
    near = (F.col("label") > F.col("label_v")) & reachable("low", "room", "low_v", "room_v", 0)
    crossed = groups.join(other, "token").where(near).select("token", "label", "label_v")
    left = named.select("token", "label", F.col("doc_id").alias("u"), F.col("n").alias("n_u"), F.col("room").alias("room_u"))
    right = named.select("token", F.col("label").alias("label_v"), F.col("doc_id").alias("v"), F.col("n").alias("n_v"), F.col("room").alias("room_v"))
    pairs = crossed.join(left, ["token", "label"]).join(right, ["token", "label_v"])
    pairs = pairs.where(reachable("n_u", "room_u", "n_v", "room_v", light))
    return pairs.select("u", "v", F.col("label").alias("label_u"), "label_v").distinct()


def near_duplicate_components(docs: DataFrame, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Sets of distinct five-word shingles are linked at Jaccard 0.75 or more; the component
    is named by its smallest doc_id. Null and empty texts have no shingles and are linked
    with nothing; texts of one to four words are one shingle. Rows that share an id are
    one document with all their links; rows without an id are linked with nothing. An
    empty table gives an empty result; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    found = stored(shared_sets(rows, block_bytes).repartition(width(rows), "doc_id"))
    able = found.where("tokens is not null and doc_id is not null")
    same = ["n", "digest", "digest2"]
    first = able.groupBy(*same).agg(F.min("doc_id").alias("v"))
    copies = stored(able.select("doc_id", *same).join(first, same).select(F.col("doc_id").alias("u"), "v", *same))
    # the first of equal sets stands for them all; rows that repeat an id stand for each other
    chosen = copies.where("u = v").select(F.col("v").alias("doc_id"), F.col("digest").alias("_digest"), F.col("digest2").alias("_digest2")).distinct()
    sets = able.join(chosen, "doc_id").where("(digest ^ _digest) = 0 and (digest2 ^ _digest2) = 0")
    sets = sets.select("doc_id", "n", "tokens", "needed")
    light = light_boundary(sets)
    edges = copies.select("u", "v").where("u > v").union(subset_links(sets, light))
    start = components(edges)
    nodes = able.select(F.col("doc_id").alias("node")).distinct()
    labels = stored(nodes.join(start, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    labels = heavy_links(sets, labels, light)
    named = labels.where("node <> label")
    out = found.select("doc_id", "n").join(named, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns.

    Rows without an id and rows without words are linked with nothing and stay.
    """
    found = near_duplicate_components(docs, block_bytes, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.join(gone, F.col(f"c{names.index(id_col)}") == F.col("_gone"), "left_anti").toDF(*names)
