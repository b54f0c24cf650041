"""Language-model scores by context-tree weighting of bytes.

A byte is eight binary decisions; each decision has a context tree over the bytes before
it, nearest first. A node of a tree holds the zeros and ones seen in its context and the
Krichevsky-Trofimov probability of that sequence; the weighted probability of a node mixes
this estimate with the product over its children in equal parts, down to ``DEPTH`` bytes.
A decision is then predicted by the estimates on its path, weighted by what each node
gained in training. Everything is exact; nothing is pruned.

As Spark jobs: blocks of documents send their distinct (context, byte) strings with
training counts, compressed, grouped by the two nearest bytes of the context; groups are
summed in a tree of aggregations of bounded fan-in; each group computes its subtrees, the
two levels above (at most 256 contexts of 255 decisions) are combined once; log
probabilities return to the blocks that asked, in the order of their strings, and blocks
score their texts. Word counts for the unigram baseline take the same way. Nothing that
grows with the corpus is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textjudge.llm.common import id_and_text, in_blocks, width
from textjudge.llm.packed import squeeze, unsqueeze
from textjudge.llm.shingles import batches, mixed, word_hashes
from textjudge.operators.lineage import stored

#: bytes of context; contexts and the byte itself are one number of DEPTH + 1 bytes
DEPTH = 6
#: begin and end of a text: no byte of UTF-8
MARK = 0xFF
#: packed lists that one aggregation task sums, and blocks that one lookup task answers
FAN_IN, FAN_OUT = 64, 256
BLOCKS_PER_RANGE = 16
WORDS, GRAMS = 0, 1


def canonical(text: bytes) -> bytes:
    """Lower-case words with one space between."""
    return b" ".join(text.lower().split())


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series above ten."""
    x = np.asarray(x, float)
    small = x < 10
    product = np.ones_like(x)
    for k in range(10):
        product = np.where(small, product * (x + k), product)
    z = np.where(small, x + 10, x)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the weight of the node's own estimate."""
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class Tree:
    """Context trees below contexts of ``top`` bytes, from sorted (context, byte) numbers.

    Context bytes come nearest first, so all numbers of a subtree are neighbours.
    """

    def __init__(self, values: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 2):
        self.depth, self.top = depth, top
        # entries of each depth: distinct (context, byte), counts, and the entry above
        self.entries = {depth: (values, counts)}
        self.above: dict[int, np.ndarray] = {}
        for d in range(depth - 1, top - 1, -1):
            inner, n = self.entries[d + 1]
            # drop the farthest context byte, just left of the coded byte
            shorter = (inner >> np.uint64(16) << np.uint64(8)) | (inner & np.uint64(255))
            outer, self.above[d + 1] = np.unique(shorter, return_inverse=True)
            self.entries[d] = outer, np.bincount(self.above[d + 1], weights=n, minlength=len(outer))
        self.nodes = {(d, level): self._node(d, level) for d in self.entries for level in range(8)}
        self.total: dict[tuple[int, int], np.ndarray] = {}
        self.weight: dict[tuple[int, int], np.ndarray] = {}
        for level in range(8):
            for d in range(depth, top - 1, -1):
                group, first, zeros, ones = self.nodes[d, level]
                own = log_kt(zeros, ones)
                if d == depth:
                    self.total[d, level], self.weight[d, level] = own, np.ones_like(own)
                    continue
                child_first = self.nodes[d + 1, level][1]
                parent = group[self.above[d + 1][child_first]]
                children = np.bincount(parent, weights=self.total[d + 1, level], minlength=len(first))
                self.total[d, level], self.weight[d, level] = weighted(own, children)

    def _node(self, d: int, level: int):
        """Node of each entry, first entry of each node, zeros and ones of each node."""
        values, counts = self.entries[d]
        key = values >> np.uint64(8 - level)
        new = changes(key)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        bit = (values >> np.uint64(7 - level)) & np.uint64(1)
        ones = np.bincount(group, weights=counts * bit, minlength=len(first))
        return group, first, np.bincount(group, weights=counts, minlength=len(first)) - ones, ones

    def roots(self) -> list[tuple[np.ndarray, ...]]:
        """Per level: (context, decision, zeros, ones, ln weighted) of the top nodes."""
        out = []
        for level in range(8):
            _, first, zeros, ones = self.nodes[self.top, level]
            values = self.entries[self.top][0][first]
            out.append((values >> np.uint64(8), decision(values, level), zeros, ones, self.total[self.top, level]))
        return out

    def log10(self, upper: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 of the probability of each byte in its context.

        ``upper``: (own weight, probability of one) by context and decision, for the
        levels above ``top``, the root first.
        """
        values, _ = self.entries[self.depth]
        out = np.zeros(len(values))
        for level in range(8):
            bit = ((values >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
            entry = np.arange(len(values))
            mix = None
            for d in range(self.depth, self.top - 1, -1):
                if d < self.depth:
                    entry = self.above[d + 1][entry]
                group, _, zeros, ones = self.nodes[d, level]
                node = group[entry]
                one = ((ones + 0.5) / (zeros + ones + 1))[node]
                own = self.weight[d, level][node]
                mix = one if mix is None else own * one + (1 - own) * mix
            for d in range(self.top - 1, -1, -1):
                context = (values >> np.uint64(8 * (self.depth + 1 - d))).astype(np.int64) if d else np.zeros(len(values), np.int64)
                at = context, decision(values, level).astype(np.int64)
                own, one = upper[d][0][at], upper[d][1][at]
                mix = own * one + (1 - own) * mix
            out += np.log10(np.where(bit, mix, 1 - mix))
        return out


def decision(values: np.ndarray, level: int) -> np.ndarray:
    """Number of the binary decision: a one, then the bits of the byte decided so far."""
    return np.uint64(1 << level) | ((values & np.uint64(255)) >> np.uint64(8 - level))


def upper_levels(rows: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and predictions of the root and of the contexts of one byte.

    ``rows``: (context byte, decision, zeros, ones, ln weighted of the children), at most
    256 x 255 of them.
    """
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    for r in rows:
        at = int(r[0]), int(r[1])
        zeros[at], ones[at], below[at] = r[2], r[3], r[4]
    both, own = weighted(log_kt(zeros, ones), below)
    first = own, (ones + 0.5) / (zeros + ones + 1)
    zeros, ones, below = zeros.sum(0, keepdims=True), ones.sum(0, keepdims=True), both.sum(0, keepdims=True)
    _, own = weighted(log_kt(zeros, ones), below)
    return [(own, (ones + 0.5) / (zeros + ones + 1)), first]


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) numbers of all bytes of canonical texts, and the count per text.

    The end of a text is coded too; contexts before its begin are filled with marks.
    """
    pad = bytes([MARK]) * depth
    data = np.frombuffer(b"".join(pad + t for t in texts) + pad, np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.zeros(len(data) - depth, np.uint64)
    for back in range(1, depth + 1):
        codes |= data[depth - back : len(data) - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    codes |= data[depth:]
    # each text has ``depth`` marks before it: its first is the end of the text before
    starts = np.cumsum(lengths + depth - 1) - (lengths + depth - 1)
    place = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return codes[place], lengths


def changes(ordered: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting; ``np.unique`` hashes them, which takes ten times as long."""
    ordered = np.sort(values)
    return ordered[changes(ordered)]


def summed(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their summed counts; sorted lists are merged."""
    joined = np.concatenate(values)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    new = changes(ordered)
    return ordered[new], np.bincount(np.cumsum(new) - 1, weights=np.concatenate(counts)[order], minlength=int(new.sum()))


def counted(values: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct values, and how often each occurs in training."""
    seen, n = np.unique(values[training], return_counts=True)
    other = distinct(values[~training])
    return summed([seen, other], [n, np.zeros(len(other))])


class Sums:
    """Counts of sorted lists, summed whenever what waits outgrows the sum."""

    def __init__(self):
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.lists.append((values, counts))
        self.waiting += len(values)
        if self.waiting > max(1 << 20, len(self.lists[0][0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.uint64), np.empty(0)
        self.lists = [summed(*zip(*self.lists or [none]))]
        self.waiting = 0
        return self.lists[0]


class Part:
    """Words and byte grams of some documents of a block, about a megabyte of text."""

    def __init__(self, texts: list[bytes], train: np.ndarray, depth: int):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, self.words = word_hashes(data)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.n_words = np.diff(bounds)
        self.grams, self.n_grams = grams(texts, depth)
        self.training = np.repeat(train, self.n_words), np.repeat(train, self.n_grams)

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return counted(self.words if kind == WORDS else self.grams, self.training[kind])


def parts(table: pa.Table, depth: int) -> Iterator[Part]:
    train = np.array(table.column("train").to_pylist(), bool)
    done = 0
    for texts in batches(canonical(t.as_py().encode()) for t in table.column("text")):
        yield Part(texts, train[done : done + len(texts)], depth)
        done += len(texts)


def range_of(kind: int, values: np.ndarray, ranges: int, depth: int) -> np.ndarray:
    """Words by their hash; grams by the two nearest bytes, so that subtrees stay whole."""
    key = values if kind == WORDS else mixed(values >> np.uint64(8 * (depth - 1)))
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def by_range(kind: int, values: np.ndarray, ranges: int, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places of its values) of sorted values; ranges without values are left out."""
    place = range_of(kind, values, ranges, depth)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(ranges + 1)).tolist()
    return ((k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def held_out(id_col: Column) -> Column:
    """Rows that are not learnt from: rest two by seven, or no id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(True))


def merged_counts(sent: DataFrame, blocks: int) -> DataFrame:
    """range, values, counts: squeezed lists of all blocks, summed in groups of bounded size."""

    def add(table: pa.Table) -> pa.Table:
        values, counts = summed([unsqueeze(v.as_py()) for v in table.column("values")], [unsqueeze(c.as_py()) for c in table.column("counts")])
        first = [table.column(c)[0].as_py() for c in ("range", "part")]
        return pa.table({
            "range": pa.array([first[0]], pa.int32()), "part": pa.array([first[1]], pa.int32()),
            "values": pa.array([squeeze(values)], pa.binary()), "counts": pa.array([squeeze(counts.astype("<u8"))], pa.binary()),
        })

    rows = sent.select("range", F.col("block").alias("part"), "values", "counts")
    while blocks > 1:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        rows = rows.groupBy("range", "part").applyInArrow(add, "range int, part int, values binary, counts binary")
        blocks = math.ceil(blocks / FAN_IN)
    return rows.select("range", "values", "counts")


def gram_model(model: DataFrame, depth: int) -> DataFrame:
    """range, values, logs: log10 probability of each gram of ``model``."""

    def roots(table: pa.Table) -> pa.Table:
        out = []
        for v, c in zip(table.column("values"), table.column("counts")):
            for context, number, zeros, ones, total in Tree(unsqueeze(v.as_py()), unsqueeze(c.as_py()).astype(float), depth).roots():
                near = (context >> np.uint64(8)) << np.uint64(8) | number
                keys, index = np.unique(near, return_inverse=True)
                add = [np.bincount(index, weights=x, minlength=len(keys)) for x in (zeros, ones, total)]
                out.append((keys, *add))
        columns = [np.concatenate([o[k] for o in out]) for k in range(4)]
        return pa.table({
            "context": pa.array((columns[0] >> np.uint64(8)).astype(np.int32)), "number": pa.array((columns[0] & np.uint64(255)).astype(np.int32)),
            "zeros": columns[1], "ones": columns[2], "below": columns[3],
        })

    tops = model.groupBy("range").applyInArrow(roots, "context int, number int, zeros double, ones double, below double")
    # at most 256 contexts x 255 decisions
    tops = tops.groupBy("context", "number").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()
    upper = model.sparkSession.sparkContext.broadcast(upper_levels(tops))

    def logs(table: pa.Table) -> pa.Table:
        found = [Tree(unsqueeze(v.as_py()), unsqueeze(c.as_py()).astype(float), depth).log10(upper.value) for v, c in zip(table.column("values"), table.column("counts"))]
        return pa.table({"range": table.column("range"), "values": table.column("values"), "logs": pa.array([squeeze(x.astype("<f8")) for x in found], pa.binary())})

    return model.groupBy("range").applyInArrow(logs, "range int, values binary, logs binary")


def score_texts(docs: DataFrame, depth: int = DEPTH, block_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the unigram baseline and the context-tree score.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte. A text is its lower-case (A-Z) words with one space between, and an
    end; both models score the same sequence. Null and empty texts are the end alone. Rows
    without an id are not learnt from. Repeated rows count and are scored one by one. With
    no training rows every decision is a coin toss. An empty table gives an empty result;
    other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumn("train", ~held_out(F.col("doc_id")))
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    blocks, n_blocks = in_blocks(rows, block_bytes, "train")
    ranges = max(width(docs), math.ceil(n_blocks / BLOCKS_PER_RANGE))

    def send(table: pa.Table) -> pa.Table:
        found = [Sums() for _ in (WORDS, GRAMS)]
        for part in parts(table, depth):
            for kind in (WORDS, GRAMS):
                found[kind].add(*part.keys(kind))
        out = []
        for kind in (WORDS, GRAMS):
            values, counts = found[kind].total()
            for k, at in by_range(kind, values, ranges, depth):
                out.append((kind, k, squeeze(values[at]), squeeze(counts[at].astype("<u8"))))
        number = table.column("block")[0].as_py()
        return pa.table({
            "block": pa.array([number] * len(out), pa.int32()), "kind": pa.array([r[0] for r in out], pa.int32()), "range": pa.array([r[1] for r in out], pa.int32()),
            "values": pa.array([r[2] for r in out], pa.binary()), "counts": pa.array([r[3] for r in out], pa.binary()),
        })

    sent = stored(blocks.groupBy("block").applyInArrow(send, "block int, kind int, range int, values binary, counts binary"))

    def answer_words(table: pa.Table) -> pa.Table:
        values = [unsqueeze(v.as_py()) for v in table.column("values")]
        known, total = summed(values, [unsqueeze(c.as_py()) for c in table.column("counts")])
        found = [squeeze(total[np.searchsorted(known, v)].astype("<f8")) for v in values]
        size = len(found)
        first = [True] + [False] * (size - 1)
        return pa.table({
            "block": table.column("block"), "kind": pa.array([WORDS] * size, pa.int32()), "range": table.column("range"), "answer": pa.array(found, pa.binary()),
            "known": pa.array([int((total > 0).sum()) * f for f in first], pa.int64()), "seen": pa.array([int(total.sum()) * f for f in first], pa.int64()),
        })

    words = sent.where(F.col("kind") == WORDS).select("block", "range", "values", "counts")
    words = stored(words.groupBy("range").applyInArrow(answer_words, "block int, kind int, range int, answer binary, known long, seen long"))
    known, seen = words.agg(F.sum("known"), F.sum("seen")).first()
    ends = rows.where("train").count()
    total, kinds = (seen or 0) + ends, (known or 0) + (ends > 0)

    asked = sent.where(F.col("kind") == GRAMS).select("block", "range", "values", "counts")
    model = stored(gram_model(stored(merged_counts(asked, n_blocks)), depth))

    def answer_grams(left: pa.Table, right: pa.Table) -> pa.Table:
        values = unsqueeze(right.column("values")[0].as_py())
        logs = unsqueeze(right.column("logs")[0].as_py(), "<f8")
        found = [squeeze(logs[np.searchsorted(values, unsqueeze(v.as_py()))]) for v in left.column("values")]
        return pa.table({
            "block": left.column("block"), "kind": pa.array([GRAMS] * len(found), pa.int32()), "range": left.column("range"), "answer": pa.array(found, pa.binary()),
        })

    part = F.floor(F.col("block") / FAN_OUT).cast("int")
    asking = asked.select("block", "range", "values", part.alias("part")).groupBy("range", "part")
    copies = model.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((n_blocks - 1) // FAN_OUT)))).groupBy("range", "part")
    byte_answers = asking.cogroup(copies).applyInArrow(_when_asked(answer_grams), "block int, kind int, range int, answer binary")
    answers = words.select("block", "kind", "range", "answer").union(byte_answers)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        # the block knows which words and grams it asked for, in order
        asked_for = [Sums() for _ in (WORDS, GRAMS)]
        for part in parts(left, depth):
            for kind, values in ((WORDS, part.words), (GRAMS, part.grams)):
                own = distinct(values)
                asked_for[kind].add(own, np.ones(len(own)))
        keys = [s.total()[0] for s in asked_for]
        tables = [(keys[kind], answered(right, kind, keys[kind], ranges, depth)) for kind in (WORDS, GRAMS)]
        scale = math.log10(total + kinds + 1)
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        for part in parts(left, depth):
            counts, logs = looked_up(*tables[WORDS], part.words), looked_up(*tables[GRAMS], part.grams)
            n_tokens = part.n_words + 1
            base = sums(np.log10(counts + 1), part.n_words) + math.log10(ends + 1) - n_tokens * scale
            n_known = sums((counts > 0).astype(float), part.n_words).round().astype(np.int64) + (ends > 0)
            for c, x in zip(columns, (n_tokens, n_known, base, sums(logs, part.n_grams), part.n_grams)):
                c.append(x)
        n_tokens, n_known, base, score, n_bytes = map(np.concatenate, columns)
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": pa.array([not t for t in left.column("train").to_pylist()], pa.bool_()),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * len(score), pa.int64()),
            "base_score": base, "score": score, "n_bytes": pa.array(n_bytes, pa.int64()), "bits_per_byte": -score / math.log10(2) / n_bytes,
        })

    schema = (
        f"doc_id {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "n_bytes long, bits_per_byte double"
    )
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def answered(answers: pa.Table, kind: int, values: np.ndarray, ranges: int, depth: int) -> np.ndarray:
    """What was answered for the sorted words or grams of a block; each range in their order."""
    columns = answers.column("kind").to_pylist(), answers.column("range").to_pylist(), answers.column("answer")
    rows = {k: a for of, k, a in zip(*columns) if of == kind}
    found = np.empty(len(values))
    for k, at in by_range(kind, values, ranges, depth):
        found[at] = unsqueeze(rows[k].as_py(), "<f8")
    return found


def looked_up(keys: np.ndarray, found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``found`` of each value; sorted ones are searched, as others miss the cache at each step."""
    own, index = np.unique(values, return_inverse=True)
    return found[np.searchsorted(keys, own)][index]


def _when_asked(function):
    """A part of the blocks that has no row for a range asks nothing."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            return function(left, right)
        empty = pa.array([], pa.int32())
        return pa.table({"block": empty, "kind": empty, "range": empty, "answer": pa.array([], pa.binary())})

    return run
