"""Merkle manifest of a table, and one proof per row by a recursive climb.

Rows are leaves. Leaves of a source stand in the order of their ids; every 16 neighbours
hash to the node above until one is left, the subroot of the source. Subroots, in the
order of the sources, hash to the root in the same way. Levels are built from below, each
by one aggregation in groups of at most 16, and stored as rows that name their parent: a
node row holds the digests of its children and where its own digest stands one level up.

A recursive query then climbs from every leaf to the root, one level in each step. A step
is an equi join of the climbers with the node rows: it appends the siblings to the proof
and folds the (tampered) digest with them. Leaves with one parent share all siblings above
it, so they climb as one row, with a folded digest for each. Everybody meets at the top, so
the node rows above ``PIECE`` climbers exist once per piece of that many: no key of the
join has more climbers than that, whatever the size of a source. Node rows are dealt by
piece once, before the climb, so its steps exchange the climbers only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textjudge.llm.common import range_parts, width
from textjudge.operators.index import chunked_index
from textjudge.operators.lineage import materialize

#: children of a node
ARITY = 16
#: climbers that share one copy of the nodes above them, and the highest level without copies
PIECE_LEVEL = 2
PIECE = ARITY**PIECE_LEVEL
#: the tree of the subroots: its levels count from here, its rows belong to no source
UPPER = 1000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*digests: Column) -> Column:
    """Digest (32 bytes) of digests that are written as lowercase hex, one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*digests))), 256))


def framed(value: Column) -> Column:
    """A field with its length, so that no two rows give the same leaf input."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(v) for v in values]), 256))


def small_letters(text: Column) -> Column:
    """The tampering of the query: A-Z become a-z."""
    return F.translate(text, CAPITALS, SMALL)


def every_fifth(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def numbered(rows: DataFrame, group: str, order: list[str], rows_per_part: int) -> DataFrame:
    """Place of each row in its group as ``idx`` and rows of the group as ``n``.

    Numbered inside ranges of the whole order, plus the sizes of earlier ranges.
    """
    ranged = range_parts(rows, [group, *order], rows_per_part)
    return chunked_index(ranged, [group], [*order, "_place"], F.col("part"), "idx", total="n").drop("_place", "part")


def levels(rows: DataFrame) -> list[DataFrame]:
    """Node rows of each level above ``rows`` (tree, idx, digest, n): also level and children.

    ``n`` is the number of nodes of the tree on the level. A tree is done when that is 1.
    """
    top, level, built = rows.agg(F.max("n")).first()[0] or 0, 0, []
    while top > 1:
        level, top = level + 1, math.ceil(top / ARITY)
        children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda c: c["digest"])
        grouped = rows.where("n > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("idx")).agg(
            F.aggregate(children, F.lit(b""), lambda whole, c: F.concat(whole, c)).alias("children"), F.first("n").alias("n")
        )
        rows = materialize(grouped.select("tree", F.lit(level).alias("level"), "idx", "children", hashed(F.col("children")).alias("digest"), F.ceil(F.col("n") / ARITY).alias("n")))
        built.append(rows)
    return built


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def above(level: Column, idx: Column, more: Column, upper: Column) -> list[Column]:
    """Address of the node above (level, idx) and the place among its children.

    With ``more`` nodes on the level it is in the same tree, else in that of the subroots,
    where ``upper`` is the place of the source, or nowhere if that is null.
    """
    return [
        F.when(more, level + 1).when(upper.isNotNull(), UPPER + 1).alias("next_level"),
        F.when(more, F.floor(idx / ARITY)).otherwise(F.floor(upper / ARITY)).alias("next_idx"),
        F.when(more, idx % ARITY).otherwise(upper % ARITY).cast("int").alias("next_pos"),
    ]


def manifest(leaves: DataFrame, rows_per_part: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Climbers and node rows above ``leaves`` (tree, idx, n, digest and more).

    A node row: tree, level, idx, piece, children, digest, subroot (is it one), and the
    address and place one level up (null for the root).
    """
    leaves = materialize(leaves.withColumn("piece", F.floor(F.col("idx") / PIECE)))
    lower = levels(leaves.select("tree", "idx", "digest", "n"))
    single = leaves.where("n = 1").select("tree", "digest", F.lit(1).cast("long").alias("pieces"))
    # a tree has as many pieces as its leaves fill
    counts = leaves.where("n > 1").groupBy("tree").agg(F.max("piece").alias("last"))
    tops = [x.where("n = 1").select("tree", "digest") for x in lower]
    found = single.unionByName(stacked(tops).join(counts, "tree").select("tree", "digest", (F.col("last") + 1).alias("pieces"))) if lower else single
    sources = found.select(F.lit("").alias("all"), "tree", "digest", "pieces")
    sources = materialize(numbered(sources, "all", ["tree"], rows_per_part).select("tree", "digest", "pieces", "idx", "n"))
    upper = levels(sources.select(F.lit("").alias("tree"), "idx", "digest", "n"))

    place = sources.select("tree", F.when(F.col("n") > 1, F.col("idx")).alias("upper"))
    rows = []
    for number, nodes in enumerate(lower, 1):
        # a node on a high level has a row for each piece below it
        step = ARITY ** max(0, number - PIECE_LEVEL)
        if number > PIECE_LEVEL:
            first = F.col("idx") * step
            nodes = nodes.join(counts, "tree").withColumn("piece", F.explode(F.sequence(first, F.least(first + step - 1, "last")))).drop("last")
        else:
            nodes = nodes.withColumn("piece", F.floor(F.col("idx") * ARITY**number / PIECE))
        rows.append(nodes)
    steps = []
    if rows:
        nodes = stacked(rows)
        # only subroots look up the place of their source
        inner = nodes.where("n > 1").withColumn("upper", F.lit(None).cast("long"))
        outer = nodes.where("n = 1").join(place, "tree")
        for part in (inner, outer):
            more = F.col("n") > 1
            steps.append(part.select("tree", "level", "idx", "piece", "children", "digest", (~more).alias("subroot"), *above(F.col("level"), F.col("idx"), more, F.col("upper"))))
    if upper:
        pieces = sources.select("tree", "idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        for number, nodes in enumerate(upper, 1):
            keyed = pieces.select("tree", "piece", F.floor(F.col("idx") / ARITY**number).alias("idx"))
            more = F.col("n") > 1
            held = keyed.join(nodes.drop("tree"), "idx")
            none = F.lit(None).cast("long")
            steps.append(held.select("tree", (F.col("level") + UPPER).alias("level"), "idx", "piece", "children", "digest", F.lit(False).alias("subroot"), *above(F.col("level") + UPPER, F.col("idx"), more, none)))

    many = leaves.where("n > 1").withColumn("upper", F.lit(None).cast("long"))
    alone = leaves.where("n = 1").join(place, "tree")
    climbers = many.unionByName(alone.select(*many.columns))
    more = F.col("n") > 1
    climbers = climbers.select("*", *above(F.lit(0), F.col("idx"), more, F.col("upper")))
    return climbers, stacked(steps) if steps else None


#: recursive queries without a limit on rows (levels are logarithmic in the rows), and joins
#: that make use of a partitioning by some of their keys; adaptive plans would not show theirs
CLIMBING = {
    "spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false",
}


@contextmanager
def climbing(spark: SparkSession) -> Iterator[None]:
    before = {n: spark.conf.get(n, None) for n in CLIMBING}
    try:
        for n, value in CLIMBING.items():
            spark.conf.set(n, value)
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


CLIMB = f"""
WITH RECURSIVE climb (tree, run, piece, level, idx, pos, folded, proof, subroot, root) AS (
    SELECT tree, idx, piece, next_level, next_idx, next_pos, folded, X'', digest, digest FROM {{climbers}}
    UNION ALL
    SELECT c.tree, c.run, c.piece, s.next_level, s.next_idx, s.next_pos,
           transform(c.folded, f -> unhex(sha2(lower(hex(overlay(s.children PLACING f FROM 32 * c.pos + 1))), 256))),
           concat(c.proof, overlay(s.children PLACING X'' FROM 32 * c.pos + 1 FOR 32)),
           CASE WHEN s.level < {UPPER} THEN s.digest ELSE c.subroot END, s.digest
    FROM climb c JOIN {{steps}} s ON c.tree = s.tree AND c.piece = s.piece AND c.level = s.level AND c.idx = s.idx
)
SELECT tree, run, folded, proof, subroot, root FROM climb WHERE level IS NULL
"""


def runs(leaves: DataFrame) -> DataFrame:
    """The leaves of each node of the first level: tree, idx, n, members, digest and folded.

    ``digest`` is that of the node, or the leaf's own if the tree has no other; ``folded``
    has the same for each member, with that member tampered.
    """
    member = F.struct("idx", "doc_id", "digest", "tampered")
    grouped = leaves.groupBy("tree", F.floor(F.col("idx") / ARITY).alias("idx")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("n").alias("leaves"))
    whole = F.aggregate("members", F.lit(b""), lambda found, m: F.concat(found, m["digest"]))
    held = grouped.withColumn("children", whole)
    alone = F.col("leaves") == 1
    other = lambda m: F.coalesce(m["tampered"], m["digest"])
    fold = lambda m, k: F.when(alone, other(m)).otherwise(hashed(F.overlay("children", other(m), 32 * k + 1)))
    return held.select(
        "tree", "idx", F.ceil(F.col("leaves") / ARITY).alias("n"), "members", "children",
        F.when(alone, F.col("children")).otherwise(hashed(F.col("children"))).alias("digest"), F.transform("members", fold).alias("folded"),
    )


def prove(
    docs: DataFrame, tampering=small_letters, tampered=every_fifth, fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rows_per_part: int = 1 << 18,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``fields``, each with its length, null as ``-``. ``tampered``
    (of the id) says whose text ``tampering`` changes before the climb; a null text stays.
    Null sources are one source, the first; null ids come first in theirs; rows of one
    source and id stand in the order of their leaves, and equal rows are leaves of their
    own with equal digests. A source of one row has its leaf as subroot, one source alone
    its subroot as root. An empty table gives an empty result. Other columns are not read.
    """
    values = {f: F.col(f"`{f}`") for f in fields}
    changed = [tampering(v) if f == text_col else v for f, v in values.items()]
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source)).alias("tree"),
        leaf(list(values.values())).alias("digest"), F.when(tampered(F.col(f"`{id_col}`")), leaf(changed)).alias("tampered"),
    )
    climbers, steps = manifest(runs(numbered(rows, "tree", ["doc_id", "digest"], rows_per_part)), rows_per_part)
    spark = docs.sparkSession
    parts = max(width(docs), math.ceil(climbers.count() * ARITY / rows_per_part))
    slim = climbers.select("tree", "idx", "piece", "next_level", "next_idx", "next_pos", "folded", "digest")
    if steps is None:
        climbed = slim.select("tree", F.col("idx").alias("run"), "folded", F.lit(b"").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    else:
        with climbing(spark):
            dealt = [materialize(x.repartition(parts, "tree", "piece")) for x in (slim, steps)]
            climbed = materialize(spark.sql(CLIMB, climbers=dealt[0], steps=dealt[1]))
    met = climbers.alias("r").join(climbed.alias("c"), (F.col("r.tree") == F.col("c.tree")) & (F.col("r.idx") == F.col("c.run")))
    opened = met.select("r.children", "c.proof", "c.subroot", "c.root", F.posexplode(F.arrays_zip("r.members", "c.folded")).alias("pos", "m"))
    siblings = F.overlay("children", F.lit(b""), 32 * F.col("pos") + 1, F.lit(32))
    found = opened.select(
        F.col("m.members.doc_id").alias("doc_id"), F.col("m.members.digest").alias("leaf"), "subroot", "root",
        F.sha2(F.lower(F.hex(F.concat(siblings, "proof"))), 256).alias("proof_sha256"), F.col("m.folded").alias("folded"),
    )
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(
        "doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
