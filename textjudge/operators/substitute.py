"""Counterfactual and fictional variants: typed substitution of entry members.

Each chosen member is replaced by a pool member of the same type with another
equality form. The pool is numbered per type so that equal forms are contiguous; a
draw skips the own block by an index shift, and the replacement is found by an equi
join on (type, number). Pool rows keep their frequency. Rows are numbered in buckets of
bounded size, a frequent form in several, so no task ever holds a whole form or type.

``counterfactual`` has every member in its pool. Given the triples in parts, it works part
by part, and what one has shuffled leaves the disk before the next; steps leave small
Parquet files, which go as soon as they are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.terms import normalize_member
from textjudge.operators.construct import members, typed_members, unique_members
from textjudge.operators.index import hash_bucket, hash_number
from textjudge.operators.lineage import drop_step, materialize, shared_folder, write_step

#: rows of the pool that one task numbers
ROWS_PER_BUCKET = 50_000
#: what names a bucket
PART = ["type", "_heavy", "_bucket", "_form", "_salt"]
#: pool sizes of the types are broadcast up to this number of types
BROADCAST_TYPES = 100_000
#: triples in a part, and parts at most: every part reads the input again
ROWS_PER_PART, MOST_PARTS = 5_000_000, 3
#: rows of a run of equal values at most, and numbers of a type that picks and runs meet at
RUN = 64


def tagged_members(triples: DataFrame, keys: Sequence[str] = ("eid",), together: bool = False) -> DataFrame:
    """One row per entry and equality form among the typed members.

    Members seldom repeat inside an entry, so rows are dealt first and sorted once,
    instead of once for a partial aggregation and once after the shuffle. ``together``
    deals whole entries, so that what follows by entry needs no shuffle.
    """
    typed = members(triples, keys).filter(F.col("type").isNotNull())
    return unique_members(typed.repartition(*keys, *([] if together else ["norm"])), list(keys))


def entry_members(triples: DataFrame) -> DataFrame:
    """The same by whole entries, with ``_spread``: rows without an entry are dealt by form."""
    spread_by = F.when(F.col("eid").isNull(), F.col("norm"))
    typed = typed_members(triples).withColumn("_spread", spread_by)
    return unique_members(typed.repartition("eid", "_spread"), ["eid", "_spread"])


def spread(pool: DataFrame, row_key: Sequence[str], rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """``pool`` with its bucket inside the type: _heavy, _bucket, _form and _salt; and the rows of each bucket, _all.

    Forms are dealt by hash into as many buckets as the size of the pool asks for. A form
    that alone is too much for a task has buckets of its own, filled by a hash of the row.
    """
    buckets = max(1, math.ceil(pool.count() / rows_per_bucket))
    drawn = F.col("_draw") % buckets if "_draw" in pool.columns else hash_bucket("norm", buckets=buckets)
    dealt = pool.withColumn("_bucket", drawn)
    counted = materialize(dealt.groupBy("type", "_bucket").agg(F.count(F.lit(1)).alias("_all")))
    large = counted.where(F.col("_all") > 4 * rows_per_bucket)
    plain = {"_heavy": F.lit(False), "_form": F.lit(""), "_salt": F.lit(0).cast("long")}
    if large.isEmpty():
        return dealt.withColumns(plain), counted.withColumns(plain)
    forms = dealt.join(large.drop("_all"), ["type", "_bucket"], "left_semi").groupBy("type", "norm").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / rows_per_bucket).alias("_salts")
    # no more rows than the pool has buckets
    heavy = materialize(forms.where(F.col("n") > rows_per_bucket).select("type", "norm", salts))
    joined = dealt.join(F.broadcast(heavy), ["type", "norm"], "left")
    held = F.col("_salts").isNotNull()
    keyed = joined.withColumns({
        "_heavy": held, "_bucket": F.when(~held, F.col("_bucket")).otherwise(0), "_form": F.when(held, F.col("norm")).otherwise(""),
        "_salt": F.when(held, hash_number(*row_key) % F.col("_salts")).otherwise(0),
    }).drop("_salts")
    return keyed, keyed.groupBy(*PART).agg(F.count(F.lit(1)).alias("_all"))


def bucket_offsets(sizes: DataFrame) -> DataFrame:
    """Where each bucket starts in its type, and the forms that have buckets of their own; one row per bucket."""
    whole = Window.partitionBy("type")
    before = whole.orderBy(*PART[1:]).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("type", "_heavy", "_form")
    offsets = sizes.withColumns({
        "_offset": F.coalesce(F.sum("_all").over(before), F.lit(0)), "pool_size": F.sum("_all").over(whole),
    }).withColumns({"_form_offset": F.min("_offset").over(own), "_form_size": F.sum("_all").over(own)})
    return materialize(offsets.drop("_all"))


def number_rows(keyed: DataFrame, offsets: DataFrame, row_key: Sequence[str], columns: Sequence[str], runs: bool = False) -> DataFrame:
    """Rows of whole buckets with their number. Order: bucket, form, row.

    ``runs`` adds run_first and run_last to the last row of each run, null in other rows:
    neighbours of one bucket with the same value, at most RUN of them.
    """
    # the bucket first, as sorts compare a leading number fastest
    part = sorted(PART, key=lambda c: c != "_bucket")
    inside = Window.partitionBy(*part)
    ordered = inside.orderBy("norm", *row_key)
    form = Window.partitionBy(*part, "norm")
    local = keyed.withColumn("_local", F.row_number().over(ordered) - 1)
    added = []
    if runs:
        # all of it in the one order, so that nothing is sorted twice
        begins = (F.col("_local") % RUN == 0) | ~F.col("value").eqNullSafe(F.col("_value_before"))
        so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = local.withColumn("_value_before", F.lag("value").over(ordered)).withColumn("_begins", begins)
        local = local.withColumns({
            "_ends": F.lead("_begins", 1, True).over(ordered), "_run": F.max(F.when(F.col("_begins"), F.col("_local"))).over(so_far),
        })
        added = [F.when(F.col("_ends"), F.col("_offset") + F.col(c)).alias(name) for c, name in (("_run", "run_first"), ("_local", "run_last"))]
    local = local.withColumns({"_first": F.min("_local").over(form), "_size": F.count(F.lit(1)).over(form)})
    light = ~F.col("_heavy")
    return local.join(offsets, part).select(
        *columns, "pool_size", (F.col("_offset") + F.col("_local")).alias("idx"),
        F.when(light, F.col("_offset") + F.col("_first")).otherwise(F.col("_form_offset")).alias("own_start"),
        F.when(light, F.col("_size")).otherwise(F.col("_form_size")).alias("own_size"), *added,
    )


def number_pool(pool: DataFrame, row_key: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Dense number per type with equal forms next to each other; and (type, pool_size).

    ``pool`` has (type, norm, value) plus ``row_key``. Adds ``idx``, the pool size of the
    type, and where the own form starts and how long it is. Rows are numbered inside their
    bucket; only the sizes of the buckets are added up over a type. Order: bucket, form, row.
    """
    keyed, sizes = spread(materialize(pool), row_key, rows_per_bucket)
    offsets = bucket_offsets(sizes)
    numbered = number_rows(keyed, offsets, row_key, pool.columns)
    return materialize(numbered), offsets.groupBy("type").agg(F.max("pool_size").alias("pool_size"))


def own_blocks(numbered: DataFrame) -> DataFrame:
    """Start and length of each form."""
    return numbered.groupBy("type", "norm").agg(F.min("own_start").alias("own_start"), F.max("own_size").alias("own_size"))


def choice(max_changes: int, seed: int) -> tuple[Column, Column]:
    """Hash draws: how many members of an entry change, and the order in which they are taken."""
    stream = F.lit(str(seed))
    wanted = 1 + hash_number(stream, F.lit("changes"), "eid") % max_changes
    return wanted, hash_number(stream, F.lit("order"), "eid", "norm")


def choose_members(usable: DataFrame, max_changes: int, seed: int) -> DataFrame:
    """The members of each entry that change: their number and the choice are hash draws."""
    wanted, order = choice(max_changes, seed)
    rank = F.row_number().over(Window.partitionBy("eid").orderBy("_order", "norm"))
    return (
        usable.withColumn("_order", order)
        .withColumn("_rank", rank)
        # the constant bound is applied before the shuffle, the drawn one after it
        .filter(F.col("_rank") <= max_changes)
        .filter(F.col("_rank") <= wanted)
    )


def mark_chosen(members: DataFrame, max_changes: int, seed: int) -> DataFrame:
    """All members with ``_chosen``, as ``choose_members`` does; those with ``_sole`` and those without an entry are not chosen."""
    wanted, order = choice(max_changes, seed)
    rank = F.row_number().over(Window.partitionBy("eid", "_spread").orderBy("_sole", "_order", "norm"))
    ranked = members.withColumn("_order", order).withColumn("_rank", rank)
    open_to = F.col("eid").isNotNull() & ~F.col("_sole")
    return ranked.withColumn("_chosen", open_to & (F.col("_rank") <= max_changes) & (F.col("_rank") <= wanted))


def pick_number(seed: int) -> Column:
    """Number of the replacement, from pool_size, own_start and own_size."""
    options = F.col("pool_size") - F.col("own_size")
    draw = hash_number(F.lit(str(seed)), F.lit("pick"), "eid", "norm") % options
    return F.when(draw < F.col("own_start"), draw).otherwise(draw + F.col("own_size"))


def draw_replacements(chosen: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """Replacement of each chosen member, which carries pool_size, own_start and own_size."""
    new = pool.select("type", "idx", F.col("value").alias("new_value"))
    picked = chosen.select("eid", "norm", "type", pick_number(seed).alias("idx"))
    return picked.join(new, ["type", "idx"]).select("eid", "norm", "type", "new_value")


def meet_runs(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picks and the runs that they fall into, both with the ``_cell`` of RUN numbers they meet at.

    A run has at most RUN rows, so it lies in one cell or two, and a cell has at most RUN runs.
    """
    picks = found.where("pick IS NOT NULL").select("eid", "norm", "type", "part", "pick", F.expr(f"pick div {RUN}").alias("_cell"))
    cells = F.array_distinct(F.array(*[F.expr(f"{c} div {RUN}") for c in ("run_first", "run_last")]))
    runs = found.where("run_last IS NOT NULL").select("type", "run_first", "run_last", F.col("value").alias("new_value"), F.explode(cells).alias("_cell"))
    return picks, runs


def find_replacements(picks: DataFrame, runs: DataFrame) -> DataFrame:
    """Replacement of each pick, with the part of its entry; from ``meet_runs``."""
    met = picks.join(runs, ["type", "_cell"]).where("pick BETWEEN run_first AND run_last")
    return met.select("eid", "norm", "part", "new_value")


def apply_replacements(triples: DataFrame, replacements: DataFrame) -> DataFrame:
    """Triples of changed entries with every occurrence of a chosen member replaced.

    An entry has at most ``max_changes`` replacements; they travel as one small map. It is
    made by a window, as its sort also serves the join; a grouping sorts twice before.
    """
    own = Window.partitionBy("eid").orderBy("norm")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = replacements.select("eid", F.collect_list(F.struct("norm", "new_value")).over(every).alias("_all"), F.row_number().over(own).alias("_rank"))
    entry = listed.filter(F.col("_rank") == 1).select("eid", F.map_from_entries("_all").alias("_new"))
    joined = triples.join(entry, "eid")

    def swap(member: str):
        new = F.try_element_at(F.col("_new"), normalize_member(F.col(member)))
        return F.coalesce(new, F.col(member))

    return joined.withColumns({"subject": swap("subject"), "object": swap("object")}).drop("_new")


def sole_types(pool: DataFrame) -> DataFrame:
    """Types of which all members have the same form, as ``type``.

    Equal forms have equal draws, so only types with a single draw can be among them.
    """
    draws = pool.groupBy("type").agg(F.min("_draw").alias("low"), F.max("_draw").alias("high"))
    few = materialize(draws.where("low = high").select("type"))
    many = few.count()
    if many == 0:
        return few
    forms = pool.join(F.broadcast(few) if many <= BROADCAST_TYPES else few, "type", "left_semi").select("type", "norm").distinct()
    return materialize(forms.groupBy("type").count().where("count = 1").select("type"))


def store_members(parts: Sequence[DataFrame], folder: str, max_changes: int, types: Sequence[str] | None, seed: int) -> DataFrame:
    """Members of all entries with ``part``, ``_chosen`` and the draw of their form, written part by part.

    An entry is dealt as a whole, so its members are chosen where they are made unique. The
    choice leaves out members of sole types, which are known only when all members are; if
    there are any, the choice is repeated.
    """
    spark = parts[0].sparkSession

    def add(own: DataFrame, step: str, k: int) -> None:
        marked = mark_chosen(own, max_changes, seed).withColumn("_draw", hash_number("norm"))
        write_step(marked.select("eid", "value", "type", "_draw", "_chosen"), f"{folder}/members/{step}/part={k}")

    def read(step: str) -> DataFrame:
        # a form is a function of the value, so it need not be stored
        return spark.read.parquet(f"{folder}/members/{step}").withColumn("norm", normalize_member(F.col("value")))

    for k, triples in enumerate(parts):
        own = entry_members(triples)
        if types is not None:
            own = own.filter(F.col("type").isin(*types))
        add(own.withColumn("_sole", F.lit(False)), "all", k)
    found = read("all")
    sole = sole_types(found)
    if (many := sole.count()) == 0:
        return found
    flagged = sole.withColumn("_one", F.lit(True))
    flagged = F.broadcast(flagged) if many <= BROADCAST_TYPES else flagged
    again = found.join(flagged, "type", "left").withColumns({"_sole": F.col("_one").isNotNull(), "_spread": F.when(F.col("eid").isNull(), F.col("norm"))})
    for k in range(len(parts)):
        add(again.where(F.col("part") == k), "usable", k)
    drop_step(spark, f"{folder}/members/all")
    return read("usable")


def counterfactual(
    triples: DataFrame | Sequence[DataFrame], max_changes: int = fixed.MAX_CHANGES, types: Sequence[str] | None = None,
    seed: int = fixed.CONSTRUCTION_SEED, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Replace members by members of other entries; unchanged entries are dropped.

    ``triples`` may come in parts, each with whole entries; they are worked on one after the
    other, so the disk holds the shuffles of one part only, and the pool is numbered in half as
    many slices. ``columns`` are those of the result. The last part is left to the job that
    reads the result.
    """
    parts = [triples] if isinstance(triples, DataFrame) else list(triples)
    columns = parts[0].columns if columns is None else columns
    spark, slices = parts[0].sparkSession, math.ceil(len(parts) / 2)
    folder = f"{shared_folder(spark)}/substitute-{uuid.uuid4().hex}"
    keyed, sizes = spread(store_members(parts, folder, max_changes, types, seed), ["eid"], ROWS_PER_BUCKET)
    offsets = bucket_offsets(sizes)
    # a member without an alternative cannot be chosen
    pick = F.when(F.col("_chosen") & (F.col("pool_size") > F.col("own_size")), pick_number(seed))
    own, last = F.col("pick").isNotNull(), F.col("run_last").isNotNull()
    kept = [F.when(own, F.col(c)).alias(c) for c in ("eid", "norm", "part")] + [F.when(last, F.col("value")).alias("value")]
    for k in range(slices):
        rows = keyed if slices == 1 else keyed.where(F.pmod(F.xxhash64(*PART), F.lit(slices)) == k)
        numbered = number_rows(rows, offsets, ["eid"], ["eid", "norm", "value", "type", "part", "_chosen"], runs=True)
        write_step(numbered.withColumn("pick", pick).where(own | last).select("type", *kept, "pick", "run_first", "run_last"), f"{folder}/numbered")
    drop_step(spark, f"{folder}/members")
    replacements = find_replacements(*meet_runs(spark.read.parquet(f"{folder}/numbered")))
    if len(parts) > 1:
        write_step(replacements, f"{folder}/replacements")
        drop_step(spark, f"{folder}/numbered")
        replacements = spark.read.parquet(f"{folder}/replacements")
    swapped = [apply_replacements(rows, replacements.where(F.col("part") == k)).select(*columns) for k, rows in enumerate(parts)]
    for rows in swapped[:-1]:
        write_step(rows, f"{folder}/result")
    return spark.read.parquet(f"{folder}/result").union(swapped[-1]) if len(parts) > 1 else swapped[0]


def fictional(
    triples: DataFrame, assets: DataFrame, max_changes: int = fixed.MAX_CHANGES,
    types: Sequence[str] | None = None, seed: int = fixed.CONSTRUCTION_SEED,
) -> DataFrame:
    """Replace members by invented assets of the same type.

    A member has no alternative only where its form is the sole one of its type, so the
    choice needs one row per type; only chosen members meet the forms of the pool.
    """
    pool = assets if types is None else assets.filter(F.col("type").isin(*types))
    listed = pool.select("type", "value", normalize_member(F.col("value")).alias("norm")).distinct()
    numbered, sizes = number_pool(listed, ["value"])
    sole = numbered.filter(F.col("own_size") == F.col("pool_size")).select("type", F.col("norm").alias("_sole")).distinct()
    known = materialize(sizes.join(sole, "type", "left"))
    if known.count() <= BROADCAST_TYPES:
        known = F.broadcast(known)
    # rows without an entry meet no triple in the end
    typed = tagged_members(triples.filter(F.col("eid").isNotNull()), together=True).join(known, "type")
    usable = typed.filter(F.col("_sole").isNull() | F.col("norm").isNull() | (F.col("norm") != F.col("_sole"))).drop("_sole")
    none = F.lit(0).cast("long")
    chosen = choose_members(usable, max_changes, seed).join(own_blocks(numbered), ["type", "norm"], "left").withColumns(
        {"own_start": F.coalesce("own_start", none), "own_size": F.coalesce("own_size", none)}
    )
    return apply_replacements(triples, draw_replacements(chosen, numbered, seed))
