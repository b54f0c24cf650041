"""Mixing sources to target weights by temperature.

The token share p of each source becomes a weight proportional to p**a. The exponent a is
found by repeated section (each pass evaluates a grid of exponents in one aggregation):
the largest one that reaches the target entropy, raised if some source would otherwise be
repeated too often. The weights are realised as blocks of a token budget: the copies of a
source stand in a permuted order, epoch after epoch, and the place in that order relative
to the quota of the source gives the block, so each block holds the target mixture.

Cumulative sums of a source run inside chunks of a hash range and over chunk totals, so a
source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge.llm.common import WORD, whole_text
from textjudge.operators.lineage import materialize


@dataclass(frozen=True)
class Mixture:
    #: entropy of the weights to reach, as a share of the entropy of equal weights
    entropy: float = 0.95
    #: most epochs of a source in the mixture
    repetition: float = 2.0
    #: tokens of the whole mixture; None: the least budget in which no document is lost
    budget: float | None = None
    block_tokens: int = 1_000_000
    seed: int = 7


def token_count(text_col: str = "text") -> Column:
    """Words and one end, so that no document weighs nothing."""
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long") + 1


def exponent(shares: DataFrame, mix: Mixture, total: float, points: int = 32, passes: int = 5) -> tuple[float, float]:
    """(exponent, sum of p**exponent over the sources of ``shares``)."""
    extremes = shares.agg(F.count("share"), F.min("share"), F.max("share")).first()
    n, least, most = extremes
    if not n:
        return 1.0, 1.0

    def measured(grid: list[float]) -> dict[float, tuple[float, float]]:
        """exponent -> (entropy, normaliser), all in one pass over the sources."""
        rows = shares.select("share", F.explode(F.array(*map(F.lit, grid))).alias("a"))
        power = F.pow("share", F.col("a"))
        sums = rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s")).collect()
        return {r["a"]: (math.log(r["z"]) - r["a"] * r["s"] / r["z"], r["z"]) for r in sums}

    target = mix.entropy * math.log(n)
    low, high = 0.0, 1.0
    for _ in range(passes):
        grid = [low + (high - low) * k / points for k in range(points + 1)]
        found = measured(grid)
        reached = [k for k, a in enumerate(grid) if found[a][0] >= target - 1e-12]
        k = max(reached, default=0)
        low, high = grid[k], grid[min(k + 1, points)]
    alpha = low

    def repeats(a: float) -> float:
        """Epochs of the smallest source while the largest has one, or with a fixed budget."""
        if mix.budget is None:
            return (most / least) ** (1 - a)
        return least ** (a - 1) / measured([a])[a][1] * mix.budget / total

    if repeats(alpha) > mix.repetition:
        low, high = alpha, 1.0
        while high - low > 1e-9:
            middle = (low + high) / 2
            low, high = (middle, high) if repeats(middle) > mix.repetition else (low, middle)
        alpha = high
    return alpha, measured([alpha])[alpha][1]


def units_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, tokens, rows: what is placed together. Kept, as it is read several times."""
    named = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), token_count(text_col).alias("tokens")
    )
    return materialize(named.groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))


def source_weights(units: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """One row per source: source, documents, tokens, share, weight, quota, epochs, alpha.

    Rows without a source form a source of their own.
    """
    sums = materialize(units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("documents")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    alpha, z = exponent(shares, mix, float(total))
    most = shares.agg(F.max("share")).first()[0] or 1.0
    # in the least budget the source whose weight shrinks most, the largest, has one epoch
    budget = mix.budget or total * most ** (1 - alpha) * z
    weight = F.pow("share", F.lit(alpha)) / z
    weighted = shares.withColumn("weight", weight).withColumn("quota", F.col("weight") * budget)
    return weighted.withColumn("epochs", F.round(F.col("quota") / F.col("tokens"), 9)).withColumn("alpha", F.lit(alpha))


def placements(
    docs: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per copy of a document in the mixture.

    doc_id, source, tokens, epoch, place (tokens of the source before it), block and
    order_key (its place in the permutation of the block). Rows that share id and source
    are one unit and are placed together; null ids and null sources are values like
    others; a null text has one token. An empty table gives an empty result. Other columns
    are not read. A copy is placed while its place is below the quota of its source, so a
    source exceeds its quota by less than one document.
    """
    units = units_of(docs, id_col, source_col, text_col)
    weights = materialize(source_weights(units, mix))
    bounds = weights.agg(F.max("documents"), F.sum("quota")).first()
    bits = max(1, math.ceil(math.log2(math.sqrt(bounds[0] or 1) + 1)))
    blocks = max(1, math.ceil((bounds[1] or 0) / mix.block_tokens))
    plan = weights.select(F.col("source").alias("of"), "quota", "epochs")
    copies = units.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "tokens", "rows", "quota", "epochs",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("epochs").cast("int") - 1))).alias("epoch"),
    )
    drawn = copies.withColumn("draw", F.xxhash64("doc_id", "source", "epoch", F.lit(mix.seed)))
    drawn = drawn.withColumn("chunk", F.shiftrightunsigned("draw", 64 - bits)).withColumn("order", F.shiftrightunsigned("draw", 1))
    epoch = ["source", "epoch"]
    before = Window.partitionBy(*epoch).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn.groupBy(*epoch, "chunk").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    sums = sums.withColumn("all", F.sum("sum").over(Window.partitionBy(*epoch)))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in (*epoch, "chunk")], "start", "all")
    inside = Window.partitionBy(*epoch, "chunk").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("local", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    joined = numbered.join(
        sums,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("chunk") == F.col("_chunk")),
    )
    placed = joined.withColumn("place", F.col("epoch") * F.col("all") + F.col("start") + F.col("local"))
    # whole epochs are kept whole; rounding never loses their last document
    placed = placed.where((F.col("epoch") < F.floor("epochs")) | (F.col("place") < F.col("quota")))
    block = F.least(F.floor(F.col("place") / F.col("quota") * blocks), F.lit(blocks - 1)).cast("long")
    return placed.select(
        "doc_id", "source", "tokens", "rows", "epoch", "place", block.alias("block"),
        F.xxhash64(block, "draw", F.lit(mix.seed)).alias("order_key"),
    )


def mix_documents(
    docs: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it, with all their columns."""
    placed = placements(docs, mix, id_col, source_col, text_col)
    counts = placed.groupBy("doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    unit, source = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(source_col)}")
    joined = plain.join(counts, unit.eqNullSafe(F.col("doc_id")) & source.eqNullSafe(F.col("source")))
    repeated = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return repeated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
