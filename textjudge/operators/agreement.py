"""Human versus judge agreement.

Both scores take few values, so everything is computed from their contingency
table: one aggregation, then arithmetic on a handful of cells per annotator. Ranks
for the rank correlation follow from the cell counts too; no row is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import share
from textjudge.operators.scores import grouping_sets


def human_score(text: Column) -> Column:
    """Number of a hand-written score; a doubtful ``4?`` counts as 4."""
    return F.rtrim(text, F.lit("?")).try_cast("double")


def _doubled_rank(value: str, keys: Sequence[str]) -> Column:
    """Twice the average rank: rows below plus rows up to and including, plus one."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum("w").over(ordered.rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum("w").over(Window.partitionBy(*keys, value))
    return upto * 2 - same + 1


def metrics(df: DataFrame, annotator: str = "annotator", human: str = "human", judge: str = "judge") -> DataFrame:
    """Agreement per annotator and for ALL."""
    scored = df.filter(F.col(human).isNotNull() & F.col(judge).isNotNull()).select(
        F.col(annotator).alias("annotator"),
        F.col(human).cast("double").alias("h"),
        F.col(judge).cast("double").alias("j"),
    )
    cells = grouping_sets(
        scored, [["annotator", "h", "j"], ["h", "j"]], [F.count(F.lit(1)).alias("w")]
    )
    named = cells.select(
        F.when(F.col("grouping").contains("annotator"), F.col("annotator")).otherwise("ALL").alias("annotator"),
        "h", "j", "w",
    )
    ranked = named.withColumns(
        {"rh": _doubled_rank("h", ["annotator"]), "rj": _doubled_rank("j", ["annotator"])}
    )
    w, h, j = F.col("w"), F.col("h"), F.col("j")
    gap = F.abs(h - j)
    on_scale = h.isin(*[float(v) for v in fixed.SCORE_VALUES]) & j.isin(
        *[float(v) for v in fixed.SCORE_VALUES]
    )

    def total(x: Column, only: Column | None = None) -> Column:
        value = x * w if only is None else F.when(only, x * w)
        return F.sum(value.cast("double"))

    rh, rj = F.col("rh").cast("double"), F.col("rj").cast("double")
    sums = ranked.groupBy("annotator").agg(
        F.sum("w").alias("n"),
        F.sum(F.when(gap == 0, w).otherwise(0)).alias("exact"),
        F.sum(F.when(gap <= 1, w).otherwise(0)).alias("near"),
        total(gap).alias("gaps"),
        total(h).alias("sh"),
        total(j).alias("sj"),
        total(rh).alias("srh"),
        total(rj).alias("srj"),
        total(rh * rh).alias("srh2"),
        total(rj * rj).alias("srj2"),
        total(rh * rj).alias("srhj"),
        F.sum(F.when(on_scale, w)).cast("double").alias("kn"),
        total(h, on_scale).alias("kh"),
        total(j, on_scale).alias("kj"),
        total(h * h + j * j, on_scale).alias("k2"),
        total((h - j) * (h - j), on_scale).alias("kd"),
    )
    n = F.col("n").cast("double")

    def c(name: str) -> Column:
        return F.col(name)

    covariance = n * c("srhj") - c("srh") * c("srj")
    spread = (n * c("srh2") - c("srh") * c("srh")) * (n * c("srj2") - c("srj") * c("srj"))
    expected = c("k2") - F.try_divide(c("kh") * c("kj") * 2.0, c("kn"))
    return sums.select(
        "annotator",
        "n",
        share(c("exact"), n).alias("exact_agreement"),
        share(c("near"), n).alias("within_1_agreement"),
        share(c("gaps"), n).alias("mean_absolute_error"),
        share(c("sh"), n).alias("mean_human"),
        share(c("sj"), n).alias("mean_judge"),
        F.try_divide(covariance, F.sqrt(spread)).alias("spearman_correlation"),
        (F.lit(1.0) - F.try_divide(c("kd"), expected)).alias("quadratic_weighted_kappa"),
    )


def score_distribution(df: DataFrame, annotator: str, series: dict[str, str]) -> DataFrame:
    """Zero-filled shares of the scores 1..5 per annotator and series, from one aggregation."""
    both = [F.col(c).isNotNull() for c in series.values()]
    counts = [F.count(F.lit(1)).alias("n")]
    cells = []
    for i, (name, column) in enumerate(series.items()):
        for v in fixed.SCORE_VALUES:
            counts.append(F.count_if(F.col(column) == v).alias(f"_{i}_{v}"))
            cells.append(
                F.struct(
                    F.lit(name).alias("series"),
                    F.lit(v).alias("score"),
                    share(F.col(f"_{i}_{v}"), F.col("n")).alias("share"),
                )
            )
    scored = df
    for test in both:
        scored = scored.filter(test)
    return scored.groupBy(annotator).agg(*counts).select(annotator, F.inline(F.array(*cells)))


def disagreements(df: DataFrame, human: str = "human", judge: str = "judge") -> DataFrame:
    """Scored items with the signed difference, largest distance first."""
    scored = df.filter(F.col(human).isNotNull())
    gap = (F.col(human).cast("int") - F.col(judge)).alias("score_difference")
    return scored.select("*", gap).orderBy(F.abs("score_difference").desc(), "uid")


def with_fallback(key: DataFrame, fluency: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Judge fluency score from the judgment table where the key lacks it."""
    found = fluency.select(*keys, F.col("score").alias("_found"))
    return key.join(found, list(keys), "left").withColumn(
        "judge_fluency_score", F.coalesce("judge_fluency_score", "_found")
    ).drop("_found")
