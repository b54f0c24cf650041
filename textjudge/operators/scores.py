"""Score statistics.

Scores are small integers, so every statistic follows from how often each value
occurs. One hash aggregation of integer counters per grouping is all that is
shuffled; means, medians and deviations are derived from the counters and do not
depend on how the rows were partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import col, percent, share
from textjudge.functions.keys import KEY


def latest(df: DataFrame, keys: Sequence[str] = KEY, newest_first: Sequence[Column] | None = None) -> DataFrame:
    """Newest row per key.

    The rank filter is pushed below the shuffle as a per-task group limit, so a key
    that holds most of the rows sends one row per task.
    """
    from pyspark.sql import Window

    order = newest_first or [F.col("ts").desc(), F.col("event_id").desc()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def valid_score(score: Column) -> Column:
    return score.isin(*fixed.SCORE_VALUES)


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def counters(score: Column, eid: Column | None = None) -> list[Column]:
    out = [F.count(F.lit(1)).alias("records")]
    out += [F.count_if(score == v).alias(f"score_{v}_count") for v in fixed.SCORE_VALUES]
    if eid is not None:
        out.append(F.countDistinct(F.nullif(eid, F.lit(""))).alias("unique_eids"))
    return out


def derived() -> list[Column]:
    """Statistics of one counter row, unrounded."""
    n = {v: F.col(f"score_{v}_count") for v in fixed.SCORE_VALUES}
    valid = _total([n[v] for v in n])
    total = _total([n[v] * v for v in n])
    squares = _total([n[v] * (v * v) for v in n])
    mean = share(total, valid)
    spread = F.greatest(share(squares, valid) - mean * mean, F.lit(0.0))

    def at(rank: Column) -> Column:
        """Value at a one-based rank of the ordered scores."""
        seen, rule = F.lit(0), None
        for v in fixed.SCORE_VALUES:
            seen = seen + n[v]
            rule = F.when(rank <= seen, v) if rule is None else rule.when(rank <= seen, v)
        return rule

    low = at(F.floor((valid + 1) / 2))
    high = at(F.floor((valid + 2) / 2))
    first = F.coalesce(*[F.when(n[v] > 0, v) for v in fixed.SCORE_VALUES])
    last = F.coalesce(*[F.when(n[v] > 0, v) for v in reversed(fixed.SCORE_VALUES)])
    out = [
        valid.alias("valid_scored_records"),
        (F.col("records") - valid).alias("invalid_score_records"),
        mean.alias("mean_score"),
        F.when(valid > 0, (low + high) / 2.0).alias("median_score"),
        F.sqrt(spread).alias("stddev_score"),
        first.alias("min_score"),
        last.alias("max_score"),
    ]
    shares = {f"score_{v}_pct": n[v] for v in fixed.SCORE_VALUES}
    shares |= {
        "strict_success_pct": n[5],
        "lenient_success_pct": n[4] + n[5],
        "failure_pct": n[1] + n[2],
        "mixed_pct": n[3],
    }
    out += [F.coalesce(percent(part, valid), F.lit(0.0)).alias(k) for k, part in shares.items()]
    return out


def score_stats(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", eid: str | None = "eid"
) -> DataFrame:
    """Full statistics per group."""
    counted = df.groupBy(*keys).agg(*counters(col(score), col(eid) if eid else None))
    return counted.select("*", *derived())


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Several groupings in one pass; ``grouping`` names the columns that are kept."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    present = F.concat_ws(
        "+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]
    ).alias("grouping")
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        present, *aggregates
    )


def score_stats_sets(df: DataFrame, sets, score: str = "score", eid: str | None = "eid") -> DataFrame:
    counted = grouping_sets(df, sets, counters(col(score), col(eid) if eid else None))
    return counted.select("*", *derived())


def mean_by(df: DataFrame, keys: Sequence[str], score: str = "score", name: str = "mean_score") -> DataFrame:
    """Mean and record count per group from exact integer sums."""
    return (
        df.groupBy(*keys)
        .agg(F.sum(score).alias("_sum"), F.count(score).alias("n"))
        .select(*keys, share(F.col("_sum"), F.col("n")).alias(name), "n")
    )


def mean_sets(df: DataFrame, sets, score: str = "score", name: str = "mean_score") -> DataFrame:
    out = grouping_sets(df, sets, [F.sum(score).alias("_sum"), F.count(score).alias("n")])
    return out.withColumn(name, share(F.col("_sum"), F.col("n"))).drop("_sum")


def worst_combos(stats: DataFrame, keys: Sequence[str], n: int = fixed.TOP_COMBOS) -> DataFrame:
    order = [F.col("failure_pct").desc(), F.col("records").desc(), *[F.col(k) for k in keys]]
    return stats.orderBy(*order).limit(n)


def best_combos(stats: DataFrame, keys: Sequence[str], n: int = fixed.TOP_COMBOS) -> DataFrame:
    order = [
        F.col("lenient_success_pct").desc(),
        F.col("mean_score").desc(),
        *[F.col(k) for k in keys],
    ]
    return stats.orderBy(*order).limit(n)


def score_cases(
    df: DataFrame, n: int, order: Sequence[Column], score: str = "score", group: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` cases of every score value (of every group) in a total order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*group, score).orderBy(*order))
    return df.filter(valid_score(F.col(score))).withColumn("case_no", rank).filter(
        F.col("case_no") <= n
    )
