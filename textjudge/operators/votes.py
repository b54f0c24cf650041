"""Repeated classification answers: reshaping, votes, confusion, distributions.

Answers arrive wide (one column per repeat) or long (one row per repeat). Wide
rows are summarised inside the row, without a shuffle. Long rows need one hash
aggregation of integer counters on the record key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import percent, share, strip, text_or_empty
from textjudge.functions.keys import KEY, expected_label, soft_accepts
from textjudge.functions.labels import parse_answer, parse_label

#: Vote shares are whole multiples of one part in VOTE_UNIT, so that weighted sums do not
#: depend on partitioning. Exact for up to twenty parsed answers of a record; with more, a
#: share is off by less than one part in four hundred million.
VOTE_UNIT = math.lcm(*range(1, 21))

REPEAT_COLUMN = re.compile(r"sentence_\d+")


def answer_columns(columns: Sequence[str]) -> list[str]:
    """Repeat columns; the bare ``sentence`` only when a run has no repeats."""
    repeats = [c for c in columns if REPEAT_COLUMN.fullmatch(c)]
    return repeats or [c for c in columns if c == "sentence"]


def unpivot_repeats(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Wide answers to (key, repeat_idx, answer)."""
    columns = answer_columns(df.columns)
    long = df.unpivot(list(keys), columns, "_column", "answer")
    number = F.coalesce(
        F.regexp_extract("_column", r"(\d+)$", 1).try_cast("int"),
        F.lit(1),
    )
    return long.select(*keys, number.alias("repeat_idx"), "answer")


def pivot_repeats(
    df: DataFrame, keys: Sequence[str] = KEY, repeats: int = 5, values: Sequence[str] = ("answer",)
) -> DataFrame:
    """Long repeats to one wide row per key.

    The first repeat doubles as the bare column. Keys without a successful
    (non-empty) answer are omitted. A repeat outside 1..``repeats`` is an error, as it
    would have no column.
    """
    stems = {"answer": "sentence"}
    cells = []
    for value in values:
        stem = stems.get(value, value)
        for i in range(1, repeats + 1):
            cell = F.max(F.when(F.col("repeat_idx") == i, F.col(value)))
            cells.append(F.coalesce(cell, F.lit("")).alias(f"{stem}_{i}"))
    good = F.count_if(strip(text_or_empty(F.col(values[0]))) != "").alias("_good")
    inside = F.col("repeat_idx").between(1, repeats)
    known = F.when(inside, F.col("repeat_idx")).otherwise(
        F.raise_error(F.concat(F.lit(f"repeat outside 1..{repeats}: "), F.col("repeat_idx").cast("string")))
    )
    df = df.withColumn("repeat_idx", known)
    wide = df.groupBy(*keys).agg(good, *cells).filter("_good > 0").drop("_good")
    for value in values:
        stem = stems.get(value, value)
        wide = wide.withColumn(stem, F.col(f"{stem}_1"))
    return wide


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _winner(n: dict[str, Column], tie: dict[str, Column]) -> Column:
    """Label with most votes, then the smallest tie value; '' without votes."""
    best = F.greatest(*[F.struct(n[x].alias("n"), (-tie[x]).alias("tie"), F.lit(x).alias("label")) for x in n])
    return F.when(_sum(list(n.values())) > 0, best["label"]).otherwise("")


def _vote_columns(n: dict[str, Column], first: dict[str, Column], answers: Column) -> list[Column]:
    parsed = _sum(list(n.values()))
    order = {x: F.lit(i) for i, x in enumerate(fixed.LABELS)}
    # nearest whole number of units, in integers; exact for up to twenty parsed answers
    distinct = _sum([(n[x] > 0).cast("int") for x in n])
    out = [n[x].cast("int").alias(f"votes_{x}") for x in n]
    # a label that was never seen cannot win, so its position is irrelevant
    seen = {x: F.coalesce(first[x], F.lit(0)) for x in n}
    out += [
        answers.cast("int").alias("answers"),
        parsed.cast("int").alias("parsed"),
        _winner(n, seen).alias("vote_first_seen"),
        _winner(n, order).alias("vote_label_order"),
        ((parsed == answers) & (distinct == 1)).alias("unanimous"),
        share(answers - parsed, answers).alias("invalid_rate"),
    ]
    out += [F.coalesce(share(n[x], parsed), F.lit(0.0)).alias(f"vote_share_{x}") for x in n]
    out += [F.coalesce(_units(n[x], parsed), F.lit(0)).cast("long").alias(f"units_{x}") for x in n]
    return out


def _units(votes: Column, parsed: Column) -> Column:
    """votes / parsed in whole units, rounded to the nearest one without leaving integers."""
    twice = votes.cast("long") * (2 * VOTE_UNIT) + parsed
    return (twice - F.pmod(twice, F.nullif(2 * parsed, F.lit(0).cast("long")))) / (2 * parsed)


def vote_long(df: DataFrame, keys: Sequence[str] = KEY, parser=parse_label) -> DataFrame:
    """Votes, unanimity and shares from long answers: one aggregation on the key."""
    labelled = df.withColumn("_label", parser(F.col("answer")))
    counts = [F.count(F.lit(1)).alias("_answers")]
    for x in fixed.LABELS:
        hit = F.col("_label") == x
        counts.append(F.count_if(hit).alias(f"_n_{x}"))
        counts.append(F.min(F.when(hit, F.col("repeat_idx"))).alias(f"_first_{x}"))
    grouped = labelled.groupBy(*keys).agg(*counts)
    n = {x: F.col(f"_n_{x}") for x in fixed.LABELS}
    first = {x: F.col(f"_first_{x}") for x in fixed.LABELS}
    return grouped.select(*keys, *_vote_columns(n, first, F.col("_answers")))


def vote_wide(df: DataFrame, keys: Sequence[str] = KEY, parser=parse_label) -> DataFrame:
    """The same from wide answers, inside each row."""
    columns = answer_columns(df.columns)
    labelled = df.select(*keys, *[parser(F.col(c)).alias(f"_l{i}") for i, c in enumerate(columns)])
    marks = [F.col(f"_l{i}") for i in range(len(columns))]
    n = {x: _sum([F.coalesce((m == x).cast("int"), F.lit(0)) for m in marks]) for x in fixed.LABELS}
    first = {
        x: F.coalesce(*[F.when(m == x, F.lit(i)) for i, m in enumerate(marks)]) for x in fixed.LABELS
    }
    out = _vote_columns(n, first, F.lit(len(columns)))
    return labelled.select(*keys, *out)


def answer_format(
    df: DataFrame, keys: Sequence[str] = KEY, examples: int | None = None, example_chars: int | None = None
) -> DataFrame:
    """Per key: counts by parse status, vote, raw unanimity and correctness.

    All non-exact answers are listed whole unless the caller limits them. ``multiple`` also counts as recovered and ``empty`` also as unparsed.
    """
    read = df.withColumn("_a", parse_answer(F.col("answer"))).withColumn(
        "_raw", strip(text_or_empty(F.col("answer")))
    )
    status = F.col("_a.status")
    aggs = [
        F.count(F.lit(1)).alias("answers"),
        F.count_if(status == "exact").alias("exact"),
        F.count_if(status.isin("recovered", "multiple")).alias("recovered"),
        F.count_if(status == "multiple").alias("multiple"),
        F.count_if(status.isin("unparsed", "empty")).alias("unparsed"),
        F.count_if(status != "exact").alias("non_exact"),
        (F.min("_raw") == F.max("_raw")).alias("raw_unanimous"),
    ]
    aggs += [F.count_if(F.col("_a.label") == x).alias(f"_n_{x}") for x in fixed.LABELS]
    grouped = _with_examples(read, keys, aggs, examples, example_chars)
    n = {x: F.col(f"_n_{x}") for x in fixed.LABELS}
    order = {x: F.lit(i) for i, x in enumerate(fixed.LABELS)}
    parsed, distinct = _sum(list(n.values())), _sum([(n[x] > 0).cast("int") for x in n])
    vote = _winner(n, order)
    expected = expected_label(F.col("variant"))
    return grouped.withColumns(
        {
            "vote_label": vote,
            "vote_count": F.greatest(*n.values()).cast("int"),
            "expected_label": expected,
            "unanimous": (parsed == F.col("answers")) & (distinct == 1),
            "correct_vote": F.when(vote != "", vote == expected),
        }
    ).drop(*[f"_n_{x}" for x in n])


def _with_examples(
    read: DataFrame, keys: Sequence[str], aggs: Sequence[Column], most: int | None, chars: int | None
) -> DataFrame:
    """Add the non-exact answers of each key in repeat order; a key has one per repeat."""
    text = F.col("_raw") if chars is None else F.left("_raw", F.lit(chars))
    example = F.when(
        (F.col("_a.status") != "exact") & (F.col("_raw") != ""), F.struct("repeat_idx", text.alias("text"))
    )
    listed = F.sort_array(F.collect_list(example))
    shown = listed if most is None else F.slice(listed, 1, most)
    texts = F.transform(shown, lambda e: e["text"])
    return read.groupBy(*keys).agg(*aggs, F.array_join(texts, " || ").alias("raw_examples"))


def format_summary(per_key: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Answer-format totals for several groupings in one pass."""
    from textjudge.operators.scores import grouping_sets

    correct = F.coalesce(F.col("correct_vote"), F.lit(False))
    counted = grouping_sets(
        per_key,
        sets,
        [
            F.count(F.lit(1)).alias("records"),
            F.sum("answers").alias("classification_answers"),
            F.sum("non_exact").alias("non_exact_answers"),
            F.sum("unparsed").alias("unparsed_answers"),
            F.sum("multiple").alias("multiple_label_answers"),
            F.count_if(~F.col("unanimous")).alias("vote_not_unanimous_rows"),
            F.count_if(~F.col("raw_unanimous")).alias("raw_not_unanimous_rows"),
            F.count_if(correct).alias("majority_vote_correct_rows"),
        ],
    )
    records = F.col("records")
    return counted.withColumns(
        {
            "majority_vote_incorrect_rows": records - F.col("majority_vote_correct_rows"),
            "non_exact_answer_pct": percent(
                F.col("non_exact_answers"), F.col("classification_answers")
            ),
            "vote_not_unanimous_pct": percent(F.col("vote_not_unanimous_rows"), records),
            "raw_not_unanimous_pct": percent(F.col("raw_not_unanimous_rows"), records),
            "majority_vote_correct_pct": percent(F.col("majority_vote_correct_rows"), records),
        }
    )


def accuracy(votes: DataFrame, keys: Sequence[str], vote: str = "vote_label_order") -> DataFrame:
    """Hard and soft accuracy in percent."""
    label, variant = F.col(vote), F.col("variant")
    return (
        votes.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(label == expected_label(variant)).alias("_hard"),
            F.count_if(soft_accepts(variant, label)).alias("_soft"),
        )
        .select(
            *keys,
            "n",
            percent(F.col("_hard"), F.col("n")).alias("hard_accuracy"),
            percent(F.col("_soft"), F.col("n")).alias("soft_accuracy"),
        )
    )


def accuracy_pivot(votes: DataFrame, keys: Sequence[str], vote: str = "vote_label_order") -> DataFrame:
    """Hard accuracy with one column per prompt language."""
    hit = F.col(vote) == expected_label(F.col("variant"))
    cells = [
        percent(
            F.count_if(hit & (F.col("language") == x)), F.count_if(F.col("language") == x)
        ).alias(f"accuracy_{x}")
        for x in fixed.LANGUAGES
    ]
    return votes.groupBy(*keys).agg(*cells)


def prediction_rates(labelled: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Share of each label among the labelled answers, zero-filled, in percent."""
    counts = [F.count_if(F.col(label) == x).alias(f"_n_{x}") for x in fixed.LABELS]
    total = _sum([F.col(f"_n_{x}") for x in fixed.LABELS])
    return (
        labelled.groupBy(*keys)
        .agg(*counts)
        .select(*keys, *[percent(F.col(f"_n_{x}"), total).alias(f"rate_{x}") for x in fixed.LABELS])
    )


def confusion_matrix(
    votes: DataFrame, keys: Sequence[str] = (), vote: str = "vote_first_seen"
) -> DataFrame:
    """Zero-filled matrix in long form: all cells are counters of one aggregation."""
    true = expected_label(F.col("variant"))
    cells = [(a, b) for a in fixed.LABELS for b in fixed.LABELS]
    counts = [
        F.count_if((true == a) & (F.col(vote) == b)).alias(f"_{a}_{b}") for a, b in cells
    ]
    counted = votes.groupBy(*keys).agg(*counts)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("true_label"),
                F.lit(b).alias("predicted_label"),
                F.col(f"_{a}_{b}").alias("n"),
                percent(
                    F.col(f"_{a}_{b}"), _sum([F.col(f"_{a}_{c}") for c in fixed.LABELS])
                ).alias("row_pct"),
            )
            for a, b in cells
        ]
    )
    return counted.select(*keys, F.inline(rows))


DISPLAY = ("FA", "FI", "CFA")


def _whole_percents(counts: dict[str, Column]) -> dict[str, Column]:
    """Whole percents of integer counts that add up to 100 (largest remainder).

    Works on integer remainders of ``100 * n / total``; equal remainders favour the
    earlier label.
    """
    total = _sum(list(counts.values()))
    rest = {x: F.pmod(n * 100, F.nullif(total, F.lit(0).cast("long"))) for x, n in counts.items()}
    base = {x: ((counts[x] * 100 - rest[x]) / total).cast("int") for x in counts}
    spare = F.lit(100) - _sum(list(base.values()))
    names = list(counts)
    out = {}
    for i, x in enumerate(names):
        ahead = [(rest[y] >= rest[x] if j < i else rest[y] > rest[x]).cast("int") for j, y in enumerate(names) if y != x]
        out[x] = base[x] + F.when(_sum(ahead) < spare, 1).otherwise(0)
    return out


def label_distribution(
    votes: DataFrame, keys: Sequence[str] = ("model",), vote: str = "vote_first_seen"
) -> DataFrame:
    """Whole percents per label that add up to 100, by largest remainder."""
    counted = votes.groupBy(*keys).agg(*[F.count_if(F.col(vote) == x).alias(x) for x in DISPLAY])
    whole = _whole_percents({x: F.col(x) for x in DISPLAY})
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("n"), whole[x].alias("pct")) for x in DISPLAY])
    return counted.filter(_sum([F.col(x) for x in DISPLAY]) > 0).select(*keys, F.inline(rows))


def model_summary(votes: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, unanimity and whole label percents, all from one aggregation of the votes."""
    hit = F.col("vote_first_seen") == expected_label(F.col("variant"))
    counted = votes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("_hit"), F.count_if("unanimous").alias("_una"),
        *[F.count_if(F.col("vote_first_seen") == x).alias(x) for x in DISPLAY],
    )
    whole = _whole_percents({x: F.col(x) for x in DISPLAY})
    return counted.filter(_sum([F.col(x) for x in DISPLAY]) > 0).select(
        *keys, "n", percent(F.col("_hit"), F.col("n")).alias("accuracy"), percent(F.col("_una"), F.col("n")).alias("unanimity"),
        *[whole[x].alias(f"pct_{x.lower()}") for x in DISPLAY],
    )


def classification_metrics(votes: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, unanimity and invalid rate with flags for the best shown value."""
    hit = F.col("vote_first_seen") == expected_label(F.col("variant"))
    grouped = (
        votes.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(hit).alias("_hit"),
            F.count_if("unanimous").alias("_una"),
            F.sum("answers").alias("_answers"),
            F.sum(F.col("answers") - F.col("parsed")).alias("_bad"),
        )
        .select(
            *keys,
            "n",
            percent(F.col("_hit"), F.col("n")).alias("accuracy"),
            percent(F.col("_una"), F.col("n")).alias("unanimity"),
            percent(F.col("_bad"), F.col("_answers")).alias("invalid"),
        )
    )
    # the table has one row per model: the extremes are taken over it, not over the votes
    table = Window.partitionBy(F.lit(0))

    def is_best(value: str, extreme) -> Column:
        return F.bround(F.col(value), 2) == F.bround(extreme(value).over(table), 2)

    return grouped.withColumns(
        {
            "best_accuracy": is_best("accuracy", F.max),
            "best_unanimity": is_best("unanimity", F.max),
            "best_invalid": is_best("invalid", F.min),
        }
    )


def soft_sums(rows: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Exact weighted sums per group: numerators and weights in vote units."""
    aggs = []
    for x in fixed.LABELS:
        aggs.append(F.sum(F.col(score) * F.col(f"units_{x}")).alias(f"num_{x}"))
        aggs.append(F.sum(f"units_{x}").alias(f"den_{x}"))
    return rows.groupBy(*keys).agg(*aggs)


def soft_long(sums: DataFrame, keys: Sequence[str], weights: bool = False) -> DataFrame:
    """Weighted mean and effective count per label from weighted sums."""
    unit = F.lit(VOTE_UNIT)
    cells = F.array(
        *[
            F.struct(
                F.lit(x).alias("predicted_label"),
                share(F.col(f"num_{x}"), F.col(f"den_{x}")).alias("mean_score"),
                share(F.col(f"den_{x}"), unit).alias("effective_count"),
                F.col(f"den_{x}").alias("weight"),
            )
            for x in fixed.LABELS
        ]
    )
    out = sums.select(*keys, F.inline(cells))
    return out if weights else out.drop("weight")


def soft_means(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return soft_long(soft_sums(rows, keys), keys)


def macro_means(rows: DataFrame) -> DataFrame:
    """True x perceived class: ratio per model, then the mean over models.

    Ratios are added in model order, so the result does not depend on partitioning.
    """
    keys = ["true_label", "model"]
    sums = soft_sums(rows.withColumn("true_label", expected_label(F.col("variant"))), keys)
    cells = soft_long(sums, keys, weights=True)
    # at most one ratio per model in each cell
    listed = F.array_sort(
        F.collect_list(F.when(F.col("mean_score").isNotNull(), F.struct("model", "mean_score")))
    )
    total = F.aggregate(listed, F.lit(0.0), lambda acc, e: acc + e["mean_score"])
    return cells.groupBy("true_label", "predicted_label").agg(
        F.try_divide(total, F.size(listed)).alias("mean_score"),
        share(F.sum("weight"), F.lit(VOTE_UNIT)).alias("effective_count"),
        F.count("mean_score").alias("models"),
    )
