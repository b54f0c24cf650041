"""Issue incidence, category breakdowns, leakage and keyword reports.

Non-exclusive categories are counted with conditional counters in one aggregation.
Rows are only exploded where the counted thing is itself a list element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import categories as C
from textjudge.functions.columns import percent
from textjudge.functions.terms import bigrams, content_words, leaked_predicates
from textjudge.operators.scores import grouping_sets

PREDICTED = ("FA", "FI", "CFA")


def with_report_categories(records: DataFrame, score: str = "score") -> DataFrame:
    """``issue_categories`` from the items of each record."""
    comments = F.transform("items", lambda i: i["comment"])
    return records.withColumn("issue_categories", C.report_categories(comments, F.col(score)))


def incidence(
    rows: DataFrame,
    sets: Sequence[Sequence[str]],
    names: Sequence[str] = fixed.REPORT_ISSUE_CATEGORIES,
    column: str = "issue_categories",
) -> DataFrame:
    """Share of rows with each category, for several groupings in one pass (long form)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    counts = [F.count_if(F.array_contains(column, c)).alias(f"_{c}") for c in names]
    counted = grouping_sets(rows, sets, [F.count(F.lit(1)).alias("n"), *counts])
    cells = [
        F.struct(
            F.lit(c).alias("category"),
            F.col(f"_{c}").alias("rows"),
            percent(F.col(f"_{c}"), F.col("n")).alias("pct"),
        )
        for c in names
    ]
    return counted.select(*keys, "grouping", "n", F.inline(F.array(*cells)))


def is_balanced(rows: DataFrame, key: str) -> DataFrame:
    """One row: the group sizes and whether all groups are equally large."""
    sizes = rows.groupBy(key).count()
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.min("count").alias("smallest"),
        F.max("count").alias("largest"),
        (F.min("count") == F.max("count")).alias("balanced"),
    )


def issue_counts(records: DataFrame, score: str = "score") -> DataFrame:
    """Records per category, over all records and over those below the best score."""
    below = F.col(score).between(1, fixed.MAX_SCORE - 1)
    return (
        records.select(score, F.explode("issue_categories").alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("all_rows"), F.count_if(below).alias("below_5_rows"))
    )


def item_details(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per verdict item with its label, category, predicate and detail text."""
    label = C.comment_label(F.col("item.comment"))
    return (
        records.select(*keep, F.posexplode("items").alias("item_index", "item"))
        .withColumn("label", label)
        .select(
            *keep,
            "item_index",
            "label",
            C.deep_category(F.col("label")).alias("category"),
            C.is_other_label(F.col("label")).alias("is_other_label"),
            C.triple_predicate(F.col("item.correct_info")).alias("predicate"),
            C.comment_detail(F.col("item.comment"), F.col("label")).alias("comment_detail"),
            F.col("item.comment").alias("comment"),
        )
    )


def _item_categories(items: Column) -> Column:
    return F.transform(items, lambda i: C.deep_category(C.comment_label(i["comment"])))


def below_five_rows(records: DataFrame, score: str = "score") -> DataFrame:
    """Indicator columns, label list and item count of records below the best score."""
    labels = F.transform("items", lambda i: C.comment_label(i["comment"]))
    rows = records.filter(F.col(score) < fixed.MAX_SCORE).withColumns(
        {"_cats": _item_categories(F.col("items")), "labels": C.label_text(labels)}
    )
    flags = {
        f"has_{c}": F.array_contains("_cats", c).cast("int") for c in fixed.DEEP_ISSUE_CATEGORIES
    }
    return rows.withColumns({**flags, "num_items": F.size("items")}).drop("_cats")


def _by_predicted(hit: Column, prefix: str) -> list[Column]:
    return [
        F.count_if(hit & (F.col("predicted_label") == p)).alias(f"{prefix}{p}") for p in PREDICTED
    ]


def category_overview(records: DataFrame) -> DataFrame:
    """Per category: rows and items that carry it, overall and by predicted class.

    One global aggregation of counters; every percentage uses the rows of its own
    predicted class as denominator.
    """
    rows = records.withColumn("_cats", _item_categories(F.col("items")))
    aggs = [F.count(F.lit(1)).alias("total"), *_by_predicted(F.lit(True), "total_")]
    for c in fixed.DEEP_ISSUE_CATEGORIES:
        hit = F.array_contains("_cats", c)
        aggs.append(F.count_if(hit).alias(f"{c}_rows"))
        aggs += _by_predicted(hit, f"{c}_rows_")
        same = F.array_size(F.array_remove("_cats", c))
        aggs.append(F.sum(F.size("_cats") - same).alias(f"{c}_items"))
    totals = rows.agg(*aggs)
    cells = []
    for c in fixed.DEEP_ISSUE_CATEGORIES:
        parts = [
            F.lit(c).alias("category"),
            F.col(f"{c}_rows").alias("rows"),
            percent(F.col(f"{c}_rows"), F.col("total")).alias("pct"),
        ]
        for p in PREDICTED:
            parts.append(F.col(f"{c}_rows_{p}").alias(f"rows_{p}"))
            parts.append(percent(F.col(f"{c}_rows_{p}"), F.col(f"total_{p}")).alias(f"pct_{p}"))
        parts.append(F.col(f"{c}_items").alias("items"))
        cells.append(F.struct(*parts))
    return totals.select(F.inline(F.array(*cells)))


def other_labels(items: DataFrame) -> DataFrame:
    """Items outside the six categories: known other labels and unrecognised ones."""
    name = F.when(F.col("is_other_label"), F.col("label")).otherwise("unrecognized")
    return (
        items.filter(F.col("category") == "").groupBy(name.alias("label")).agg(
            F.count(F.lit(1)).alias("items")
        )
    )


def sublabel_split(items: DataFrame) -> DataFrame:
    """Labels within each category, by predicted class."""
    counted = (
        items.filter(F.col("category") != "")
        .groupBy("category", "label")
        .agg(F.count(F.lit(1)).alias("n"), *_by_predicted(F.lit(True), "n_"))
    )
    # the table now has one row per label of a fixed vocabulary
    whole = Window.partitionBy("category")
    out = {"pct_of_category": percent(F.col("n"), F.sum("n").over(whole))}
    for p in PREDICTED:
        out[f"pct_{p}"] = percent(F.col(f"n_{p}"), F.sum(f"n_{p}").over(whole))
    return counted.withColumns(out)


def category_by_language(rows: DataFrame, flag: str) -> DataFrame:
    """Rows with one category per prompt language, by predicted class."""
    hit = F.col(flag) == 1
    counted = rows.groupBy("language").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("rows"),
        *_by_predicted(F.lit(True), "total_"),
        *_by_predicted(hit, "rows_"),
    )
    out = {"pct": percent(F.col("rows"), F.col("total"))}
    for p in PREDICTED:
        out[f"pct_{p}"] = percent(F.col(f"rows_{p}"), F.col(f"total_{p}"))
    return counted.withColumns(out).drop("total", *[f"total_{p}" for p in PREDICTED])


def top_values(
    counted: DataFrame, group: Sequence[str], value: str, n: int, count: str = "n"
) -> DataFrame:
    """Most frequent values per group; equal counts in value order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(count), value))
    return counted.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def top_predicates(items: DataFrame, n: int = fixed.TOP_PREDICATES) -> DataFrame:
    counted = (
        items.filter((F.col("category") != "") & (F.col("predicate") != ""))
        .groupBy("category", "predicate")
        .agg(F.count(F.lit(1)).alias("n"), *_by_predicted(F.lit(True), "n_"))
    )
    return top_values(counted, ["category"], "predicate", n)


def keywords(
    df: DataFrame, group: Sequence[str], text: str, stopwords, size: int, n: int = fixed.TOP_KEYWORDS
) -> DataFrame:
    """Top words (size 1) or word pairs (size 2) per group, over the whole texts."""
    # the token list is a column of its own, so that it is computed once per text
    tokens = df.select(
        *group, content_words(F.col(text), stopwords).alias("_tokens")
    )
    if size == 1:
        terms = tokens.select(*group, F.explode("_tokens").alias("term"))
    else:
        pairs = tokens.select(*group, F.inline(bigrams(F.col("_tokens"))).alias("_first", "_second"))
        terms = pairs.where("_second IS NOT NULL").select(*group, F.concat("_first", F.lit(" "), "_second").alias("term"))
    counted = terms.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("n"))
    return top_values(counted, group, "term", n)


def fluency_rows(df: DataFrame, score: str = "score", comment: str = "comment") -> DataFrame:
    """Below-best fluency verdicts with category list and indicator columns."""
    rows = df.filter(F.col(score) < fixed.MAX_SCORE).withColumn(
        "categories", C.fluency_categories(F.col(comment))
    )
    return rows.withColumns(
        {
            f"has_{name}": F.array_contains("categories", name).cast("int")
            for name, _ in fixed.FLUENCY_PATTERNS
        }
    )


def leakage(sentences: DataFrame, predicates: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Untranslated predicates per sentence; ``predicates`` holds an array per entry.

    The predicate lists are short (one entry), so the join carries them to the
    sentences instead of exploding sentence x predicate pairs.
    """
    joined = sentences.join(predicates, list(keys), "left")
    none = F.array().cast("array<string>")
    hits = F.coalesce(leaked_predicates(F.col("sentence"), F.col("predicates")), none)
    return joined.withColumn("leaks", hits)


def leakage_summary(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    size = F.size("leaks")
    counted = grouping_sets(
        rows,
        sets,
        [
            F.count(F.lit(1)).alias("records"),
            F.count_if(size > 0).alias("predicate_leak_rows"),
            F.sum(size.cast("long")).alias("predicate_leak_mentions"),
        ],
    )
    return counted.withColumn(
        "predicate_leak_row_pct", percent(F.col("predicate_leak_rows"), F.col("records"))
    )


def leakage_predicates(rows: DataFrame) -> DataFrame:
    return (
        rows.select(F.explode("leaks").alias("predicate"))
        .groupBy("predicate")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
