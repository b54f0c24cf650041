"""Keyed merges, resume gaps, coverage, scopes and prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge.functions.columns import strip, text_or_empty
from textjudge.functions.keys import KEY, endpoint, judge_name, model_candidates
from textjudge.operators.joins import join_left_default
from textjudge.operators.lineage import materialize

RECORD_KEY = ["eid", "source_id", "judge", "at"]


def nonempty(text: Column) -> Column:
    return strip(text_or_empty(text)) != ""


def with_record_key(df: DataFrame, default_endpoint: str) -> DataFrame:
    """Identity of a judgment record: entry, source, judge and endpoint.

    A record without an endpoint was made by ``default_endpoint``.
    """
    return df.withColumns(
        {
            "judge": judge_name(F.col("requested_judge_model"), F.col("judge_model")),
            "at": endpoint(F.col("requested_judge_api_url"), default_endpoint),
        }
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_nonempty(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str = "sentence"
) -> DataFrame:
    """Last row per key in file order among rows with text; ``order`` lists newest first."""
    return newest(df.filter(nonempty(F.col(text))), keys, order)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return newest(df, keys, order)


def latest_annotations(df: DataFrame, tie: Sequence[Column]) -> DataFrame:
    """Latest annotation per entry and source; a missing time stamp is the oldest."""
    return newest(df, ["eid", "source_id"], [F.col("timestamp").desc_nulls_last(), *tie])


def _present(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``new`` that ``old`` holds.

    Only keys move: the old table is reduced by a semi join against the batch first,
    so it is not shuffled when the batch is small enough to be broadcast at run time.
    """
    batch = new.select(*keys)
    return old.select(*keys).join(batch, list(keys), "left_semi").distinct()


def upsert(
    old: DataFrame,
    new: DataFrame,
    mode: str,
    order: Sequence[Column],
    keys: Sequence[str] = RECORD_KEY,
    text: str = "sentence",
) -> DataFrame:
    """Merge a batch of records into a table of records.

    ``order`` lists newest first and decides between several rows of one key.

    ``append``         old rows stay, new rows are added unless their key was judged
    ``replace_empty``  as append, but old rows without a sentence give way to new rows
    ``overwrite``      one row per key, new before old; old rows without a sentence go

    A judged old row is never lost in the first two modes.
    """
    batch = newest(new, keys, order)
    judged = old.filter(nonempty(F.col(text)))
    if mode == "overwrite":
        kept = newest(judged, keys, order).join(batch.select(*keys), list(keys), "left_anti")
        return kept.unionByName(batch, allowMissingColumns=True)
    added = batch.join(_present(judged, batch, keys), list(keys), "left_anti")
    if mode == "append":
        return old.unionByName(added, allowMissingColumns=True)
    if mode == "replace_empty":
        empty = old.filter(~nonempty(F.col(text))).join(
            batch.select(*keys), list(keys), "left_anti"
        )
        return judged.unionByName(empty).unionByName(added, allowMissingColumns=True)
    raise ValueError(f"unknown mode {mode!r}")


def resume_merge(old: DataFrame, new: DataFrame, key: str = "eid") -> DataFrame:
    """Cell-wise merge: non-empty new cells win, new rows and columns are added."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def cell(c: str) -> Column:
        parts = []
        if c in new.columns:
            value = F.col(f"n.{c}")
            parts.append(F.when(nonempty(value.cast("string")), value))
        if c in old.columns:
            parts.append(F.col(f"o.{c}"))
        elif c in new.columns:
            parts.append(F.col(f"n.{c}"))
        if c == key or (c in old.columns and c in new.columns):
            # a row that is new keeps even its empty cells
            parts.append(F.when(F.col(f"o.{key}").isNull(), F.col(f"n.{c}")))
        return F.coalesce(*parts).alias(c)

    return joined.select(*[cell(c) for c in columns])


def skip_existing(rows: DataFrame, judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that still have to be judged; records without a sentence do not count."""
    done = judged.filter(nonempty(F.col("sentence"))).select(*keys)
    return rows.join(done, list(keys), "left_anti")


def missing_repeats(
    expected: DataFrame, answers: DataFrame, keys: Sequence[str] = KEY, repeats: int = 5
) -> DataFrame:
    """(key, repeat_idx) pairs without an answer.

    The answered repeats of a key are one short list, so the join moves one row per
    key instead of one per repeat.
    """
    given = answers.filter(nonempty(F.col("answer"))).groupBy(*keys).agg(
        F.collect_set("repeat_idx").alias("_given")
    )
    wanted = F.sequence(F.lit(1), F.lit(repeats))
    gap = F.when(F.col("_given").isNull(), wanted).otherwise(F.array_except(wanted, F.col("_given")))
    return expected.select(*keys).join(given, list(keys), "left").select(
        *keys, F.explode(gap).alias("repeat_idx")
    )


def coverage(expected: DataFrame, judged: DataFrame, keys: Sequence[str] = KEY[:4]) -> DataFrame:
    """Expected, judged and missing entries per combo."""
    return _coverage(expected, judged, keys)


def coverage_by_alias(expected: DataFrame, judged: DataFrame, keys: Sequence[str] = KEY[:4]) -> DataFrame:
    """The same where model names of the two trees may differ by one dot or underscore.

    A judged entry counts for every name its model may have; names of expected models are
    taken as they are.
    """
    names = judged.select(*[k for k in keys if k != "model"], "eid", F.explode(model_candidates(F.col("model"))).alias("model"))
    return _coverage(expected, names, keys)


def _coverage(expected: DataFrame, judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    by_entry = [*keys, "eid"]
    done = judged.select(*by_entry).distinct().withColumn("_judged", F.lit(True))
    joined = expected.select(*by_entry).distinct().join(done, by_entry, "left")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected_rows"),
        F.count("_judged").alias("judged_rows"),
        F.count_if(F.col("_judged").isNull()).alias("missing_rows"),
    )


def job_grid(models: DataFrame, tasks, datasets, variants, languages) -> DataFrame:
    """Every combination of the fixed lists for each model, unfolded row by row."""
    grid = models
    for name, values in (
        ("task", tasks), ("dataset", datasets), ("variant", variants), ("language", languages)
    ):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def pending_grid(
    grid: DataFrame, excluded: dict[str, Sequence[str]], existing: DataFrame
) -> DataFrame:
    """Grid without the excluded (data set, variant) pairs and without finished outputs."""
    for dataset, variants in excluded.items():
        grid = grid.filter(~((F.col("dataset") == dataset) & F.col("variant").isin(*variants)))
    keys = ["task", "model", "dataset", "variant", "language"]
    return grid.join(existing.select(*keys).distinct(), keys, "left_anti")


def browse_scope(entries: DataFrame, scope: str, outputs: DataFrame, annotations: DataFrame) -> DataFrame:
    """All entries, those with an output, or those with an annotation."""
    if scope == "all":
        return entries
    other = outputs if scope == "outputs" else annotations
    return entries.join(other.select("eid"), "eid", "left_semi")


def browse_order(df: DataFrame, score: str | None = None, descending: bool = False) -> list[Column]:
    if score is None:
        return [F.col("eid")]
    by = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return [by, F.col("eid")]


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in the given total order.

    Rows are dealt by ranges of the order and numbered inside their range; the sizes of
    the ranges before it are added. The ranges come from a sample, so they are kept.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_rank", rank).join(starts, "_range")
    return placed.withColumn(name, F.col("_start") + F.col("_rank")).drop("_range", "_rank", "_start")


def pending_prefix(rows: DataFrame, pending: Column, limit: int, order: Sequence[str]) -> DataFrame:
    """Rows in order up to and including the ``limit``-th pending one.

    The end of the prefix is found by a distributed top-n over the pending rows; no
    running total over the whole table is needed.
    """
    if limit <= 0:
        return rows
    # both uses of the marked rows read what is written here
    marked = materialize(rows.withColumn("_pending", pending))
    key = F.struct(*order)
    first = marked.filter("_pending").select(key.alias("_key")).orderBy("_key").limit(limit)
    # scalar sub-query: the last key of the prefix, null when fewer rows are pending
    end = first.agg(F.when(F.count(F.lit(1)) == limit, F.max("_key"))).scalar()
    return marked.filter(end.isNull() | (key <= end)).drop("_pending")


def pending_counts(rows: DataFrame, annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, existing and pending rows."""
    done = annotations.select("eid", "source_id").distinct().withColumn("_done", F.lit(True))
    joined = rows.join(done, ["eid", "source_id"], "left")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_done").alias("existing"),
        F.count_if(F.col("_done").isNull()).alias("pending"),
    )


def top_labels(counted: DataFrame, most: int) -> DataFrame:
    """(source_id, label, n, rest): the ``most`` most frequent labels of a source, and one row for all others.

    Ranks beyond ``most`` are cut inside the tasks; the rest is the exact difference of sums.
    """
    best = Window.partitionBy("source_id").orderBy(F.desc("n"), "label")
    top = counted.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most).drop("_rank")
    signed = counted.select("source_id", "n").unionByName(top.select("source_id", (-F.col("n")).alias("n")))
    rest = signed.groupBy("source_id").agg(F.sum("n").alias("n")).where("n > 0")
    none = F.lit(None).cast("string")
    return top.withColumn("rest", F.lit(False)).unionByName(rest.select("source_id", none.alias("label"), "n", F.lit(True).alias("rest")))


def label_counts(rows: DataFrame, most: int = 50) -> DataFrame:
    """Label counts of each source in long form; the vocabulary may be open."""
    counted = materialize(rows.groupBy("source_id", "label").agg(F.count(F.lit(1)).alias("n")))
    return top_labels(counted, most)


def upsert_stored(
    new: DataFrame, path: str, mode: str, order: Sequence[Column], partition_by: Sequence[str],
    keys: Sequence[str] = RECORD_KEY, text: str = "sentence",
) -> None:
    """Merge a batch into the Parquet table at ``path``, which is partitioned by some of the keys.

    Only partitions that the batch touches are read and rewritten. Their files are written
    in a staging folder and moved when the whole job commits, which leaves the marker
    ``_SUCCESS``; a write that dies before leaves the old table as it was.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("the table has to be partitioned by keys")
    stored = new.sparkSession.read.parquet(path)
    touched = new.select(*partition_by).distinct()
    old = stored.join(touched, list(partition_by), "left_semi")
    merged = upsert(old, new, mode, order, keys, text).select(*stored.columns)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def annotation_summary(outputs: DataFrame, latest: DataFrame, most: int = 50) -> DataFrame:
    """Per source: outputs, judged rows, mean score and issues, counts of its ``most`` most frequent labels."""
    joined = outputs.select("source_id", "eid").join(
        latest.select("eid", "source_id", "score", "n_items", "label", F.lit(True).alias("_hit")),
        ["eid", "source_id"],
        "left",
    )
    # labels come from a small vocabulary: count per label first, then list the counts
    by_label = joined.groupBy("source_id", "label").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_hit").alias("_judged"),
        F.sum("score").alias("_sum"),
        F.count("score").alias("_scored"),
        F.sum("n_items").alias("_items"),
    )
    by_label = materialize(by_label)
    counted = by_label.where(nonempty(F.col("label"))).select("source_id", "label", F.col("_rows").alias("n"))
    # at most ``most`` labels and the rest of a source come together
    shown = F.concat(F.coalesce("label", F.lit("other labels")), F.lit(":"), F.col("n").cast("string"))
    entry = F.struct("rest", "label", shown.alias("shown"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["shown"]), ", ")
    labels = top_labels(counted, most).groupBy("source_id").agg(listed.alias("label_counts"))
    sums = by_label.groupBy("source_id").agg(
        F.sum("_rows").alias("rows"),
        F.sum("_judged").alias("judged"),
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_scored")).alias("avg_score"),
        F.try_divide(
            F.coalesce(F.sum("_items"), F.lit(0)).cast("double"), F.sum("_judged")
        ).alias("avg_issues"),
    )
    return join_left_default(sums, labels, ["source_id"], {"label_counts": F.lit("None")})


def entry_scores(latest: DataFrame, visible: Sequence[str]) -> DataFrame:
    """Mean score of each entry over the visible sources."""
    shown = latest.filter(F.col("source_id").isin(*visible) & F.col("score").isNotNull())
    return shown.groupBy("eid").agg(
        F.try_divide(F.sum("score").cast("double"), F.count("score")).alias("annotation_score")
    )


def spend_total(df: DataFrame, cost: str = "request_cost") -> DataFrame:
    """Sum of the request costs; unreadable and missing ones count as zero.

    Added up as decimals, so the total is the same for every partitioning.
    """
    amount = F.col(cost).try_cast("double").cast("decimal(28,10)")
    total = F.sum(F.coalesce(amount, F.lit(0).cast("decimal(28,10)")))
    return df.agg(F.coalesce(total.cast("double"), F.lit(0.0)).alias("spend"))


def seeded_sample(
    df: DataFrame, n: int, key: Sequence[str], seed: int, group: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``n`` rows (per group) in a fixed pseudo-random order.

    Ordering by a hash of seed and key does not depend on row order or partitioning.
    """
    from textjudge.operators.index import hash_number

    draw = hash_number(F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    rows = df.withColumn("_draw", draw)
    order = [F.col("_draw"), *[F.col(k) for k in key]]
    if not group:
        return rows.orderBy(*order).limit(n).drop("_draw")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank", "_draw")


def entry_limit(df: DataFrame, n: int, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """The first ``n`` entries in key order."""
    return df.orderBy(*keys).limit(n)

