"""The two end-to-end jobs: the report tree and the results tables of a study.

Both read the record trees once, materialise one enriched table and derive every
report from it with grouping sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import categories as C
from textjudge.functions import keys as K
from textjudge.functions import verdicts as J
from textjudge.functions.columns import lookup
from textjudge.functions.keys import KEY
from textjudge.functions.terms import leaked_predicates
from textjudge.operators import issues as I
from textjudge.operators import resample as R
from textjudge.operators import scores as S
from textjudge.operators import votes as V
from textjudge.operators.construct import entries, entry_text
from textjudge.operators.joins import join_by_model_alias, join_left_default, join_one_to_one
from textjudge.operators.lineage import materialize
from textjudge.operators.merge import coverage_by_alias, newest
from textjudge.sources.judged import bad_lines, latest_order, read_judged
from textjudge.sources.sinks import write_report_tree
from textjudge.sources.tables import bad_files, read_classified, read_generated, read_triples

COMBO = ["model", "dataset", "variant", "language"]
GROUPINGS = [["dataset"], ["variant"], ["language"], ["model"], ["judge_model"], COMBO]


def enriched(
    judged: DataFrame, triples: DataFrame | None = None, answers: DataFrame | None = None
) -> DataFrame:
    """Judgment records with verdict text, issues, source entry, leakage and vote summary.

    Records are not deduplicated here: the report counts every judgment.
    """
    record = F.col("record")
    rows = judged.filter(F.col("record").isNotNull()).withColumns(
        {
            "judge_model": K.judge_name(
                F.try_variant_get("record", "$.requested_judge_model", "string"),
                F.try_variant_get("record", "$.judge_model", "string"),
            ),
            "score": J.score_cascade(record),
            "items": J.items(record),
            "incorrect_information": J.incorrect_information(record),
            "style_comment": J.style_comment(record),
        }
    )
    rows = I.with_report_categories(rows)
    explanation = F.concat_ws(" ", "incorrect_information", "style_comment")
    rows = rows.withColumn("issue_category", C.classify_issue(F.col("sentence"), explanation))
    if triples is not None:
        keys = ["dataset", "variant", "eid"]
        rows = rows.join(entry_text(entries(triples, keys=keys), keys), keys, "left")
        none = F.array().cast("array<string>")
        leaks = leaked_predicates(F.col("sentence"), F.col("predicate_list"))
        rows = rows.withColumn("leaks", F.coalesce(leaks, none))
    if answers is not None:
        rows = join_by_model_alias(rows, V.answer_format(answers), KEY)
    return rows.drop("record")


def flat(df: DataFrame) -> DataFrame:
    """Lists of text as one text each, for formats without lists."""
    lists = [c for c, kind in df.dtypes if kind == "array<string>"]
    return df.withColumns({c: F.array_join(c, "; ") for c in lists})


def first_of(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order, numbered as case_no."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("case_no", rank).where(F.col("case_no") <= n)


def example_reports(rows: DataFrame, sample_size: int, triples: bool, answers: bool) -> dict[str, DataFrame]:
    """Cases and examples: all of them by model, dataset and variant, and samples over all and per scope.

    ``rows`` are enriched judgments. A sample is the first rows of its group by model, dataset,
    entry, variant, language, file and line, so it is the same for every partitioning.
    """
    case = [*COMBO, "eid", "score", "sentence", "incorrect_information", "style_comment", "issue_category", "issue_categories", "path", "line_no"]
    order = [F.col(c) for c in ("model", "dataset", "eid", "variant", "language", "path", "line_no")]
    cases = rows.select(*case).where(S.valid_score(F.col("score")))
    out = {"score_cases": cases}
    for name, scope in {"overall": [], "model": ["model"], "variant": COMBO[:3]}.items():
        out[f"score_samples_{name}"] = S.score_cases(cases, sample_size, order, group=scope)
    issues = rows.select(F.explode("issue_categories").alias("issue"), *case)
    out["issue_examples"] = issues
    out["issue_samples"] = first_of(issues, ["issue"], [F.col("score"), *order], sample_size)
    if triples:
        leaks = rows.select(*case, "leaks", F.size("leaks").alias("leak_count")).where("leak_count > 0")
        out["predicate_leakage_examples"] = leaks
        out["predicate_leakage_samples"] = first_of(leaks, ["language"], [F.desc("leak_count"), *order], sample_size)
    if answers:
        odd = rows.where("non_exact > 0 OR unparsed > 0")
        shown = odd.select(*COMBO, "eid", "expected_label", "vote_label", "answers", "exact", "recovered", "multiple", "unparsed", "non_exact", "raw_examples", "path", "line_no")
        out["classification_format_examples"] = shown
        out["classification_format_samples"] = first_of(shown, ["model"], [F.desc("unparsed"), F.desc("non_exact"), *order], sample_size)
    named = {name: df.withColumnRenamed("model", "generator_model") for name, df in out.items()}
    return {name: flat(df) for name, df in named.items()}


def build_report(
    spark: SparkSession, judged_root: str, out: str, triples_root: str | None = None,
    classified_root: str | None = None, generated_root: str | None = None, sample_size: int = 20,
) -> None:
    """Write all report tables below ``out``.

    Tables with the columns generator_model, dataset and variant are folders by these.
    Coverage needs the generated tree: entries that exist, were judged and are missing.
    """
    judged = read_judged(spark, judged_root)
    triples = read_triples(spark, triples_root) if triples_root else None
    answers = read_classified(spark, classified_root) if classified_root else None
    rows = materialize(enriched(judged, triples, answers))
    stats = S.score_stats(rows, COMBO)
    reports = {
        "score_stats_overall": S.score_stats(rows),
        "score_stats_groupings": S.score_stats_sets(rows, GROUPINGS),
        "worst_combos": S.worst_combos(stats, COMBO),
        "best_combos": S.best_combos(stats, COMBO),
        "issue_counts": I.issue_counts(rows),
    }
    reports |= example_reports(rows, sample_size, triples is not None, answers is not None)
    lost = [bad_files(spark, root) for root in (classified_root, generated_root) if root]
    reports["warnings"] = bad_lines(judged, reduce(DataFrame.unionByName, lost) if lost else None)
    if generated_root:
        reports["coverage"] = coverage_by_alias(read_generated(spark, generated_root), judged.where("score IS NOT NULL"))
    if triples is not None:
        sets = [["model"], ["model", "language"], COMBO]
        reports["predicate_leakage_summary"] = I.leakage_summary(rows, sets)
        reports["predicate_leakage_predicates"] = I.leakage_predicates(rows)
    if answers is not None:
        answered = rows.filter(F.col("answers").isNotNull())
        reports["classification_format_summary"] = V.format_summary(answered, [["model"], COMBO])
    write_report_tree(reports, out)


def results_tables(
    spark: SparkSession, faith_root: str, fluency_root: str, classified_root: str,
    generated_root: str, samples: int = fixed.BOOTSTRAP_SAMPLES,
) -> dict[str, DataFrame]:
    """All result tables of a study, from latest valid judgments."""

    def latest(root: str, key: str) -> DataFrame:
        valid = read_judged(spark, root, key).filter(F.col("score").isNotNull())
        known = newest(valid.filter(F.col("dataset").isNotNull()), KEY, latest_order())
        size = lookup(F.col("model"), fixed.MODEL_SIZE_GROUP)
        group = K.language_group(F.col("dataset"), F.col("language"))
        return known.withColumns({"size_group": size, "lang_group": group})

    faith_records = latest(faith_root, "faithfulness_score").withColumn("items", J.items(F.col("record")))
    cats = I.with_report_categories(faith_records)
    faith = materialize(cats.select(*KEY, "score", "size_group", "lang_group", "issue_categories"))
    fluency = materialize(
        latest(fluency_root, "fluency_score").select(*KEY, "score", "size_group", "lang_group")
    )
    votes = materialize(V.vote_long(read_classified(spark, classified_root)))
    scored = join_one_to_one(faith, votes)
    counts = read_generated(spark, generated_root)
    bucketed = faith.join(counts, KEY, "left").withColumn("bucket", K.triple_bucket(F.col("triple_count")))
    by_bucket = S.mean_sets(bucketed, [["model", "bucket"], ["model"], ["bucket"], []])
    boot = R.PerceivedBootstrap(scored, samples=samples)
    sized = scored.filter(F.col("vote_first_seen") != "").withColumnRenamed("vote_first_seen", "predicted_label")
    both = faith.select(F.lit("faithfulness").alias("metric"), *KEY, "score").unionByName(
        fluency.select(F.lit("fluency").alias("metric"), *KEY, "score")
    )
    means = join_left_default(
        S.mean_by(faith, ["model"], name="mean_faith").drop("n"),
        S.mean_by(fluency, ["model"], name="mean_fluency").drop("n"), ["model"], {},
    )
    conditions = [["size_group", "lang_group"], ["lang_group"]]
    return {
        "model_summary": V.classification_metrics(votes).join(means, "model"),
        "label_distribution": V.label_distribution(votes),
        "confusion_matrix": V.confusion_matrix(votes, ["model"]),
        "triple_buckets": by_bucket.filter(
            F.col("bucket").isNotNull() | ~F.col("grouping").contains("bucket")
        ),
        "predicted_class": V.soft_means(scored, ["model"]),
        "predicted_class_intervals": boot.means(),
        "predicted_class_contrasts": boot.contrasts(),
        "true_predicted": V.macro_means(scored),
        "true_predicted_intervals": R.macro_intervals(scored, samples=samples),
        "language_faith": S.mean_sets(faith, conditions),
        "language_fluency": S.mean_sets(fluency, conditions),
        "variants": S.mean_sets(faith, [["size_group", "variant"], ["size_group"], ["variant"], []]),
        "issues_by_model": I.incidence(faith, [["model"], []]),
        "issues_by_language": I.incidence(faith, [["lang_group"], []]),
        "issues_by_variant": I.incidence(faith, [["variant"], []]),
        "issues_by_class": I.incidence(sized, [["size_group", "predicted_label"]]),
        "model_intervals": R.model_intervals(both, ["metric", "model"], samples=samples),
    }

