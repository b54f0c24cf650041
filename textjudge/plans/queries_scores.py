"""Score queries (E1-E7, E19, E22-E23, E30, S1, S2, W1) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import keys as K
from textjudge.functions.columns import lookup, share
from textjudge.operators import scores as S
from textjudge.plans.registry import helper, query
from textjudge.plans.views import Tables

COMBO = ["model", "dataset", "variant", "language"]
# size classes of the synthetic models m0..m8
SIZE = {"m0": "Large", "m1": "Large", "m2": "Medium", "m3": "Medium", "m4": "Medium",
        "m5": "Medium", "m6": "Small", "m7": "Small", "m8": "Small"}
helper(
    "o_size",
    "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{g}')" for m, g in SIZE.items())
    + ") AS t(model, size_group)",
)

_STATS_SQL = """
  records, unique_eids, score_1_count, score_2_count, score_3_count, score_4_count, score_5_count,
  valid AS valid_scored_records, records - valid AS invalid_score_records,
  CASE WHEN valid > 0 THEN total / valid END AS mean_score,
  median_score,
  sqrt(greatest(squares / valid - (total / valid) * (total / valid), 0.0)) AS stddev_score,
  min_score, max_score,
  coalesce(score_1_count * 100.0::DOUBLE / valid, 0.0) AS score_1_pct,
  coalesce(score_2_count * 100.0::DOUBLE / valid, 0.0) AS score_2_pct,
  coalesce(score_3_count * 100.0::DOUBLE / valid, 0.0) AS score_3_pct,
  coalesce(score_4_count * 100.0::DOUBLE / valid, 0.0) AS score_4_pct,
  coalesce(score_5_count * 100.0::DOUBLE / valid, 0.0) AS score_5_pct,
  coalesce(score_5_count * 100.0::DOUBLE / valid, 0.0) AS strict_success_pct,
  coalesce((score_4_count + score_5_count) * 100.0::DOUBLE / valid, 0.0) AS lenient_success_pct,
  coalesce((score_1_count + score_2_count) * 100.0::DOUBLE / valid, 0.0) AS failure_pct,
  coalesce(score_3_count * 100.0::DOUBLE / valid, 0.0) AS mixed_pct"""
_COUNT_SQL = """
  count(*) AS records, count(DISTINCT eid) AS unique_eids,
  count(*) FILTER (score = 1) AS score_1_count, count(*) FILTER (score = 2) AS score_2_count,
  count(*) FILTER (score = 3) AS score_3_count, count(*) FILTER (score = 4) AS score_4_count,
  count(*) FILTER (score = 5) AS score_5_count,
  count(*) FILTER (score BETWEEN 1 AND 5) AS valid,
  sum(score) FILTER (score BETWEEN 1 AND 5)::DOUBLE AS total,
  sum(score * score) FILTER (score BETWEEN 1 AND 5)::DOUBLE AS squares,
  median(score) FILTER (score BETWEEN 1 AND 5) AS median_score,
  min(score) FILTER (score BETWEEN 1 AND 5) AS min_score,
  max(score) FILTER (score BETWEEN 1 AND 5) AS max_score"""


def grouping_name(keys) -> str:
    parts = ", ".join(f"CASE WHEN grouping({k}) = 0 THEN '{k}' END" for k in keys)
    return f"concat_ws('+', {parts})"


def stats_oracle(keys: str, source: str) -> str:
    lead, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {lead}{_STATS_SQL} FROM (SELECT {lead}{_COUNT_SQL} FROM {source} {group}) c"


def with_size(df):
    return df.withColumn("size_group", lookup(F.col("model"), SIZE))


def with_group(df):
    return df.withColumn("lang_group", K.language_group(F.col("dataset"), F.col("language")))


def latest_faith(t: Tables):
    return S.latest(t.v_judged_faith.filter(S.valid_score(F.col("score"))))


def latest_fluency(t: Tables):
    return S.latest(t.v_judged_fluency.filter(S.valid_score(F.col("score"))))


LANG_GROUP_SQL = """CASE WHEN language = 'en' THEN 'EN' WHEN language = 'hsb' THEN 'HSB'
  WHEN language = split_part(dataset, '-', 1) THEN 'Same' ELSE 'Other' END"""


@query("latest_judgments", "SELECT model, dataset, variant, language, eid, event_id, score FROM v_latest_faith")
def latest_judgments(t: Tables):
    return latest_faith(t).select(*K.KEY, "event_id", "score")


@query(
    "faith_by_language_group",
    f"""SELECT model, {LANG_GROUP_SQL} AS lang_group, avg(score) AS mean_score, count(*) AS n,
      sum(score)::DOUBLE * 20.0::DOUBLE / count(*) AS mean_pct
    FROM v_latest_faith GROUP BY ALL""",
)
def faith_by_language_group(t: Tables):
    out = (
        with_group(latest_faith(t))
        .groupBy("model", "lang_group")
        .agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    )
    # a score of 5 is 100 percent
    return out.select(
        "model", "lang_group", "n",
        share(F.col("s"), F.col("n")).alias("mean_score"),
        share(F.col("s") * (100 // fixed.MAX_SCORE), F.col("n")).alias("mean_pct"),
    )


@query(
    "fluency_by_language_group",
    f"""SELECT model, {LANG_GROUP_SQL} AS lang_group, avg(score) AS mean_score, count(*) AS n
    FROM v_latest_fluency GROUP BY ALL""",
)
def fluency_by_language_group(t: Tables):
    return S.mean_by(with_group(latest_fluency(t)), ["model", "lang_group"])


@query(
    "faith_by_variant",
    "SELECT model, variant, avg(score) AS mean_score, count(*) AS n FROM v_latest_faith GROUP BY ALL",
)
def faith_by_variant(t: Tables):
    return S.mean_by(latest_faith(t), ["model", "variant"])


@query("score_stats_overall", stats_oracle("", "v_judged_faith"))
def score_stats_overall(t: Tables):
    return S.score_stats(t.v_judged_faith)


@query("score_stats_by_combo", stats_oracle(", ".join(COMBO), "v_judged_faith"))
def score_stats_by_combo(t: Tables):
    return S.score_stats(t.v_judged_faith, COMBO)


_SETS = [["dataset"], ["variant"], ["language"], ["model"], COMBO]
_SET_KEYS = ["dataset", "variant", "language", "model"]


@query(
    "score_stats_grouping_sets",
    f"""SELECT dataset, variant, language, model, grp AS "grouping", {_STATS_SQL} FROM (
      SELECT dataset, variant, language, model, {grouping_name(_SET_KEYS)} AS grp, {_COUNT_SQL}
      FROM v_judged_faith GROUP BY GROUPING SETS ((dataset), (variant), (language), (model),
        (model, dataset, variant, language))) c""",
)
def score_stats_grouping_sets(t: Tables):
    return S.score_stats_sets(t.v_judged_faith, _SETS)


@query("fluency_stats", stats_oracle("model, language", "v_judged_fluency"))
def fluency_stats(t: Tables):
    return S.score_stats(t.v_judged_fluency, ["model", "language"])


@query(
    "variant_table",
    f"""SELECT size_group, variant, {grouping_name(['size_group', 'variant'])} AS "grouping",
      avg(score) AS mean_score, count(*) AS n
    FROM v_latest_faith JOIN o_size USING (model)
    GROUP BY GROUPING SETS ((size_group, variant), (size_group), (variant), ())""",
)
def variant_table(t: Tables):
    return S.mean_sets(
        with_size(latest_faith(t)),
        [["size_group", "variant"], ["size_group"], ["variant"], []],
    )


@query(
    "language_condition",
    f"""SELECT metric, size_group, lang_group, {grouping_name(['size_group', 'lang_group'])} AS "grouping",
      avg(score) AS mean_score, count(*) AS n
    FROM (SELECT 'faithfulness' AS metric, model, dataset, language, score FROM v_latest_faith
      UNION ALL SELECT 'fluency', model, dataset, language, score FROM v_latest_fluency) u
    JOIN o_size USING (model), LATERAL (SELECT {LANG_GROUP_SQL} AS lang_group)
    GROUP BY GROUPING SETS ((metric, size_group, lang_group), (metric, lang_group))""",
)
def language_condition(t: Tables):
    cols = ["model", "dataset", "language", "score"]
    both = (
        latest_faith(t).select(F.lit("faithfulness").alias("metric"), *cols)
        .unionByName(latest_fluency(t).select(F.lit("fluency").alias("metric"), *cols))
    )
    out = S.mean_sets(
        with_group(with_size(both)),
        [["metric", "size_group", "lang_group"], ["metric", "lang_group"]],
    )
    return out.withColumn("grouping", F.regexp_replace("grouping", r"^metric\+", ""))


_COMBO_ORDER = "model, dataset, variant, language"


@query(
    "worst_combos",
    "SELECT * FROM (" + stats_oracle(_COMBO_ORDER, "v_judged_faith")
    + f") s ORDER BY failure_pct DESC, records DESC, {_COMBO_ORDER} LIMIT 15",
)
def worst_combos(t: Tables):
    return S.worst_combos(S.score_stats(t.v_judged_faith, COMBO), COMBO)


@query(
    "best_combos",
    "SELECT * FROM (" + stats_oracle(_COMBO_ORDER, "v_judged_faith")
    + f") s ORDER BY lenient_success_pct DESC, mean_score DESC, {_COMBO_ORDER} LIMIT 15",
)
def best_combos(t: Tables):
    return S.best_combos(S.score_stats(t.v_judged_faith, COMBO), COMBO)


@query(
    "score_cases_topn",
    """SELECT score, case_no, model, dataset, variant, language, eid, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY score
        ORDER BY model, dataset, eid, variant, language, event_id) AS case_no
      FROM v_judged_faith WHERE score BETWEEN 1 AND 5) x WHERE case_no <= 20""",
)
def score_cases_topn(t: Tables):
    order = [F.col(c) for c in ("model", "dataset", "eid", "variant", "language", "event_id")]
    return S.score_cases(t.v_judged_faith, 20, order).select(
        "score", "case_no", *K.KEY, "event_id"
    )
