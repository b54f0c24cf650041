"""Human-versus-judge queries (B10, D7, D8, E24, E25, S5) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge.functions.keys import KEY
from textjudge.operators import agreement as A
from textjudge.operators.joins import join_one_to_one
from textjudge.plans.queries_scores import latest_faith, latest_fluency
from textjudge.plans.registry import helper, query
from textjudge.plans.views import Tables

_KEYS = ", ".join(KEY)
helper("o_scored", """SELECT uid, annotator, TRY_CAST(rtrim(human_score, '?') AS DOUBLE) AS human, judge_score AS judge
  FROM v_annotations""")


def paired(t: Tables):
    """Blind sample with human scores joined to the key with judge scores."""
    human = t.v_annotations.select("uid", "annotator", A.human_score(F.col("human_score")).alias("human"))
    key = t.v_annotations.select("uid", F.col("judge_score").alias("judge"))
    return join_one_to_one(human, key, ["uid"])


@query("human_vs_judge", "SELECT uid, annotator, human, judge FROM o_scored")
def human_vs_judge(t: Tables):
    return paired(t)


_BY = """SELECT annotator, count(*) AS n, count(*) FILTER (human = judge)::DOUBLE / count(*) AS exact_agreement,
  count(*) FILTER (abs(human - judge) <= 1)::DOUBLE / count(*) AS within_1_agreement,
  sum(abs(human - judge)) / count(*) AS mean_absolute_error, sum(human) / count(*) AS mean_human,
  sum(judge)::DOUBLE / count(*) AS mean_judge,
  (count(*)::DOUBLE * sum(rh * rj) - sum(rh) * sum(rj)) / sqrt((count(*)::DOUBLE * sum(rh * rh) - sum(rh) * sum(rh))
    * (count(*)::DOUBLE * sum(rj * rj) - sum(rj) * sum(rj))) AS spearman_correlation,
  1.0::DOUBLE - sum((human - judge) * (human - judge)) / (sum(human * human + judge * judge)
    - sum(human) * sum(judge)::DOUBLE * 2.0::DOUBLE / count(*)) AS quadratic_weighted_kappa
  FROM (SELECT annotator, human, judge::DOUBLE AS judge,
    (2 * rank() OVER (PARTITION BY annotator ORDER BY human) + count(*) OVER (PARTITION BY annotator, human) - 1)::DOUBLE AS rh,
    (2 * rank() OVER (PARTITION BY annotator ORDER BY judge) + count(*) OVER (PARTITION BY annotator, judge) - 1)::DOUBLE AS rj
    FROM o_both) r GROUP BY annotator"""
helper("o_both", """SELECT annotator, human, judge FROM o_scored WHERE human IS NOT NULL
  UNION ALL SELECT 'ALL', human, judge FROM o_scored WHERE human IS NOT NULL""")


@query("agreement_metrics", _BY)
def agreement_metrics(t: Tables):
    return A.metrics(paired(t))


@query("score_distribution", """SELECT annotator, series, score, count(v)::DOUBLE / any_value(n) AS share FROM
  (SELECT annotator, count(*) AS n FROM o_scored WHERE human IS NOT NULL GROUP BY annotator) a
  CROSS JOIN (VALUES ('human'), ('judge')) s(series) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) c(score)
  LEFT JOIN (SELECT annotator AS an, 'human' AS se, human AS v FROM o_scored WHERE human IS NOT NULL
    UNION ALL SELECT annotator, 'judge', judge FROM o_scored WHERE human IS NOT NULL) d
  ON an = annotator AND se = series AND v = score GROUP BY annotator, series, score""")
def score_distribution(t: Tables):
    return A.score_distribution(paired(t), "annotator", {"human": "human", "judge": "judge"})


@query("disagreements", """SELECT uid, annotator, human, judge, CAST(human AS INT) - judge AS score_difference
  FROM o_scored WHERE human IS NOT NULL""")
def disagreements(t: Tables):
    return A.disagreements(paired(t))


@query("fluency_fallback", f"""SELECT {_KEYS}, coalesce(CASE WHEN f.k % 2 = 0 THEN 3 END, u.score) AS judge_fluency_score
  FROM v_latest_faith f LEFT JOIN v_latest_fluency u USING ({_KEYS})""")
def fluency_fallback(t: Tables):
    given = F.when(F.col("k") % 2 == 0, 3)
    key = latest_faith(t).select(*KEY, given.alias("judge_fluency_score"))
    return A.with_fallback(key, latest_fluency(t), KEY)


@query("fluency_fallback_misses", f"""SELECT count(*) AS rows, count(*) FILTER (s IS NULL) AS missing FROM (
  SELECT coalesce(CASE WHEN f.k % 2 = 0 THEN 3 END, u.score) AS s
  FROM v_latest_faith f LEFT JOIN v_latest_fluency u USING ({_KEYS})) x""")
def fluency_fallback_misses(t: Tables):
    return fluency_fallback(t).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("judge_fluency_score").isNull()).alias("missing"),
    )
