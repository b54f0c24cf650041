"""Classification queries (A2, C1-C3, E5-E18, E20, E35, D3, D5) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import labels as L
from textjudge.functions.keys import KEY
from textjudge.operators import scores as S
from textjudge.operators import votes as V
from textjudge.operators.joins import join_one_to_one
from textjudge.plans.queries_scores import (
    grouping_name,
    latest_faith,
    latest_fluency,
    with_size,
)
from textjudge.plans.registry import helper, query
from textjudge.plans.views import Tables

_KEYS = ", ".join(KEY)
_DECOR = "'`*_ .:;-' || chr(9) || chr(10) || chr(13)"


def _word_cases(text: str) -> str:
    return " ".join(
        f"WHEN regexp_matches({text}, '(?i){p}') THEN '{x}'" for x, p in fixed.LABEL_WORD_PATTERNS
    )


def _word_flags(text: str) -> str:
    return " + ".join(
        f"(list_contains(list_transform(found, lambda x: upper(x)), '{x}') OR"
        f" regexp_matches({text}, '(?i){p}'))::INT"
        for x, p in fixed.LABEL_WORD_PATTERNS
    )


helper(
    "o_read",
    f"""SELECT *, trim(coalesce(answer, '')) AS txt,
      upper(trim(coalesce(answer, ''), {_DECOR})) AS compact,
      regexp_extract_all(trim(coalesce(answer, '')), '(?i){fixed.LABEL_TOKEN_PATTERN}', 1) AS found
    FROM v_answers""",
)
helper(
    "o_labels",
    f"""SELECT {_KEYS}, repeat_idx, answer, CASE WHEN txt = '' THEN '' WHEN compact IN ('CFA', 'FA', 'FI') THEN compact
      WHEN len(found) = 1 THEN upper(found[1]) WHEN len(found) > 1 THEN ''
      {_word_cases('txt')} ELSE '' END AS label FROM o_read""",
)
_LEAD = f"regexp_extract(txt, '(?i){fixed.LEADING_LABEL_PATTERN}', 1)"
_NAMED = f"regexp_extract(txt, '(?i){fixed.NAMED_LABEL_PATTERN}', 1)"
helper(
    "o_status",
    f"""SELECT {_KEYS}, repeat_idx, answer, txt, split_part(r, '/', 1) AS label, split_part(r, '/', 2) AS status
    FROM (SELECT *, CASE WHEN txt = '' THEN '/empty' WHEN txt IN ('CFA', 'FA', 'FI') THEN txt || '/exact'
      WHEN compact IN ('CFA', 'FA', 'FI') THEN compact || '/recovered'
      WHEN len(found) > 1 THEN '/multiple'
      WHEN {_LEAD} <> '' THEN upper({_LEAD}) || '/recovered'
      WHEN {_NAMED} <> '' THEN upper({_NAMED}) || '/recovered'
      WHEN {_word_flags('txt')} > 1 THEN '/multiple'
      WHEN len(found) = 1 THEN upper(found[1]) || '/recovered'
      ELSE CASE {_word_cases('txt')} ELSE '' END ||
        CASE WHEN {_word_flags('txt')} = 1 THEN '/recovered' ELSE '/unparsed' END END AS r FROM o_read) q""",
)
helper(
    "o_counts",
    f"""SELECT {_KEYS}, label, count(*) AS n, min(repeat_idx) AS first_idx,
      CASE label WHEN 'CFA' THEN 0 WHEN 'FA' THEN 1 ELSE 2 END AS label_no
    FROM o_labels WHERE label <> '' GROUP BY ALL""",
)
helper(
    "o_votes",
    f"""SELECT k.*, coalesce(vf, '') AS vote_first_seen, coalesce(vo, '') AS vote_label_order,
      parsed = answers AND kinds = 1 AS unanimous, (answers - parsed)::DOUBLE / answers AS invalid_rate,
      CASE variant WHEN 'cf' THEN 'CFA' WHEN 'fa' THEN 'FA' ELSE 'FI' END AS expected
    FROM (SELECT {_KEYS}, count(*) AS answers, count(*) FILTER (label <> '') AS parsed,
        count(DISTINCT label) FILTER (label <> '') AS kinds,
        count(*) FILTER (label = 'CFA') AS n_cfa, count(*) FILTER (label = 'FA') AS n_fa,
        count(*) FILTER (label = 'FI') AS n_fi FROM o_labels GROUP BY ALL) k
    LEFT JOIN (SELECT {_KEYS}, label AS vf FROM o_counts
      QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY n DESC, first_idx) = 1) a USING ({_KEYS})
    LEFT JOIN (SELECT {_KEYS}, label AS vo FROM o_counts
      QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY n DESC, label_no) = 1) b USING ({_KEYS})""",
)
helper(
    "o_soft",
    """SELECT v.*, f.score, f.event_id, coalesce(n_cfa * (60 // nullif(parsed, 0)), 0)::BIGINT AS u_cfa,
      coalesce(n_fa * (60 // nullif(parsed, 0)), 0)::BIGINT AS u_fa,
      coalesce(n_fi * (60 // nullif(parsed, 0)), 0)::BIGINT AS u_fi
    FROM o_votes v JOIN v_latest_faith f USING (model, dataset, variant, language, eid)""",
)
helper(
    "o_soft_long",
    """SELECT *, 'CFA' AS predicted_label, u_cfa AS u FROM o_soft
    UNION ALL SELECT *, 'FA', u_fa FROM o_soft UNION ALL SELECT *, 'FI', u_fi FROM o_soft""",
)


def votes(t: Tables):
    return V.vote_long(t.v_answers)


def scored_votes(t: Tables):
    return join_one_to_one(latest_faith(t).select(*KEY, "score", "event_id"), votes(t))


# up to nine answers per key; shares as plain fractions over the least common denominator
_MANY = f"""SELECT {_KEYS}, repeat_idx, answer FROM v_answers
  UNION ALL SELECT {_KEYS}, repeat_idx + 5 AS repeat_idx, answer FROM v_answers WHERE repeat_idx <= 4"""


@query("soft_means_many_answers", f"""SELECT model, x AS predicted_label, sum(score * n * (2520 // parsed))::DOUBLE / nullif(sum(n * (2520 // parsed)), 0) AS mean_score,
    sum(n * (2520 // parsed))::DOUBLE / 2520 AS effective_count
  FROM (SELECT {_KEYS}, x, count(*) FILTER (label = x) AS n, count(*) FILTER (label <> '') AS parsed
    FROM (SELECT {_KEYS}, label FROM o_labels UNION ALL SELECT {_KEYS}, label FROM o_labels WHERE repeat_idx <= 4) a,
      (VALUES ('CFA'), ('FA'), ('FI')) l(x) GROUP BY ALL HAVING parsed > 0) v
  JOIN v_latest_faith f USING ({_KEYS}) GROUP BY model, x""")
def soft_means_many_answers(t: Tables):
    voted = V.vote_long(t.sql(_MANY))
    return V.soft_means(join_one_to_one(latest_faith(t).select(*KEY, "score"), voted), ["model"])


@query("sanitize_label", f"""
SELECT {_KEYS}, repeat_idx, CASE WHEN answer = '' THEN answer WHEN len(edge) = 1 THEN edge[1]
    WHEN len(edge) > 1 THEN 'INVALID' WHEN len(named) = 1 THEN named[1] WHEN len(named) > 1 THEN 'INVALID'
    ELSE trim(regexp_replace(answer, '\\s+', ' ', 'g')) END AS label
FROM (SELECT *, list_distinct(list_filter([mp[lower(w[1])], mp[lower(w[-1])]], lambda x: x IS NOT NULL)) AS edge,
    list_distinct(list_concat(list_transform(tok, lambda x: mp[lower(x)]), list_filter([
      CASE WHEN regexp_matches(answer, '(?i){fixed.LABEL_WORD_PATTERNS[0][1]}') THEN 'CFA' END,
      CASE WHEN regexp_matches(answer, '(?i){fixed.LABEL_WORD_PATTERNS[1][1]}') THEN 'FI' END,
      CASE WHEN regexp_matches(answer, '(?i){fixed.LABEL_WORD_PATTERNS[2][1]}') THEN 'FA' END], lambda x: x IS NOT NULL))) AS named
  FROM (SELECT *, MAP {{'cf': 'CFA', 'cfa': 'CFA', 'fa': 'FA', 'fi': 'FI'}} AS mp,
    regexp_extract_all(answer, '[A-Za-z]+') AS w,
    regexp_extract_all(answer, '(?i){fixed.SHORT_LABEL_TOKEN_PATTERN}', 1) AS tok FROM v_answers) a) b""")
def sanitize_label(t: Tables):
    return t.v_answers.select(*KEY, "repeat_idx", L.sanitize_answer(F.col("answer")).alias("label"))


@query("parse_label", f"SELECT {_KEYS}, repeat_idx, label FROM o_labels")
def parse_label(t: Tables):
    return t.v_answers.select(*KEY, "repeat_idx", L.parse_label(F.col("answer")).alias("label"))


@query("parse_answer_status", f"SELECT {_KEYS}, repeat_idx, label, status FROM o_status")
def parse_answer_status(t: Tables):
    read = t.v_answers.withColumn("a", L.parse_answer(F.col("answer")))
    return read.select(*KEY, "repeat_idx", "a.label", "a.status")


@query("pivot_repeats", f"""SELECT {_KEYS}, w1 AS sentence, w1 AS sentence_1, w2 AS sentence_2, w3 AS sentence_3,
  w4 AS sentence_4, w5 AS sentence_5 FROM (SELECT {_KEYS}, {", ".join(
    f"max(answer) FILTER (repeat_idx = {i}) AS w{i}" for i in range(1, 6))},
    count(*) FILTER (trim(answer) <> '') AS good FROM v_answers GROUP BY ALL) q WHERE good > 0""")
def pivot_repeats(t: Tables):
    return V.pivot_repeats(t.v_answers)


@query("unpivot_repeats", f"""SELECT {_KEYS}, repeat_idx, answer FROM v_answers
  JOIN (SELECT {_KEYS} FROM v_answers WHERE trim(answer) <> '' GROUP BY ALL) g USING ({_KEYS})""")
def unpivot_repeats(t: Tables):
    return V.unpivot_repeats(V.pivot_repeats(t.v_answers))


@query("majority_vote_first_seen", f"SELECT {_KEYS}, vote_first_seen AS vote FROM o_votes")
def majority_vote_first_seen(t: Tables):
    return votes(t).select(*KEY, F.col("vote_first_seen").alias("vote"))


@query("majority_vote_label_order", f"SELECT {_KEYS}, vote_label_order AS vote FROM o_votes")
def majority_vote_label_order(t: Tables):
    return votes(t).select(*KEY, F.col("vote_label_order").alias("vote"))


@query("vote_shares", f"""SELECT {_KEYS}, unanimous, invalid_rate,
  coalesce(n_cfa::DOUBLE / nullif(parsed, 0), 0.0) AS "vote_share_CFA",
  coalesce(n_fa::DOUBLE / nullif(parsed, 0), 0.0) AS "vote_share_FA",
  coalesce(n_fi::DOUBLE / nullif(parsed, 0), 0.0) AS "vote_share_FI" FROM o_votes""")
def vote_shares(t: Tables):
    shares = [f"vote_share_{x}" for x in fixed.LABELS]
    return votes(t).select(*KEY, "unanimous", "invalid_rate", *shares)


@query("votes_from_wide", f"""SELECT {_KEYS}, vote_first_seen, vote_label_order, unanimous, invalid_rate
  FROM o_votes JOIN (SELECT {_KEYS} FROM v_answers WHERE trim(answer) <> '' GROUP BY ALL) g USING ({_KEYS})""")
def votes_from_wide(t: Tables):
    wide = V.vote_wide(V.pivot_repeats(t.v_answers))
    return wide.select(*KEY, "vote_first_seen", "vote_label_order", "unanimous", "invalid_rate")


_ACC = "100.0::DOUBLE * count(*) FILTER ({0}) / count(*)"
_SOFT_HIT = """(variant = 'cf' AND vote_label_order IN ('CFA', 'FI')) OR (variant = 'fa' AND vote_label_order = 'FA')
  OR (variant = 'fi' AND vote_label_order IN ('FI', 'CFA'))"""


@query("accuracy_hard_soft", f"""SELECT model, dataset, variant, language, count(*) AS n,
  count(*) FILTER (vote_label_order = expected) * 100.0::DOUBLE / count(*) AS hard_accuracy,
  count(*) FILTER ({_SOFT_HIT}) * 100.0::DOUBLE / count(*) AS soft_accuracy FROM o_votes GROUP BY ALL""")
def accuracy_hard_soft(t: Tables):
    return V.accuracy(votes(t), ["model", "dataset", "variant", "language"])


@query("accuracy_pivot", "SELECT model, dataset, variant, " + ", ".join(
    f"""count(*) FILTER (vote_label_order = expected AND language = '{x}') * 100.0::DOUBLE
      / nullif(count(*) FILTER (language = '{x}'), 0) AS accuracy_{x}""" for x in fixed.LANGUAGES)
    + " FROM o_votes GROUP BY ALL")
def accuracy_pivot(t: Tables):
    return V.accuracy_pivot(votes(t), ["model", "dataset", "variant"])


@query("prediction_rates", "SELECT dataset, language, model, " + ", ".join(
    f"""count(*) FILTER (label = '{x}') * 100.0::DOUBLE / nullif(count(*) FILTER (label <> ''), 0) AS "rate_{x}" """
    for x in fixed.LABELS) + " FROM o_labels WHERE repeat_idx = 1 GROUP BY ALL")
def prediction_rates(t: Tables):
    # the bare answer column is the first repeat
    first = t.v_answers.filter("repeat_idx = 1").withColumn("label", L.parse_label(F.col("answer")))
    return V.prediction_rates(first, ["dataset", "language", "model"])


@query("confusion_matrix", """
SELECT language, true_label, predicted_label, count(v.model) AS n,
  count(v.model) * 100.0::DOUBLE / nullif(sum(count(v.model)) OVER (PARTITION BY language, true_label), 0) AS row_pct
FROM (SELECT DISTINCT language FROM o_votes)
CROSS JOIN (VALUES ('CFA'), ('FA'), ('FI')) a(true_label) CROSS JOIN (VALUES ('CFA'), ('FA'), ('FI')) b(predicted_label)
LEFT JOIN (SELECT language AS l, expected, vote_first_seen, model FROM o_votes) v
  ON l = language AND expected = true_label AND vote_first_seen = predicted_label
GROUP BY language, true_label, predicted_label""")
def confusion_matrix(t: Tables):
    return V.confusion_matrix(votes(t), ["language"])


@query("confusion_matrix_pooled", """
SELECT model, true_label, predicted_label, count(v.vote) AS n,
  count(v.vote) * 100.0::DOUBLE / nullif(sum(count(v.vote)) OVER (PARTITION BY model, true_label), 0) AS row_pct
FROM (SELECT DISTINCT model FROM o_votes)
CROSS JOIN (VALUES ('CFA'), ('FA'), ('FI')) a(true_label) CROSS JOIN (VALUES ('CFA'), ('FA'), ('FI')) b(predicted_label)
LEFT JOIN (SELECT model AS m, expected, vote_first_seen AS vote FROM o_votes) v
  ON m = model AND expected = true_label AND vote = predicted_label
GROUP BY model, true_label, predicted_label""")
def confusion_matrix_pooled(t: Tables):
    return V.confusion_matrix(votes(t), ["model"])


_LR_SQL = """SELECT model, label, n, (base + CASE WHEN rn <= 100 - sum(base) OVER (PARTITION BY model) THEN 1 ELSE 0 END)::INT AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rest DESC, label_no) AS rn FROM (
  SELECT model, label, label_no, n, (n * 100) // total AS base, (n * 100) % total AS rest FROM (
    SELECT model, label, label_no, count(v.vote) AS n, sum(count(v.vote)) OVER (PARTITION BY model)::BIGINT AS total
    FROM (SELECT DISTINCT model FROM o_votes) CROSS JOIN (VALUES ('FA', 0), ('FI', 1), ('CFA', 2)) d(label, label_no)
    LEFT JOIN (SELECT model AS m, vote_first_seen AS vote FROM o_votes) v ON m = model AND vote = label
    GROUP BY model, label, label_no) a) b) c"""


@query("label_distribution_lr", _LR_SQL)
def label_distribution_lr(t: Tables):
    return V.label_distribution(votes(t))


_METRICS_SQL = """SELECT model, count(*) AS n,
  count(*) FILTER (vote_first_seen = expected) * 100.0::DOUBLE / count(*) AS accuracy,
  count(*) FILTER (unanimous) * 100.0::DOUBLE / count(*) AS unanimity,
  sum(answers - parsed)::DOUBLE * 100.0::DOUBLE / sum(answers) AS invalid FROM o_votes GROUP BY model"""


@query("classification_metrics", f"""SELECT *,
  round_even(accuracy, 2) = round_even(max(accuracy) OVER (), 2) AS best_accuracy,
  round_even(unanimity, 2) = round_even(max(unanimity) OVER (), 2) AS best_unanimity,
  round_even(invalid, 2) = round_even(min(invalid) OVER (), 2) AS best_invalid FROM ({_METRICS_SQL}) m""")
def classification_metrics(t: Tables):
    return V.classification_metrics(votes(t))


@query("join_faith_classification", f"""SELECT {_KEYS}, score, event_id, vote_first_seen, unanimous
  FROM o_soft""")
def join_faith_classification(t: Tables):
    return scored_votes(t).select(*KEY, "score", "event_id", "vote_first_seen", "unanimous")


@query("split_rows", f"""SELECT {_KEYS}, label AS predicted_label, score FROM o_labels
  JOIN v_latest_faith USING ({_KEYS}) WHERE repeat_idx = 1""")
def split_rows(t: Tables):
    first = t.v_answers.filter("repeat_idx = 1").select(
        *KEY, L.parse_label(F.col("answer")).alias("predicted_label")
    )
    return first.join(latest_faith(t).select(*KEY, "score"), KEY)


@query("split_rows_by_alias", f"""SELECT concat('a.', model) AS model, dataset, variant, language, eid, label AS predicted_label, score
  FROM o_labels JOIN v_latest_faith USING ({_KEYS}) WHERE repeat_idx = 1""")
def split_rows_by_alias(t: Tables):
    from textjudge.operators.joins import join_by_model_alias

    first = t.v_answers.filter("repeat_idx = 1").select(*KEY, L.parse_label(F.col("answer")).alias("predicted_label"))
    scores = latest_faith(t).select(*KEY, "score").withColumn("model", F.concat(F.lit("a_"), "model"))
    return join_by_model_alias(first.withColumn("model", F.concat(F.lit("a."), "model")), scores).where("score IS NOT NULL")


@query("faith_by_classification_split", """SELECT model, dataset, vote_first_seen AS predicted_label, language,
  avg(score) AS mean_score, count(*) AS n FROM o_soft GROUP BY ALL""")
def faith_by_classification_split(t: Tables):
    rows = scored_votes(t).withColumnRenamed("vote_first_seen", "predicted_label")
    return S.mean_by(rows, ["model", "dataset", "predicted_label", "language"])


@query("faith_by_predicted_label", """SELECT model, vote_first_seen AS predicted_label,
  avg(score) AS mean_score, count(*) AS n FROM o_soft WHERE vote_first_seen <> '' GROUP BY ALL""")
def faith_by_predicted_label(t: Tables):
    rows = scored_votes(t).withColumnRenamed("vote_first_seen", "predicted_label")
    return S.mean_by(rows.filter(L.is_label(F.col("predicted_label"))), ["model", "predicted_label"])


@query("soft_weighted_means", """SELECT model, predicted_label, sum(score * u)::DOUBLE / nullif(sum(u), 0) AS mean_score,
  sum(u)::DOUBLE / 60 AS effective_count FROM o_soft_long GROUP BY ALL""")
def soft_weighted_means(t: Tables):
    return V.soft_means(scored_votes(t), ["model"])


@query("perceived_means_by_size", """SELECT size_group, predicted_label,
  sum(score * u)::DOUBLE / nullif(sum(u), 0) AS mean_score, sum(u)::DOUBLE / 60 AS effective_count
  FROM o_soft_long JOIN o_size USING (model) GROUP BY ALL""")
def perceived_means_by_size(t: Tables):
    return V.soft_means(with_size(scored_votes(t)), ["size_group"])


@query("true_perceived_macro", """SELECT true_label, predicted_label,
  list_reduce(list_prepend(0.0::DOUBLE, list(r ORDER BY model)), lambda a, b: a + b) / count(*) AS mean_score,
  sum(w)::DOUBLE / 60 AS effective_count, count(*) AS models
  FROM (SELECT expected AS true_label, predicted_label, model, sum(score * u)::DOUBLE / nullif(sum(u), 0) AS r, sum(u) AS w
    FROM o_soft_long GROUP BY ALL) m WHERE r IS NOT NULL GROUP BY ALL""")
def true_perceived_macro(t: Tables):
    return V.macro_means(scored_votes(t))


@query("model_summary", f"""SELECT m.model, m.n, accuracy, unanimity, pct_fa, pct_fi, pct_cfa, mean_faith, mean_fluency
  FROM ({_METRICS_SQL}) m
  JOIN (SELECT model, max(pct) FILTER (label = 'FA') AS pct_fa, max(pct) FILTER (label = 'FI') AS pct_fi,
    max(pct) FILTER (label = 'CFA') AS pct_cfa FROM ({_LR_SQL}) l GROUP BY model) d USING (model)
  JOIN (SELECT model, avg(score) AS mean_faith FROM v_latest_faith GROUP BY model) f USING (model)
  JOIN (SELECT model, avg(score) AS mean_fluency FROM v_latest_fluency GROUP BY model) u USING (model)""")
def model_summary(t: Tables):
    faith = S.mean_by(latest_faith(t), ["model"], name="mean_faith").drop("n")
    fluency = S.mean_by(latest_fluency(t), ["model"], name="mean_fluency").drop("n")
    return V.model_summary(votes(t)).join(faith, "model").join(fluency, "model")


helper("o_format", f"""SELECT {_KEYS}, count(*) AS answers, count(*) FILTER (status = 'exact') AS exact,
  count(*) FILTER (status IN ('recovered', 'multiple')) AS recovered, count(*) FILTER (status = 'multiple') AS multiple,
  count(*) FILTER (status IN ('unparsed', 'empty')) AS unparsed, count(*) FILTER (status <> 'exact') AS non_exact,
  min(txt) = max(txt) AS raw_unanimous, count(*) FILTER (label <> '') = count(*) AND
  count(DISTINCT label) FILTER (label <> '') = 1 AS unanimous,
  coalesce(array_to_string(list(txt ORDER BY repeat_idx) FILTER (status <> 'exact' AND txt <> ''), ' || '), '') AS raw_examples,
  count(*) FILTER (label = 'CFA') AS c, count(*) FILTER (label = 'FA') AS f, count(*) FILTER (label = 'FI') AS i
  FROM o_status GROUP BY ALL""")
helper("o_format_votes", """SELECT *, CASE WHEN c + f + i = 0 THEN '' WHEN c >= f AND c >= i THEN 'CFA'
  WHEN f >= i THEN 'FA' ELSE 'FI' END AS vote_label,
  CASE variant WHEN 'cf' THEN 'CFA' WHEN 'fa' THEN 'FA' ELSE 'FI' END AS expected_label FROM o_format""")


@query("classification_format", f"""
SELECT model, dataset, variant, language, grp AS "grouping", records, classification_answers, non_exact_answers,
  unparsed_answers, multiple_label_answers, vote_not_unanimous_rows, raw_not_unanimous_rows, majority_vote_correct_rows,
  records - majority_vote_correct_rows AS majority_vote_incorrect_rows,
  non_exact_answers * 100.0::DOUBLE / classification_answers AS non_exact_answer_pct,
  vote_not_unanimous_rows * 100.0::DOUBLE / records AS vote_not_unanimous_pct,
  raw_not_unanimous_rows * 100.0::DOUBLE / records AS raw_not_unanimous_pct,
  majority_vote_correct_rows * 100.0::DOUBLE / records AS majority_vote_correct_pct
FROM (SELECT model, dataset, variant, language, {grouping_name(['model', 'dataset', 'variant', 'language'])} AS grp,
  count(*) AS records, sum(answers)::BIGINT AS classification_answers, sum(non_exact)::BIGINT AS non_exact_answers,
  sum(unparsed)::BIGINT AS unparsed_answers, sum(multiple)::BIGINT AS multiple_label_answers,
  count(*) FILTER (NOT unanimous) AS vote_not_unanimous_rows, count(*) FILTER (NOT raw_unanimous) AS raw_not_unanimous_rows,
  count(*) FILTER (vote_label = expected_label) AS majority_vote_correct_rows
  FROM o_format_votes GROUP BY GROUPING SETS ((model), (model, dataset, variant, language))) s""")
def classification_format(t: Tables):
    return V.format_summary(
        V.answer_format(t.v_answers), [["model"], ["model", "dataset", "variant", "language"]]
    )


@query("classification_format_examples", f"""SELECT {_KEYS}, expected_label, vote_label, answers, exact, recovered, multiple,
  unparsed, non_exact, raw_examples FROM o_format_votes WHERE non_exact > 0""")
def classification_format_examples(t: Tables):
    rows = V.answer_format(t.v_answers).filter("non_exact > 0 OR unparsed > 0")
    return rows.orderBy(F.desc("unparsed"), F.desc("non_exact"), *KEY).select(
        *KEY, "expected_label", "vote_label", "answers", "exact", "recovered", "multiple",
        "unparsed", "non_exact", "raw_examples",
    )


# the two trees name models differently: one writes a dot where the other has an underscore
@query("judged_with_votes", f"""SELECT event_id, vote_label_order FROM v_latest_faith LEFT JOIN o_votes USING ({_KEYS})""")
def judged_with_votes(t: Tables):
    from textjudge.operators.joins import join_by_model_alias

    judged = latest_faith(t).withColumn("model", F.concat(F.lit("a_"), "model"))
    summary = votes(t).withColumn("model", F.concat(F.lit("a."), "model"))
    return join_by_model_alias(judged, summary).select("event_id", "vote_label_order")
