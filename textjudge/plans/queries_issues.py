"""Issue, error-category, leakage and keyword queries (B21-B22, D4, D6, D16, E21, E26-E29) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.keys import KEY
from textjudge.operators import issues as I
from textjudge.operators import scores as S
from textjudge.operators.joins import join_left_default
from textjudge.plans.queries_scores import grouping_name, latest_faith, with_group, with_size
from textjudge.plans.queries_text import judged_records, keyword_oracle
from textjudge.plans.queries_votes import votes
from textjudge.plans.registry import helper, query
from textjudge.plans.views import Tables

_KEYS = ", ".join(KEY)
_CATS = fixed.REPORT_ISSUE_CATEGORIES
_DEEP = fixed.DEEP_ISSUE_CATEGORIES
_PRED = ("FA", "FI", "CFA")


def predicted(t: Tables):
    return votes(t).select(*KEY, F.col("vote_label_order").alias("predicted_label"))


def latest_with_issues(t: Tables):
    """Latest judgments with the issue categories of that same judgment."""
    records = I.with_report_categories(judged_records(t)).select("event_id", "issue_categories")
    none = F.array().cast("array<string>")
    return join_left_default(latest_faith(t), records, ["event_id"], {"issue_categories": none})


helper("o_latest_cats", """SELECT f.*, coalesce(issue_categories, CASE WHEN score BETWEEN 1 AND 4 THEN 'not_given' ELSE '' END) AS issue_categories
  FROM v_latest_faith f LEFT JOIN o_report_cats c ON c.event_id = f.event_id""")


@query("attach_issues", f"SELECT {_KEYS}, score, issue_categories FROM o_latest_cats")
def attach_issues(t: Tables):
    return latest_with_issues(t).select(
        *KEY, "score", F.array_join("issue_categories", "; ").alias("issue_categories")
    )


def _incidence_sql(keys: list[str], sets: str, source: str) -> str:
    has = lambda c: f"list_contains(string_split(issue_categories, '; '), '{c}')"
    counts = ", ".join(f"count(*) FILTER ({has(c)}) AS c{i}" for i, c in enumerate(_CATS))
    cols = ", ".join(keys)
    parts = " UNION ALL ".join(
        f"""SELECT {cols}, grp AS "grouping", n, '{c}' AS category, c{i} AS rows, c{i} * 100.0::DOUBLE / n AS pct FROM g"""
        for i, c in enumerate(_CATS)
    )
    return f"""WITH g AS (SELECT {cols}, {grouping_name(keys)} AS grp, count(*) AS n, {counts}
      FROM {source} GROUP BY GROUPING SETS {sets}) {parts}"""


_GROUPED = """(SELECT *, CASE WHEN language = 'en' THEN 'EN' WHEN language = 'hsb' THEN 'HSB'
  WHEN language = split_part(dataset, '-', 1) THEN 'Same' ELSE 'Other' END AS lang_group FROM o_latest_cats) q"""


@query("issue_by_model", _incidence_sql(["model"], "((model), ())", "o_latest_cats"))
def issue_by_model(t: Tables):
    return I.incidence(latest_with_issues(t), [["model"], []])


@query("issue_by_language", _incidence_sql(["lang_group"], "((lang_group))", _GROUPED))
def issue_by_language(t: Tables):
    return I.incidence(with_group(latest_with_issues(t)), [["lang_group"]])


@query("language_balance", f"""SELECT count(*) AS groups, min(n) AS smallest, max(n) AS largest, min(n) = max(n) AS balanced
  FROM (SELECT lang_group, count(*) AS n FROM {_GROUPED} GROUP BY ALL) s""")
def language_balance(t: Tables):
    return I.is_balanced(with_group(latest_faith(t)), "lang_group")


@query("issue_by_variant", _incidence_sql(["variant"], "((variant), ())", "o_latest_cats"))
def issue_by_variant(t: Tables):
    return I.incidence(latest_with_issues(t), [["variant"], []])


@query("issue_by_size_predicted", _incidence_sql(
    ["size_group", "predicted_label"], "((size_group, predicted_label))",
    f"""(SELECT c.*, size_group, vote_first_seen AS predicted_label FROM o_latest_cats c JOIN o_votes USING ({_KEYS})
      JOIN o_size USING (model) WHERE vote_first_seen <> '') q"""))
def issue_by_size_predicted(t: Tables):
    rows = latest_with_issues(t).join(
        votes(t).select(*KEY, F.col("vote_first_seen").alias("predicted_label")), KEY
    )
    rows = with_size(rows.filter(F.col("predicted_label") != ""))
    return I.incidence(rows, [["size_group", "predicted_label"]])


@query("issue_counts", """SELECT category, count(*) AS all_rows, count(*) FILTER (score BETWEEN 1 AND 4) AS below_5_rows
  FROM (SELECT score, unnest(string_split(coalesce(issue_categories, CASE WHEN score BETWEEN 1 AND 4 THEN 'not_given' ELSE '' END), '; ')) AS category
    FROM v_judged_faith j LEFT JOIN o_report_cats c ON c.event_id = j.event_id) x WHERE category <> '' GROUP BY category""")
def issue_counts(t: Tables):
    return I.issue_counts(I.with_report_categories(judged_records(t)))


@query("issue_examples", """SELECT j.event_id, model, dataset, variant, language, eid, score, issue_categories FROM v_judged_faith j
  JOIN o_report_cats c ON c.event_id = j.event_id
  UNION ALL SELECT event_id, model, dataset, variant, language, eid, score, 'not_given' FROM v_judged_faith
    WHERE score BETWEEN 1 AND 4 AND event_id NOT IN (SELECT event_id FROM o_report_cats)""")
def issue_examples(t: Tables):
    rows = I.with_report_categories(judged_records(t)).filter(F.size("issue_categories") > 0)
    text = F.array_join("issue_categories", "; ").alias("issue_categories")
    return rows.select("event_id", *KEY, "score", text).orderBy(
        "issue_categories", "score", "model", "eid", "event_id"
    )


helper("o_below", f"""SELECT j.event_id, j.model, j.dataset, j.variant, j.language, j.eid, j.score, coalesce(vote_label_order, '') AS predicted_label
  FROM v_judged_faith j LEFT JOIN o_votes v USING ({_KEYS}) WHERE j.score < 5""")
helper("o_below_items", """SELECT i.*, predicted_label FROM o_items i JOIN o_below b ON b.event_id = i.event_id""")


def below_five(t: Tables):
    """Raw below-5 judgments (not deduplicated) with the predicted class of their key."""
    records = judged_records(t).filter(F.col("score") < fixed.MAX_SCORE)
    return join_left_default(records, predicted(t), KEY, {"predicted_label": F.lit("")})


@query("below5_rows", "SELECT b.event_id, b.score, predicted_label, " + ", ".join(
    f"coalesce(max((category = '{c}')::INT), 0) AS has_{c}" for c in _DEEP) + """,
  coalesce(string_agg(DISTINCT label, '; ' ORDER BY label) FILTER (label <> ''), '') AS labels, count(i.event_id)::INT AS num_items
  FROM o_below b LEFT JOIN o_items i ON i.event_id = b.event_id GROUP BY b.event_id, b.score, predicted_label""")
def below5_rows(t: Tables):
    rows = I.below_five_rows(below_five(t))
    flags = [f"has_{c}" for c in _DEEP]
    return rows.select("event_id", "score", "predicted_label", *flags, "labels", "num_items")


@query("error_items", """SELECT event_id, item_index, predicted_label, label,
  category, is_other_label, predicate, comment_detail FROM o_below_items""")
def error_items(t: Tables):
    items = I.item_details(below_five(t), ["event_id", "predicted_label"])
    return items.drop("comment")


@query("category_overview", "SELECT category, rows, rows * 100.0::DOUBLE / total AS pct, " + ", ".join(
    f"""rows_{p} AS "rows_{p}", rows_{p} * 100.0::DOUBLE / nullif(total_{p}, 0) AS "pct_{p}" """ for p in _PRED) + """, items
  FROM (SELECT category, count(DISTINCT event_id) AS rows, count(*) AS items, """ + ", ".join(
    f"count(DISTINCT event_id) FILTER (predicted_label = '{p}') AS rows_{p}" for p in _PRED) + """
    FROM o_below_items WHERE category <> '' GROUP BY category) a,
  (SELECT count(*) AS total, """ + ", ".join(
    f"count(*) FILTER (predicted_label = '{p}') AS total_{p}" for p in _PRED) + " FROM o_below) b")
def category_overview(t: Tables):
    return I.category_overview(below_five(t))


def item_rows(t: Tables):
    return I.item_details(below_five(t), ["event_id", "language", "predicted_label"])


@query("other_labels", """SELECT CASE WHEN is_other_label THEN label ELSE 'unrecognized' END AS label, count(*) AS items
  FROM o_below_items WHERE category = '' GROUP BY ALL""")
def other_labels(t: Tables):
    return I.other_labels(item_rows(t))


@query("sublabel_split", "SELECT category, label, n, n * 100.0::DOUBLE / sum(n) OVER w AS pct_of_category, " + ", ".join(
    f"""n_{p} AS "n_{p}", n_{p} * 100.0::DOUBLE / nullif(sum(n_{p}) OVER w, 0) AS "pct_{p}" """ for p in _PRED) + """
  FROM (SELECT category, label, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER (predicted_label = '{p}') AS n_{p}" for p in _PRED) + """
    FROM o_below_items WHERE category <> '' GROUP BY ALL) a WINDOW w AS (PARTITION BY category)""")
def sublabel_split(t: Tables):
    return I.sublabel_split(item_rows(t))


@query("category_by_language", "SELECT language, rows, rows * 100.0::DOUBLE / total AS pct, " + ", ".join(
    f"""rows_{p} AS "rows_{p}", rows_{p} * 100.0::DOUBLE / nullif(total_{p}, 0) AS "pct_{p}" """ for p in _PRED) + """
  FROM (SELECT language, count(*) AS total, count(*) FILTER (hit) AS rows, """ + ", ".join(
    f"count(*) FILTER (predicted_label = '{p}') AS total_{p}, count(*) FILTER (hit AND predicted_label = '{p}') AS rows_{p}"
    for p in _PRED) + """ FROM (SELECT *, event_id IN (SELECT event_id FROM o_items WHERE category = 'Lang') AS hit FROM o_below) x
    GROUP BY language) a""")
def category_by_language(t: Tables):
    return I.category_by_language(I.below_five_rows(below_five(t)), "has_Lang")


@query("top_predicates", """SELECT category, predicate, n, """ + ", ".join(f'n_{p} AS "n_{p}"' for p in _PRED) + """
  FROM (SELECT category, predicate, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER (predicted_label = '{p}') AS n_{p}" for p in _PRED) + """,
    row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, predicate) AS rn
    FROM o_below_items WHERE category <> '' AND predicate <> '' GROUP BY category, predicate) a WHERE rn <= 20""")
def top_predicates(t: Tables):
    return I.top_predicates(item_rows(t))


@query("error_keywords", keyword_oracle(
    "(SELECT * FROM o_below_items WHERE category <> '')", "category", "comment_detail", fixed.ERROR_STOPWORDS, 1))
def error_keywords(t: Tables):
    items = item_rows(t).filter(F.col("category") != "")
    return I.keywords(items, ["category"], "comment_detail", fixed.ERROR_STOPWORDS, 1)


@query("error_bigrams", keyword_oracle(
    "(SELECT * FROM o_below_items WHERE category <> '')", "category", "comment_detail", fixed.ERROR_STOPWORDS, 2))
def error_bigrams(t: Tables):
    items = item_rows(t).filter(F.col("category") != "")
    return I.keywords(items, ["category"], "comment_detail", fixed.ERROR_STOPWORDS, 2)


helper("o_fluency", f"""SELECT j.event_id, j.model, j.language, j.comment, coalesce(vote_label_order, '') AS predicted_label, """
       + ", ".join(f"regexp_matches(comment, '(?i){p}')::INT AS has_{n}" for n, p in fixed.FLUENCY_PATTERNS)
       + f""" FROM v_judged_fluency j LEFT JOIN o_votes v USING ({_KEYS}) WHERE j.score < 5""")
_FLU = [n for n, _ in fixed.FLUENCY_PATTERNS]


def fluency_below(t: Tables):
    rows = I.fluency_rows(t.v_judged_fluency)
    return join_left_default(rows, predicted(t), KEY, {"predicted_label": F.lit("")})


@query("fluency_below5_rows", "SELECT event_id, predicted_label, " + ", ".join(f"has_{n}" for n in _FLU) + " FROM o_fluency")
def fluency_below5_rows(t: Tables):
    return fluency_below(t).select("event_id", "predicted_label", *[f"has_{n}" for n in _FLU])


_FLU_SETS = "((language), (predicted_label), ())"


@query("fluency_category_incidence", "WITH g AS (SELECT language, predicted_label, "
       + grouping_name(["language", "predicted_label"]) + " AS grp, count(*) AS n, "
       + ", ".join(f"sum(has_{n})::BIGINT AS c{i}" for i, n in enumerate(_FLU))
       + f" FROM o_fluency GROUP BY GROUPING SETS {_FLU_SETS}) " + " UNION ALL ".join(
           f"""SELECT language, predicted_label, grp AS "grouping", n, '{c}' AS category, c{i} AS rows, c{i} * 100.0::DOUBLE / n AS pct FROM g"""
           for i, c in enumerate(_FLU)))
def fluency_category_incidence(t: Tables):
    return I.incidence(
        fluency_below(t), [["language"], ["predicted_label"], []], names=_FLU, column="categories"
    )


@query("fluency_keywords", keyword_oracle(
    "(SELECT language, comment FROM o_fluency)", "language", "comment", fixed.FLUENCY_STOPWORDS, 2))
def fluency_keywords(t: Tables):
    rows = t.v_judged_fluency.filter(F.col("score") < fixed.MAX_SCORE)
    return I.keywords(rows, ["language"], "comment", fixed.FLUENCY_STOPWORDS, 2)


_FLU_LONG = "(" + " UNION ALL ".join(f"SELECT '{n}' AS category, comment FROM o_fluency WHERE has_{n} = 1" for n in _FLU) + ")"


def fluency_by_category(t: Tables):
    # the outer form gets no filter on the size of the list, so each comment is classified once
    rows = I.fluency_rows(t.v_judged_fluency).select(F.explode_outer("categories").alias("category"), "comment")
    return rows.where("category IS NOT NULL")


@query("fluency_category_keywords", keyword_oracle(_FLU_LONG, "category", "comment", fixed.FLUENCY_STOPWORDS, 1))
def fluency_category_keywords(t: Tables):
    return I.keywords(fluency_by_category(t), ["category"], "comment", fixed.FLUENCY_STOPWORDS, 1)


@query("fluency_category_bigrams", keyword_oracle(_FLU_LONG, "category", "comment", fixed.FLUENCY_STOPWORDS, 2))
def fluency_category_bigrams(t: Tables):
    return I.keywords(fluency_by_category(t), ["category"], "comment", fixed.FLUENCY_STOPWORDS, 2)


# --- leakage ---------------------------------------------------------------

helper("o_leaks", """SELECT source_id, o.eid, p.predicate FROM v_outputs o
  JOIN (SELECT DISTINCT eid, predicate FROM v_triples) p ON p.eid = o.eid
  WHERE regexp_matches(p.predicate, '[a-z][A-Z]')
    AND regexp_matches(sentence, concat('(^|[^A-Za-z0-9_])', p.predicate, '($|[^A-Za-z0-9_])'))""")


def leak_rows(t: Tables):
    predicates = t.v_triples.groupBy("eid").agg(F.collect_set("predicate").alias("predicates"))
    return I.leakage(t.v_outputs, predicates)


@query("predicate_leakage", """SELECT o.source_id, o.eid, coalesce(string_agg(predicate, '; ' ORDER BY predicate), '') AS leaks,
  count(predicate)::INT AS leak_count FROM v_outputs o LEFT JOIN o_leaks l ON l.source_id = o.source_id AND l.eid = o.eid GROUP BY o.source_id, o.eid""")
def predicate_leakage(t: Tables):
    return leak_rows(t).select(
        "source_id", "eid", F.array_join("leaks", "; ").alias("leaks"), F.size("leaks").alias("leak_count")
    )


@query("leakage_summary", f"""SELECT source_id, {grouping_name(['source_id'])} AS "grouping", count(*) AS records,
  count(*) FILTER (n > 0) AS predicate_leak_rows, sum(n)::BIGINT AS predicate_leak_mentions,
  count(*) FILTER (n > 0) * 100.0::DOUBLE / count(*) AS predicate_leak_row_pct
  FROM (SELECT o.source_id, o.eid, count(predicate) AS n FROM v_outputs o
    LEFT JOIN o_leaks l ON l.source_id = o.source_id AND l.eid = o.eid GROUP BY ALL) x GROUP BY GROUPING SETS ((source_id), ())""")
def leakage_summary(t: Tables):
    return I.leakage_summary(leak_rows(t), [["source_id"], []])


@query("leakage_predicates", "SELECT predicate, count(*) AS mentions FROM o_leaks GROUP BY predicate")
def leakage_predicates(t: Tables):
    return I.leakage_predicates(leak_rows(t))


@query("leakage_examples", """SELECT source_id, eid, string_agg(predicate, '; ' ORDER BY predicate) AS leaks, count(*)::INT AS leak_count
  FROM o_leaks GROUP BY source_id, eid""")
def leakage_examples(t: Tables):
    rows = leak_rows(t).withColumn("leak_count", F.size("leaks")).filter("leak_count > 0")
    return rows.orderBy(F.desc("leak_count"), "source_id", "eid").select(
        "source_id", "eid", F.array_join("leaks", "; ").alias("leaks"), "leak_count"
    )


# --- judged rows with their source entry -----------------------------------


@query("enrich_judged", """SELECT source_id, eid, e.category, e.triple_count, e.triples, e.predicates FROM v_outputs o
  JOIN (SELECT eid, min(category) AS category, count(*)::INT AS triple_count,
    string_agg(concat(subject, ' | ', predicate, ' | ', object), '; ' ORDER BY pos) AS triples,
    string_agg(predicate, '; ' ORDER BY pos) AS predicates FROM v_triples GROUP BY eid) e USING (eid)""")
def enrich_judged(t: Tables):
    from textjudge.operators.construct import enrich_judged as enrich, entries

    return enrich(t.v_outputs, entries(t.v_triples)).select(
        "source_id", "eid", "category", "triple_count", "triples", "predicates"
    )


@query("enrich_sentences", """SELECT source_id, eid, sentence, category, triple_count, modified_triples FROM v_outputs
  JOIN (SELECT eid, min(category) AS category, count(*)::INT AS triple_count,
    string_agg(concat('- ', replace(subject, '_', ' '), ' | ', predicate, ' | ', replace(object, '_', ' ')), chr(10) ORDER BY pos) AS modified_triples
    FROM v_triples GROUP BY eid) e USING (eid) WHERE trim(sentence) <> ''""")
def enrich_sentences(t: Tables):
    from textjudge.operators.construct import enrich_sentences as enrich, entries

    return enrich(t.v_outputs, entries(t.v_triples)).select(
        "source_id", "eid", "sentence", "category", "triple_count", "modified_triples"
    )


@query("low_score_share", """SELECT 'faithfulness' AS metric, count(*) FILTER (score < 5) * 100.0::DOUBLE / count(*) AS below_5_pct,
    count(*) FILTER (score <= 2) * 100.0::DOUBLE / count(*) AS low_pct FROM v_latest_faith
  UNION ALL SELECT 'fluency', count(*) FILTER (score < 5) * 100.0::DOUBLE / count(*), count(*) FILTER (score <= 2) * 100.0::DOUBLE / count(*)
    FROM v_latest_fluency""")
def low_score_share(t: Tables):
    from textjudge.plans.queries_scores import latest_fluency

    parts = []
    for metric, rows in (("faithfulness", latest_faith(t)), ("fluency", latest_fluency(t))):
        stats = S.score_stats(rows, eid=None)
        below = F.lit(100.0) * (F.col("valid_scored_records") - F.col("score_5_count"))
        parts.append(stats.select(
            F.lit(metric).alias("metric"),
            F.try_divide(below, F.col("valid_scored_records")).alias("below_5_pct"),
            F.col("failure_pct").alias("low_pct"),
        ))
    return parts[0].unionByName(parts[1])
