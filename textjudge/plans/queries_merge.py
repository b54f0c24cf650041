"""Merge, gap, scope and summary queries (D9-D13, H1-H5, W2-W6, E31-E33, S4, S6, S7) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.keys import KEY
from textjudge.operators import merge as M
from textjudge.operators.joins import union_sources as union_frames
from textjudge.plans.queries_scores import SIZE, latest_faith, latest_fluency
from textjudge.plans.registry import HELPERS, helper, query
from textjudge.plans.views import Tables

_KEYS = ", ".join(KEY)

DEFAULT_ENDPOINT = "https://default.example/v1/chat/completions"

# judgment records of two runs: an existing table and a later batch
_RECORD = """SELECT event_id, eid, concat(model, '__', dataset) AS source_id,
  CASE WHEN k % 3 = 0 THEN '' ELSE concat('j', CAST(k % 2 AS @STR)) END AS requested_judge_model,
  concat('j', CAST(k % 2 AS @STR)) AS judge_model,
  CASE WHEN k % 5 = 0 THEN '' ELSE 'https://judge.example/v1/' END AS requested_judge_api_url,
  CASE WHEN k % 9 = 0 THEN ' ' ELSE concat('text ', CAST(k AS @STR)) END AS sentence, score
  FROM v_judged_faith"""
helper("o_old", _RECORD + " WHERE user_id < 20")
helper("o_new", _RECORD + " WHERE user_id >= 20")
_AT = "CASE WHEN requested_judge_api_url = '' THEN '" + DEFAULT_ENDPOINT + \
    "' ELSE 'https://judge.example/v1/chat/completions' END"
for _name in ("old", "new"):
    helper(f"o_{_name}_keyed", f"""SELECT *, coalesce(nullif(requested_judge_model, ''), judge_model) AS judge, {_AT} AS "at" FROM o_{_name}""")
_RK = 'eid, source_id, judge, "at"'
helper("o_batch", f"SELECT * FROM o_new_keyed QUALIFY row_number() OVER (PARTITION BY {_RK} ORDER BY event_id DESC) = 1")
helper("o_judged", "SELECT * FROM o_old_keyed WHERE trim(sentence) <> ''")
helper("o_added", f"SELECT * FROM o_batch b WHERE NOT EXISTS (SELECT 1 FROM o_judged o WHERE (o.eid, o.source_id, o.judge, o.\"at\") = (b.eid, b.source_id, b.judge, b.\"at\"))")


def runs(t: Tables):
    old, new = (M.with_record_key(t.sql(HELPERS[n]), DEFAULT_ENDPOINT) for n in ("o_old", "o_new"))
    return old, new


def _upsert(t: Tables, mode: str):
    old, new = runs(t)
    return M.upsert(old, new, mode, [F.desc("event_id")]).select("event_id", *M.RECORD_KEY, "sentence")


_OUT = f"event_id, {_RK}, sentence"


@query("upsert_append", f"SELECT {_OUT} FROM o_old_keyed UNION ALL SELECT {_OUT} FROM o_added")
def upsert_append(t: Tables):
    return _upsert(t, "append")


@query("upsert_replace_empty", f"""SELECT {_OUT} FROM o_judged UNION ALL SELECT {_OUT} FROM o_added
  UNION ALL SELECT {_OUT} FROM o_old_keyed o WHERE trim(sentence) = '' AND ({_RK}) NOT IN (SELECT ({_RK}) FROM o_batch)""")
def upsert_replace_empty(t: Tables):
    return _upsert(t, "replace_empty")


@query("upsert_overwrite", f"""SELECT {_OUT} FROM o_batch UNION ALL
  SELECT {_OUT} FROM (SELECT * FROM o_judged QUALIFY row_number() OVER (PARTITION BY {_RK} ORDER BY event_id DESC) = 1) o
  WHERE ({_RK}) NOT IN (SELECT ({_RK}) FROM o_batch)""")
def upsert_overwrite(t: Tables):
    return _upsert(t, "overwrite")


helper("o_wide_old", """SELECT CASE WHEN right(eid, 1) = '3' THEN concat(eid, '-old') ELSE eid END AS eid, max(sentence) FILTER (WHERE source_id = 'src0') AS s0, max(sentence) FILTER (WHERE source_id = 'src1') AS s1
  FROM v_outputs GROUP BY v_outputs.eid""")
helper("o_wide_new", """SELECT CASE WHEN right(eid, 1) = '4' THEN concat(eid, '-new') ELSE eid END AS eid, max(sentence) FILTER (WHERE source_id = 'src2') AS s1, min(sentence) AS s2
  FROM v_outputs GROUP BY v_outputs.eid""")


@query("resume_merge", """SELECT coalesce(n.eid, o.eid) AS eid, s0,
  CASE WHEN n.eid IS NULL THEN o.s1 WHEN o.eid IS NULL THEN n.s1 WHEN trim(coalesce(n.s1, '')) <> '' THEN n.s1 ELSE o.s1 END AS s1, s2
  FROM o_wide_old o FULL JOIN o_wide_new n ON o.eid = n.eid""")
def resume_merge(t: Tables):
    old, new = (t.sql(HELPERS[n]) for n in ("o_wide_old", "o_wide_new"))
    return M.resume_merge(old, new)


@query("skip_existing", f"""SELECT event_id FROM o_new_keyed b WHERE NOT EXISTS (
  SELECT 1 FROM o_judged o WHERE (o.eid, o.source_id, o.judge, o."at") = (b.eid, b.source_id, b.judge, b."at"))""")
def skip_existing(t: Tables):
    old, new = runs(t)
    return M.skip_existing(new, old, M.RECORD_KEY).select("event_id")


@query("skip_existing_eids", """SELECT event_id FROM o_new_keyed b WHERE NOT EXISTS (
  SELECT 1 FROM o_judged o WHERE o.eid = b.eid AND o.source_id = b.source_id)""")
def skip_existing_eids(t: Tables):
    old, new = runs(t)
    return M.skip_existing(new, old, ["eid", "source_id"]).select("event_id")


@query("union_sources", """SELECT source_id, eid, sentence, NULL AS score, 'outputs' AS source_label FROM v_outputs
  UNION ALL SELECT source_id, eid, sentence, score, 'records' FROM o_old""")
def union_sources(t: Tables):
    outputs = t.v_outputs.withColumn("source_label", F.lit("outputs"))
    records = t.sql(HELPERS["o_old"]).select(
        "source_id", "eid", "sentence", "score", F.lit("records").alias("source_label")
    )
    return union_frames([outputs, records])


@query("missing_repeats", f"""SELECT {_KEYS}, i AS repeat_idx FROM v_latest_faith, range(1, 6) r(i)
  WHERE NOT EXISTS (SELECT 1 FROM v_answers a WHERE (a.model, a.dataset, a.variant, a.language, a.eid, a.repeat_idx) =
    (v_latest_faith.model, v_latest_faith.dataset, v_latest_faith.variant, v_latest_faith.language, v_latest_faith.eid, i) AND trim(answer) <> '')""")
def missing_repeats(t: Tables):
    return M.missing_repeats(latest_faith(t), t.v_answers)


_COMBO = "model, dataset, variant, language"


@query("coverage", f"""SELECT {_COMBO}, count(*) AS expected_rows, count(f.eid) AS judged_rows, count(*) - count(f.eid) AS missing_rows
  FROM (SELECT DISTINCT {_KEYS} FROM v_judged_faith) e LEFT JOIN (SELECT DISTINCT {_KEYS}, 1 AS hit FROM v_fluency_elsewhere) f
  USING ({_KEYS}) GROUP BY {_COMBO}""".replace("count(f.eid)", "count(hit)"))
def coverage(t: Tables):
    return M.coverage(t.v_judged_faith, t.v_fluency_elsewhere)


@query("coverage_by_alias", f"""SELECT {_COMBO}, count(*) AS expected_rows, count(hit) AS judged_rows, count(*) - count(hit) AS missing_rows
  FROM (SELECT DISTINCT concat('a_', model) AS model, dataset, variant, language, eid FROM v_judged_faith) e
  LEFT JOIN (SELECT DISTINCT concat('a_', model) AS model, dataset, variant, language, eid, 1 AS hit FROM v_judged_fluency) f
  USING ({_KEYS}) GROUP BY {_COMBO}""")
def coverage_by_alias(t: Tables):
    expected = t.v_judged_faith.withColumn("model", F.concat(F.lit("a_"), "model"))
    return M.coverage_by_alias(expected, t.v_judged_fluency.withColumn("model", F.concat(F.lit("a."), "model")))


_DONE = """SELECT CASE WHEN k % 2 = 0 THEN 'generated' ELSE 'classified' END AS task, model, dataset, variant, language
  FROM v_judged_faith GROUP BY 1, 2, 3, 4, 5 HAVING avg(score) > 2.9"""


@query("pending_grid", f"""SELECT task, model, dataset, variant, language FROM (SELECT DISTINCT model FROM v_judged_faith)
  CROSS JOIN (VALUES ('generated'), ('classified')) a(task) CROSS JOIN (VALUES ('cs-qa'), ('sk-qa')) b(dataset)
  CROSS JOIN (VALUES ('fa'), ('cf'), ('fi')) c(variant) CROSS JOIN (VALUES ('en'), ('cs'), ('sk')) d(language)
  WHERE variant <> 'fi' EXCEPT SELECT * FROM ({_DONE}) x""")
def pending_grid(t: Tables):
    models = t.v_judged_faith.select("model").distinct()
    grid = M.job_grid(
        models, ("generated", "classified"), ("cs-qa", "sk-qa"), ("fa", "cf", "fi"), ("en", "cs", "sk")
    )
    return M.pending_grid(grid, {"cs-qa": ["fi"], "sk-qa": ["fi"]}, t.sql(_DONE))


# annotations of the outputs: several per (entry, source), some without time stamp
helper("o_annotated", """SELECT event_id, concat('Id', CAST(CAST(floor(event_id / 2) AS BIGINT) % 3000 AS @STR)) AS eid,
  concat('src', CAST(user_id % 3 AS @STR)) AS source_id,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(100000 + k * 37 % 50 AS @STR) END AS "timestamp",
  score, k % 4 AS n_items, CASE k % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE NULL END AS label,
  CASE k % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(k % 8 * 0.25 AS @STR) END AS request_cost FROM v_judged_faith""")
helper("o_latest_ann", """SELECT * FROM o_annotated
  QUALIFY row_number() OVER (PARTITION BY eid, source_id ORDER BY "timestamp" DESC NULLS LAST, event_id DESC) = 1""")


def annotated(t: Tables):
    return t.sql(HELPERS["o_annotated"].replace('"timestamp"', "`timestamp`"))


def latest_ann(t: Tables):
    return M.latest_annotations(annotated(t), [F.desc("event_id")])


@query("latest_annotations", 'SELECT event_id, eid, source_id, "timestamp" FROM o_latest_ann')
def latest_annotations(t: Tables):
    return latest_ann(t).select("event_id", "eid", "source_id", "timestamp")


@query("last_nonempty", """SELECT eid, source_id, event_id, sentence FROM o_old_keyed WHERE trim(sentence) <> ''
  QUALIFY row_number() OVER (PARTITION BY eid, source_id ORDER BY event_id DESC) = 1""")
def last_nonempty(t: Tables):
    old, _ = runs(t)
    return M.last_nonempty(old, ["eid", "source_id"], [F.desc("event_id")]).select(
        "eid", "source_id", "event_id", "sentence"
    )


@query("source_meta", """SELECT eid, category, shape, shape_type, size FROM v_triples
  QUALIFY row_number() OVER (PARTITION BY eid ORDER BY pos) = 1""")
def source_meta(t: Tables):
    return M.first_per_key(t.v_triples, ["eid"], [F.col("pos")]).select(
        "eid", "category", "shape", "shape_type", "size"
    )


@query("browse_scope", """SELECT 'outputs' AS scope, eid FROM (SELECT DISTINCT eid FROM v_triples) e
    WHERE eid IN (SELECT eid FROM v_outputs WHERE sentence <> '' AND source_id = 'src1')
  UNION ALL SELECT 'annotations', eid FROM (SELECT DISTINCT eid FROM v_triples) e WHERE eid IN (SELECT eid FROM o_annotated)
  UNION ALL SELECT 'all', eid FROM (SELECT DISTINCT eid FROM v_triples) e""")
def browse_scope(t: Tables):
    entries = t.v_triples.select("eid").distinct()
    outputs = t.v_outputs.filter("sentence <> '' AND source_id = 'src1'")
    parts = [
        M.browse_scope(entries, scope, outputs, annotated(t)).select(F.lit(scope).alias("scope"), "eid")
        for scope in ("outputs", "annotations", "all")
    ]
    return union_frames(parts)


@query("browse_sorted", """SELECT eid, annotation_score, row_number() OVER (ORDER BY annotation_score DESC NULLS LAST, eid) AS place
  FROM (SELECT DISTINCT eid FROM v_triples) e LEFT JOIN (SELECT eid, avg(score) AS annotation_score FROM o_latest_ann
    WHERE source_id IN ('src0', 'src1') GROUP BY eid) s USING (eid)""")
def browse_sorted(t: Tables):
    scores = M.entry_scores(latest_ann(t), ["src0", "src1"])
    rows = t.v_triples.select("eid").distinct().join(scores, "eid", "left")
    return M.numbered(rows, M.browse_order(rows, "annotation_score", descending=True), "place")


@query("entry_scores", """SELECT eid, avg(score) AS annotation_score FROM o_latest_ann
  WHERE source_id IN ('src0', 'src2') AND score IS NOT NULL GROUP BY eid""")
def entry_scores(t: Tables):
    return M.entry_scores(latest_ann(t), ["src0", "src2"])


@query("spend_total", "SELECT sum(coalesce(TRY_CAST(request_cost AS DOUBLE), 0.0)) AS spend FROM o_annotated")
def spend_total(t: Tables):
    return M.spend_total(annotated(t))


@query("pending_counts", """SELECT source_id, count(*) AS total, count(hit) AS existing, count(*) - count(hit) AS pending
  FROM v_outputs LEFT JOIN (SELECT DISTINCT eid, source_id, 1 AS hit FROM o_annotated) a USING (eid, source_id) GROUP BY source_id""")
def pending_counts(t: Tables):
    return M.pending_counts(t.v_outputs, annotated(t), ["source_id"])


@query("pending_prefix", """SELECT source_id, eid FROM (SELECT source_id, eid,
    sum(CASE WHEN hit IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY source_id, eid) - CASE WHEN hit IS NULL THEN 1 ELSE 0 END AS before
    FROM v_outputs LEFT JOIN (SELECT DISTINCT eid, source_id, 1 AS hit FROM o_annotated) a USING (eid, source_id)) x WHERE before < 2000""")
def pending_prefix(t: Tables):
    done = annotated(t).select("eid", "source_id").distinct().withColumn("hit", F.lit(True))
    rows = t.v_outputs.join(done, ["eid", "source_id"], "left")
    return M.pending_prefix(rows, F.col("hit").isNull(), 2000, ["source_id", "eid"]).select(
        "source_id", "eid"
    )


@query("annotation_summary", """SELECT source_id, count(*) AS rows, count(hit) AS judged, avg(score) AS avg_score,
    coalesce(sum(n_items), 0)::DOUBLE / nullif(count(hit), 0) AS avg_issues, any_value(label_counts) AS label_counts
  FROM v_outputs LEFT JOIN (SELECT eid, source_id, score, n_items, 1 AS hit FROM o_latest_ann) a USING (eid, source_id)
  LEFT JOIN (SELECT source_id, string_agg(concat(label, ':', CAST(n AS VARCHAR)), ', ' ORDER BY label) AS label_counts FROM (
    SELECT source_id, label, count(*) AS n FROM v_outputs JOIN o_latest_ann USING (eid, source_id) WHERE label IS NOT NULL GROUP BY ALL) l
    GROUP BY source_id) c USING (source_id) GROUP BY source_id""")
def annotation_summary(t: Tables):
    return M.annotation_summary(t.v_outputs, latest_ann(t))


@query("limit_entries", "SELECT DISTINCT eid, category, size FROM v_triples ORDER BY eid LIMIT 250")
def limit_entries(t: Tables):
    return M.entry_limit(t.v_triples.select("eid", "category", "size").distinct(), 250)


@query("seeded_sample", """SELECT event_id, category FROM (SELECT event_id, predicate AS category, item_index,
    row_number() OVER (PARTITION BY predicate ORDER BY @DRAW(concat_ws('|', '7', CAST(event_id AS VARCHAR), CAST(item_index AS VARCHAR))),
      event_id, item_index) AS rn FROM o_items) x WHERE rn <= 10""")
def seeded_sample(t: Tables):
    from textjudge.functions.categories import triple_predicate

    items = t.v_issue_items.withColumn("category", triple_predicate(F.col("correct_info")))
    return M.seeded_sample(items, 10, ["event_id", "item_index"], 7, ["category"]).select(
        "event_id", "category"
    )


@query("seeded_sample_all", """SELECT event_id, item_index FROM v_issue_items
  ORDER BY @DRAW(concat_ws('|', '7', CAST(event_id AS VARCHAR), CAST(item_index AS VARCHAR))), event_id, item_index LIMIT 400""")
def seeded_sample_all(t: Tables):
    return M.seeded_sample(t.v_issue_items, 400, ["event_id", "item_index"], 7).select("event_id", "item_index")


_OPEN = """SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, label) AS place FROM (
  SELECT source_id, label, count(*) AS n FROM o_open_labels GROUP BY source_id, label) l"""
helper("o_open_labels", "SELECT source_id, concat('label ', CAST(CAST(regexp_extract(eid, '[0-9]+') AS INT) % 97 AS @STR)) AS label FROM v_outputs")


@query("label_counts", f"""SELECT source_id, label, n, false AS rest FROM ({_OPEN}) a WHERE place <= 20
  UNION ALL SELECT source_id, NULL, sum(n)::BIGINT, true FROM ({_OPEN}) b WHERE place > 20 GROUP BY source_id""")
def label_counts(t: Tables):
    labels = t.v_outputs.select("source_id", F.concat(F.lit("label "), F.regexp_extract("eid", "[0-9]+", 0).cast("int") % 97).alias("label"))
    return M.label_counts(labels, most=20)


@query("upsert_stored", f"SELECT {_OUT} FROM o_old_keyed UNION ALL SELECT {_OUT} FROM o_added")
def upsert_stored(t: Tables):
    """The later batch is merged into a stored table; only partitions it touches are rewritten."""
    from textjudge.sources.sinks import scratch

    path = scratch(t.spark)
    old, new = runs(t)
    old.write.partitionBy("source_id").parquet(path)
    M.upsert_stored(new, path, "append", [F.desc("event_id")], ["source_id"])
    return t.spark.read.parquet(path).select("event_id", *M.RECORD_KEY, "sentence")


@query("category_top_eids", "SELECT category, count(DISTINCT eid) AS eids FROM v_triples GROUP BY category ORDER BY eids DESC, category LIMIT 5")
def category_top_eids(t: Tables):
    # the entry size is unique per entry, so distinct pairs come first and stay small
    pairs = t.v_triples.select("category", "eid").distinct()
    counted = pairs.groupBy("category").agg(F.count(F.lit(1)).alias("eids"))
    return counted.orderBy(F.desc("eids"), "category").limit(5)


@query("triples_per_kind", "SELECT kind, count(*) AS triples, count(DISTINCT eid) AS eids FROM v_triples GROUP BY kind")
def triples_per_kind(t: Tables):
    return t.v_triples.groupBy("kind").agg(
        F.count(F.lit(1)).alias("triples"), F.countDistinct("eid").alias("eids")
    )


@query("faith_fluency_pairs", f"""SELECT {_KEYS}, concat(f.model, '__', f.dataset, '_', f.variant, '_', f.language, '__', f.eid) AS uid,
  f.score AS faithfulness, u.score AS fluency FROM v_latest_faith f JOIN v_latest_fluency u USING ({_KEYS})""")
def faith_fluency_pairs(t: Tables):
    from textjudge.functions.keys import row_uid

    faith = latest_faith(t).select(*KEY, F.col("score").alias("faithfulness"))
    fluency = latest_fluency(t).select(*KEY, F.col("score").alias("fluency"))
    return faith.join(fluency, KEY).withColumn("uid", row_uid(*[F.col(k) for k in KEY]))


# --- capability dimension --------------------------------------------------
# eight of the nine synthetic models have a capability entry
CAPABILITY = {m: i * 3 + 5 for i, m in enumerate(sorted(SIZE)[:8])}
helper("o_capability", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {v})" for m, v in CAPABILITY.items()) + ") AS c(model, aaii)")


def capability(t: Tables):
    return t.spark.createDataFrame(list(CAPABILITY.items()), "model string, aaii int")


@query("capability_means", """SELECT dataset, language, model, aaii, avg(score) AS mean_score, count(*) AS n
  FROM v_latest_faith JOIN o_capability USING (model) GROUP BY ALL""")
def capability_means(t: Tables):
    from textjudge.operators.scores import mean_by

    means = mean_by(latest_faith(t), ["dataset", "language", "model"])
    return means.join(capability(t), "model").orderBy("dataset", "language", "aaii", "model")


@query("capability_unmatched", "SELECT DISTINCT model FROM v_latest_faith WHERE model NOT IN (SELECT model FROM o_capability)")
def capability_unmatched(t: Tables):
    from textjudge.operators.joins import unmatched

    return unmatched(latest_faith(t), capability(t), ["model"])


@query("keyword_context", """SELECT DISTINCT member, replace(member, '_', ' ') AS keyword, coalesce(context, 'none') AS context
  FROM (SELECT object AS member FROM v_triples) m LEFT JOIN (SELECT replace(member, '_', ' ') AS kw, context FROM v_context) c
    ON kw = replace(member, '_', ' ')""")
def keyword_context(t: Tables):
    from textjudge.operators import construct as N

    text = t.v_context.select(F.concat("member", F.lit("==="), "context").alias("value"))
    members = t.v_triples.select(F.col("object").alias("member")).distinct()
    return N.keyword_context(members, N.read_context(text))
