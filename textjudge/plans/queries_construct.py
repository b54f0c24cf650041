"""Entry, substitution, sampling and quality queries (A4, A5, A7, J1-J5) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.keys import KEY
from textjudge.operators import construct as N
from textjudge.operators import quality as Q
from textjudge.operators import sampling as A
from textjudge.operators import substitute as U
from textjudge.plans.queries_keys import _PARAMS
from textjudge.plans.queries_scores import latest_faith, latest_fluency, with_group
from textjudge.plans.registry import HELPERS, helper, query
from textjudge.plans.views import Tables

_KEYS = ", ".join(KEY)

# entries with both kinds, only the original kind, or another kind
helper("o_kinds", """SELECT eid, category, shape, shape_type, size, pos, subject, predicate, object,
  CASE WHEN right(eid, 1) IN ('1', '2', '3') AND pos % 2 = 0 THEN 'modified' WHEN right(eid, 1) = '4' THEN concat('k', CAST(pos % 2 AS @STR))
    ELSE 'original' END AS kind FROM v_triples""")


@query("entries_from_triples", """SELECT eid, kind, category, size, count(*)::INT AS triple_count,
    string_agg(concat(subject, ' | ', predicate, ' | ', object), '; ' ORDER BY pos) AS triples
  FROM o_kinds JOIN (SELECT eid, arg_min(kind, CASE kind WHEN 'modified' THEN 1 WHEN 'original' THEN 2 ELSE 2 + pos END) AS best
    FROM o_kinds GROUP BY eid) b USING (eid) WHERE kind = best GROUP BY eid, kind, category, size""")
def entries_from_triples(t: Tables):
    from textjudge.functions.terms import format_triple

    text = F.transform("triples", lambda x: format_triple(x["subject"], x["predicate"], x["object"]))
    return N.entries(t.sql(HELPERS["o_kinds"])).select(
        "eid", "kind", "category", "size", "triple_count", F.array_join(text, "; ").alias("triples")
    )


# --- substitution ----------------------------------------------------------

_SEED = fixed.CONSTRUCTION_SEED
helper("o_members", """SELECT eid, norm, min(value) AS value, min(type) AS type FROM (
  SELECT eid, object AS value, object_type AS type, strip_accents(replace(object, '_', '')) AS norm FROM v_triples
  WHERE object_type IS NOT NULL) x GROUP BY eid, norm""")
_BUCKETS = "greatest(1, ceil((SELECT count(*) FROM {}) / 50000))::BIGINT"
helper("o_pool", f"""SELECT *, row_number() OVER (PARTITION BY type ORDER BY bucket, norm, eid) - 1 AS idx,
    count(*) OVER (PARTITION BY type) AS pool_size, count(*) OVER (PARTITION BY type, norm) AS own_size,
    min(pos) OVER (PARTITION BY type, norm) AS own_start FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY bucket, norm, eid) - 1 AS pos FROM (
    SELECT *, @DRAW(norm) % {_BUCKETS.format('o_members')} AS bucket FROM o_members) a) b""")


def _chosen(source: str, pool: str) -> str:
    return f"""SELECT c.eid, c.norm, p.value AS new_value FROM (
    SELECT *, CASE WHEN draw < own_start THEN draw ELSE draw + own_size END AS j FROM (
      SELECT *, @DRAW(concat_ws('|', '{_SEED}', 'pick', eid, norm)) % (pool_size - own_size) AS draw,
        row_number() OVER (PARTITION BY eid ORDER BY @DRAW(concat_ws('|', '{_SEED}', 'order', eid, norm)), norm) AS rn,
        1 + @DRAW(concat_ws('|', '{_SEED}', 'changes', eid)) % 2 AS wanted
      FROM {source} WHERE pool_size > own_size) a WHERE rn <= wanted) c JOIN {pool} p ON p.type = c.type AND p.idx = c.j"""


helper("o_cf", _chosen("o_pool", "o_pool"))


def _applied(chosen: str) -> str:
    return f"""SELECT t.eid, t.pos, coalesce(s.new_value, subject) AS subject, predicate, coalesce(o.new_value, object) AS object
  FROM v_triples t LEFT JOIN {chosen} s ON s.eid = t.eid AND s.norm = strip_accents(replace(subject, '_', ''))
  LEFT JOIN {chosen} o ON o.eid = t.eid AND o.norm = strip_accents(replace(object, '_', ''))
  WHERE t.eid IN (SELECT eid FROM {chosen})"""


@query("substitute_entities", _applied("o_cf"))
def substitute_entities(t: Tables):
    parts = t.by_orders("v_triples", U.ROWS_PER_PART, U.MOST_PARTS)
    return U.counterfactual(parts, columns=["eid", "pos", "subject", "predicate", "object"])


_ASSETS = """SELECT p_type AS type, concat('Fictional_', p_brand, '_', CAST(p_size AS @STR)) AS value FROM part
  UNION ALL SELECT p_type, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS @STR)) FROM part"""
helper("o_assets", f"SELECT DISTINCT type, value, strip_accents(replace(value, '_', '')) AS norm FROM ({_ASSETS}) x")
helper("o_fi_pool", f"""SELECT *, row_number() OVER (PARTITION BY type ORDER BY bucket, norm, value) - 1 AS idx
  FROM (SELECT *, @DRAW(norm) % {_BUCKETS.format('o_assets')} AS bucket FROM o_assets) a""")
helper("o_fi_members", """SELECT m.eid, m.norm, m.type, pool_size, coalesce(own_start, 0) AS own_start, coalesce(own_size, 0) AS own_size
  FROM o_members m JOIN (SELECT type, count(*) AS pool_size FROM o_fi_pool GROUP BY type) s USING (type)
  LEFT JOIN (SELECT type, norm, min(idx) AS own_start, count(*) AS own_size FROM o_fi_pool GROUP BY ALL) f USING (type, norm)""")
helper("o_fi", _chosen("o_fi_members", "o_fi_pool"))


@query("substitute_fictional", _applied("o_fi"))
def substitute_fictional(t: Tables):
    return U.fictional(t.v_triples, t.sql(_ASSETS)).select("eid", "pos", "subject", "predicate", "object")


# --- samples ---------------------------------------------------------------


def sample_rows(t: Tables):
    params = t.spark.createDataFrame(list(_PARAMS.items()), "model string, params_b double")
    return A.candidates(latest_faith(t).select(*KEY, "score"), latest_fluency(t), params)


helper("o_candidates", f"""SELECT {_KEYS}, params_b, f.score AS faithfulness, u.score AS fluency,
    concat(f.model, '__', f.dataset, '_', f.variant, '_', f.language, '__', f.eid) AS uid,
    CASE WHEN params_b < 10 THEN 'small' WHEN params_b < 100 THEN 'medium' ELSE 'large' END AS size_bucket,
    CASE f.score WHEN 1 THEN '1' WHEN 5 THEN '5' ELSE '2-4' END AS stratum
  FROM v_latest_faith f JOIN v_latest_fluency u USING ({_KEYS}) JOIN o_params USING (model)""")


_S = "variant, size_bucket, language"
helper("o_sampled", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_S} ORDER BY s, stratum) AS q FROM (
  SELECT *, row_number() OVER (PARTITION BY {_S}, stratum ORDER BY m, (mno - sno * 5 + 1000 * (mmax + 1)) % (mmax + 1)) AS s FROM (
    SELECT *, max(mno) OVER (PARTITION BY {_S}) AS mmax FROM (
      SELECT *, row_number() OVER (PARTITION BY {_S}, stratum, model ORDER BY d, draw, uid) AS m,
        dense_rank() OVER (PARTITION BY {_S} ORDER BY model) - 1 AS mno, dense_rank() OVER (PARTITION BY {_S} ORDER BY stratum) - 1 AS sno FROM (
        SELECT *, row_number() OVER (PARTITION BY {_S}, stratum, model, dataset ORDER BY f, draw, uid) AS d FROM (
          SELECT *, row_number() OVER (PARTITION BY {_S}, stratum, model, dataset, fluency ORDER BY draw, uid) AS f FROM (
            SELECT *, @DRAW(concat_ws('|', '140', uid)) AS draw FROM o_candidates) a) b) c) d0) e) g) h WHERE q <= 15""")


@query("stratified_sample", "SELECT uid, variant, size_bucket, language, stratum, model, dataset, fluency FROM o_sampled")
def stratified_sample(t: Tables):
    return A.stratified(sample_rows(t)).select("uid", *A.CELL)


@query("sample_cell_counts", "SELECT variant, size_bucket, language, stratum, count(*) AS n FROM o_sampled GROUP BY ALL")
def sample_cell_counts(t: Tables):
    return A.cell_counts(A.stratified(sample_rows(t)))


def sheet_rows(t: Tables):
    """Sampled rows under the column names of the sheets."""
    return A.stratified(sample_rows(t)).select(
        "uid", "model", "params_b", "size_bucket", "dataset", "variant", F.col("language").alias("prompt_language"), "eid",
        F.col("stratum").alias("faithfulness_stratum"), F.col("faithfulness").alias("judge_faithfulness_score"),
        F.col("fluency").alias("judge_fluency_score"),
    )


@query("blind_sheet", """SELECT uid, language AS prompt_language, '' AS triples, '' AS sentence, '' AS human_faithfulness_score,
  '' AS human_faithfulness_reason, '' AS human_fluency_score, '' AS human_fluency_reason FROM o_sampled""")
def blind_sheet(t: Tables):
    return A.sheets(sheet_rows(t))[0]


@query("key_sheet", """SELECT uid, model, params_b, size_bucket, dataset, variant, language AS prompt_language, eid, stratum AS faithfulness_stratum,
  '' AS triples, '' AS sentence, faithfulness AS judge_faithfulness_score, '' AS judge_incorrect_information,
  fluency AS judge_fluency_score, '' AS judge_fluency_comment FROM o_sampled""")
def key_sheet(t: Tables):
    return A.sheets(sheet_rows(t))[1]


@query("stratified_round_robin", """SELECT uid, variant, size_bucket, language, stratum FROM (
  SELECT *, row_number() OVER (PARTITION BY variant, size_bucket, language ORDER BY b, stratum, uid) AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY variant, size_bucket, language, stratum ORDER BY a, draw, uid) AS b FROM (
      SELECT *, row_number() OVER (PARTITION BY variant, size_bucket, language, stratum, model ORDER BY draw, uid) AS a FROM (
        SELECT *, @DRAW(concat_ws('|', '140', uid)) AS draw FROM o_candidates) w) x) y) z WHERE c <= 15""")
def stratified_round_robin(t: Tables):
    return A.round_robin(sample_rows(t)).select("uid", "variant", "size_bucket", "language", "stratum")


# --- quality ---------------------------------------------------------------


@query("dq_violations", f"""SELECT 'duplicate judgment' AS "check", concat_ws('|', {_KEYS}) AS detail, count(*) AS n
    FROM v_judged_faith GROUP BY {_KEYS} HAVING count(*) > 1
  UNION ALL SELECT 'language balance', g, n FROM (SELECT g, n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM (
    SELECT CASE WHEN language = 'en' THEN 'EN' WHEN language = 'hsb' THEN 'HSB' WHEN language = split_part(dataset, '-', 1) THEN 'Same'
      ELSE 'Other' END AS g, count(*) AS n FROM v_latest_faith GROUP BY 1) a) b WHERE lo <> hi""")
def dq_violations(t: Tables):
    """One scan: a row per key with its judgments, written once, counts on the way."""
    from textjudge.operators.lineage import materialize
    from textjudge.operators.scores import valid_score

    judged = t.v_judged_faith
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(valid_score(F.col("score"))).alias("valid")]
    keys, seen = Q.watched(judged.groupBy(*KEY).agg(*counts), {f"{c} is null": F.col(c).isNotNull() for c in KEY})
    keys = materialize(keys)
    twice = keys.where("n > 1").select(F.lit("duplicate judgment").alias("check"), F.concat_ws("|", *KEY).alias("detail"), "n")
    return Q.violations(
        [
            twice,
            Q.unbalanced(with_group(keys.where("valid > 0").drop("n")), "lang_group", "language balance"),
            Q.observed(t.spark, seen),
            Q.missing_columns(judged, [*KEY, "score"], "missing column"),
        ]
    )


@query("keyword_batches", """SELECT batch, string_agg(kw, ';' ORDER BY n) AS keywords FROM (SELECT kw, n, floor(n / 50)::BIGINT AS batch FROM (
  SELECT kw, row_number() OVER (ORDER BY @DRAW(kw) % 256, kw) - 1 AS n FROM (SELECT DISTINCT replace(object, '_', ' ') AS kw FROM v_triples) a) b) c
  GROUP BY batch""")
def keyword_batches(t: Tables):
    words = t.v_triples.select(F.translate("object", "_", " ").alias("kw")).distinct()
    batches = Q.keyword_batches(words, "kw", fixed.KEYWORD_BATCH)
    return batches.select("batch", F.array_join("keywords", ";").alias("keywords"))
