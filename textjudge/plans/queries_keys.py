"""Key, name and predicate queries (B1-B24) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import keys as K
from textjudge.functions import terms as T
from textjudge.functions import verdicts as J
from textjudge.functions.cleaning import truncate_sentence
from textjudge.functions.columns import lookup
from textjudge.functions.keys import KEY
from textjudge.operators import construct as N
from textjudge.operators import scores as S
from textjudge.operators.joins import assert_unique
from textjudge.plans.queries_scores import LANG_GROUP_SQL, grouping_name, latest_faith
from textjudge.plans.registry import helper, query
from textjudge.plans.views import Tables

_KEYS = ", ".join(KEY)

# labels in the shapes that occur on disk, one per judgment
helper("o_labels_raw", """SELECT event_id, CASE event_id % 4
    WHEN 0 THEN concat('judge_', dataset, '_', variant, '_', language, '_judge_v4')
    WHEN 1 THEN concat(dataset, '_', variant, '_', language)
    WHEN 2 THEN concat('judge_', dataset, '_', variant, '_', language, '_gpt-4')
    ELSE concat('my_', dataset, '_', variant) END AS label,
  CASE k % 3 WHEN 0 THEN concat(model, '__', dataset, '_', variant) ELSE '' END AS source_id,
  concat('/data/judged/dir', model, '/file_', dataset, '_', variant, '_', language, '_glm-5.jsonl') AS path
  FROM v_judged_faith""")


def labels_raw(t: Tables):
    from textjudge.plans.registry import HELPERS

    return t.sql(HELPERS["o_labels_raw"])


_PAT = fixed.COMBO_PATTERN


@query("parse_combo", f"""SELECT event_id, nullif(regexp_extract(label, '{_PAT}', 1), '') AS dataset,
  nullif(regexp_extract(label, '{_PAT}', 2), '') AS variant, nullif(regexp_extract(label, '{_PAT}', 3), '') AS language
  FROM o_labels_raw""")
def parse_combo(t: Tables):
    parsed = labels_raw(t).withColumn("c", K.parse_combo(F.col("label")))
    return parsed.select("event_id", "c.dataset", "c.variant", "c.language")


@query("parse_stem", """SELECT event_id, CASE WHEN ok THEN p[2] ELSE '' END AS dataset,
  CASE WHEN ok THEN p[3] ELSE '' END AS variant, CASE WHEN ok THEN p[4] ELSE '' END AS language
  FROM (SELECT event_id, string_split(label, '_') AS p,
    len(string_split(label, '_')) >= 4 AND string_split(label, '_')[1] = 'judge' AS ok FROM o_labels_raw) x""")
def parse_stem(t: Tables):
    parsed = labels_raw(t).withColumn("c", K.parse_judge_stem(F.col("label")))
    return parsed.select("event_id", "c.dataset", "c.variant", "c.language")


@query("infer_key", """
SELECT event_id, CASE WHEN contains(source_id, '__') THEN split_part(source_id, '__', 1)
    ELSE regexp_extract(path, '/([^/]*)/[^/]*$', 1) END AS model,
  CASE WHEN lang_ok THEN array_to_string(p[1:len(p) - 2], '_') ELSE array_to_string(p[1:len(p) - 1], '_') END AS dataset,
  CASE WHEN lang_ok THEN p[-2] ELSE p[-1] END AS variant,
  CASE WHEN lang_ok THEN p[-1] ELSE 'unknown' END AS language
FROM (SELECT *, len(p) >= 3 AND p[-1] IN ('en', 'cs', 'sk', 'hsb') AS lang_ok FROM (
  SELECT event_id, source_id, path, string_split(regexp_replace(regexp_replace(regexp_replace(label, '^judge_', ''),
    '_(?:openai_)?gpt-[^_]+$', ''), '_glm-5$', ''), '_') AS p FROM o_labels_raw) a) b""")
def infer_key(t: Tables):
    none = F.lit(None).cast("string")
    parsed = labels_raw(t).withColumn(
        "c", K.infer_key(F.col("source_id"), F.col("label"), none, F.col("path"))
    )
    return parsed.select("event_id", "c.model", "c.key.*")


_TREE = """CASE user_id % 4 WHEN 0 THEN 'qwen3.5-122b' WHEN 1 THEN 'llama4-scout-openrouter'
  WHEN 2 THEN 'qwen3_5-122b' ELSE model END"""


@query("canonical_model", f"""SELECT name, n, CASE name WHEN 'qwen3_5-122b' THEN 'qwen3.5-122b'
    WHEN 'llama4-scout-openrouter' THEN 'llama4-scout' ELSE name END AS canonical,
  CASE name WHEN 'qwen3_5-122b' THEN 'qwen3.5-122b' ELSE name END AS display,
  regexp_replace(regexp_replace(name, '-openrouter$', ''), '^([^.]*)\\.', '\\1_') AS judged_name
  FROM (SELECT {_TREE} AS name, count(*) AS n FROM v_judged_faith GROUP BY ALL) x""")
def canonical_model(t: Tables):
    named = t.v_judged_faith.select(F.expr(_TREE).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n")
    )
    name = F.col("name")
    return named.select(
        "name", "n", K.canonical_model(name).alias("canonical"), K.display_model(name).alias("display"),
        K.classified_model(name).alias("judged_name"),
    )


@query("language_group", f"SELECT event_id, {LANG_GROUP_SQL} AS lang_group FROM v_judged_faith")
def language_group(t: Tables):
    return t.v_judged_faith.select(
        "event_id", K.language_group(F.col("dataset"), F.col("language")).alias("lang_group")
    )


_PARAMS = {f"m{i}": p for i, p in enumerate((125.0, 117.0, 30.7, 17.0, 9.7, 8.0, 5.1, 3.35, 1.7))}
helper("o_params", "SELECT * FROM (VALUES "
       + ", ".join(f"('{m}', {p}::DOUBLE)" for m, p in _PARAMS.items()) + ") AS p(model, params_b)")


@query("size_bucket", """SELECT model, params_b, CASE WHEN params_b < 10 THEN 'small' WHEN params_b < 100 THEN 'medium'
  ELSE 'large' END AS size_bucket, count(*) AS n FROM v_judged_faith JOIN o_params USING (model) GROUP BY ALL""")
def size_bucket(t: Tables):
    counted = t.v_judged_faith.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    sized = counted.withColumn("params_b", lookup(F.col("model"), _PARAMS))
    return sized.withColumn("size_bucket", K.size_bucket(F.col("params_b")))


@query("strata", f"""SELECT {_KEYS}, score, CASE score WHEN 1 THEN '1' WHEN 5 THEN '5' ELSE '2-4' END AS stratum
  FROM v_latest_faith""")
def strata(t: Tables):
    return latest_faith(t).select(*KEY, "score", K.stratum(F.col("score")).alias("stratum"))


# records with every score type that occurs in judge output
helper("o_score_json", """SELECT event_id, CASE k % 8
    WHEN 0 THEN concat('{"parsed":{"faithfulness_score":', CAST(coalesce(score, 0) AS @STR), '}}')
    WHEN 1 THEN concat('{"parsed":{"faithfulness_score":"', CAST(coalesce(score, 0) AS @STR), '"}}')
    WHEN 2 THEN concat('{"parsed":{"score":"rated ', CAST(coalesce(score, 0) AS @STR), ' of 9"}}')
    WHEN 3 THEN concat('{"parsed":{"faithfulness_score":', CAST(coalesce(score, 0) AS @STR), '.0}}')
    WHEN 4 THEN concat('{"parsed":{"faithfulness_score":', CAST(coalesce(score, 0) AS @STR), '.5},"score":2}')
    WHEN 5 THEN concat('{"parsed":{"faithfulness_score":null},"faithfulness_score":', CAST(coalesce(score, 0) AS @STR), '}')
    WHEN 6 THEN concat('{"score":', CAST(coalesce(score, 0) AS @STR), '}')
    ELSE '{"parsed":{"faithfulness_score":[1]}}' END AS record FROM v_judged_faith""")


def _cascade_sql(path: str) -> str:
    v = f"json_extract(record, '{path}')"
    s = f"json_extract_string(record, '{path}')"
    return f"""CASE WHEN json_type({v}) IN ('UBIGINT', 'BIGINT') THEN CAST({s} AS INT)
      WHEN json_type({v}) = 'DOUBLE' AND CAST({s} AS DOUBLE) = floor(CAST({s} AS DOUBLE)) THEN CAST(CAST({s} AS DOUBLE) AS INT)
      WHEN json_type({v}) = 'VARCHAR' THEN TRY_CAST(nullif(regexp_extract({s}, '\\b([1-5])\\b', 1), '') AS INT) END"""


_FS = "json_extract(record, '$.parsed.faithfulness_score')"
_FD = "TRY_CAST(json_extract_string(record, '$.parsed.faithfulness_score') AS DOUBLE)"
_NUM = f"json_type({_FS}) IN ('UBIGINT', 'BIGINT', 'DOUBLE')"


@query("score_policies", f"""SELECT event_id,
  CASE WHEN {_NUM} THEN CASE WHEN {_FD} IN (1, 2, 3, 4, 5) THEN CAST({_FD} AS INT) END END AS in_range,
  CASE WHEN {_NUM} THEN CASE WHEN {_FD} < 5 THEN CAST(trunc({_FD}) AS INT) END END AS below_max,
  CASE WHEN json_type({_FS}) IN ('UBIGINT', 'BIGINT') THEN CAST({_FD} AS INT) END AS whole,
  coalesce({_cascade_sql('$.parsed.faithfulness_score')}, {_cascade_sql('$.parsed.score')},
    {_cascade_sql('$.faithfulness_score')}, {_cascade_sql('$.score')}) AS cascade_score
  FROM o_score_json""")
def score_policies(t: Tables):
    from textjudge.plans.registry import HELPERS

    record = F.try_parse_json("record")
    rows = t.sql(HELPERS["o_score_json"]).withColumn("r", record)
    parsed = J.field(F.col("r"), "$.parsed")
    key = "faithfulness_score"
    return rows.select(
        "event_id",
        J.score_in_range(parsed, key).alias("in_range"),
        J.score_below_max(parsed, key).alias("below_max"),
        J.score_integer(parsed, key).alias("whole"),
        J.score_cascade(F.col("r")).alias("cascade_score"),
    )


_BUCKET = "CASE WHEN triple_count = 1 THEN '1' WHEN triple_count IN (2, 3) THEN '2--3' WHEN triple_count BETWEEN 4 AND 9 THEN '4--9' END"


@query("triple_bucket", f"""
SELECT model, bucket, grp AS "grouping", mean_score, n FROM (
  SELECT model, bucket, {grouping_name(['model', 'bucket'])} AS grp, grouping(bucket) AS gb, avg(score) AS mean_score, count(*) AS n
  FROM (SELECT f.model, f.score, {_BUCKET} AS bucket FROM v_latest_faith f LEFT JOIN v_generated g USING ({_KEYS})) j
  GROUP BY GROUPING SETS ((model, bucket), (model), (bucket), ())) s WHERE bucket IS NOT NULL OR gb = 1""")
def triple_bucket(t: Tables):
    generated = assert_unique(t.v_generated, KEY, "generated rows")
    joined = latest_faith(t).select(*KEY, "score").join(generated, KEY, "left")
    rows = joined.withColumn("bucket", K.triple_bucket(F.col("triple_count")))
    out = S.mean_sets(rows, [["model", "bucket"], ["model"], ["bucket"], []])
    # a count outside all buckets stays in the overall means only
    return out.filter(F.col("bucket").isNotNull() | ~F.col("grouping").contains("bucket"))


helper("o_triple_text", """SELECT eid, pos, CASE pos % 5 WHEN 0 THEN concat(subject, ' | ', predicate)
  WHEN 1 THEN concat(' ', subject, '|', predicate, ' |', object, ' | extra')
  ELSE concat(subject, ' | ', predicate, ' | ', object) END AS text FROM v_triples""")


@query("parse_triple", """SELECT eid, pos, CASE WHEN n >= 3 THEN trim(p[1]) END AS subject,
  CASE WHEN n >= 3 THEN trim(p[2]) END AS predicate,
  CASE WHEN n >= 3 THEN trim(array_to_string(p[3:], '|')) END AS object
  FROM (SELECT *, string_split(text, '|') AS p, len(string_split(text, '|')) AS n FROM o_triple_text) x""")
def parse_triple(t: Tables):
    from textjudge.plans.registry import HELPERS

    rows = t.sql(HELPERS["o_triple_text"]).withColumn("t", T.parse_triple(F.col("text")))
    return rows.select("eid", "pos", "t.subject", "t.predicate", "t.object")


@query("format_triples", """SELECT eid, string_agg(concat('- ', replace(subject, '_', ' '), ' | ',
  replace(predicate, '_', ' '), ' | ', replace(object, '_', ' ')), chr(10) ORDER BY pos) AS triples
  FROM v_triples GROUP BY eid""")
def format_triples(t: Tables):
    entries = N.entries(t.v_triples)
    return entries.select("eid", T.format_triples(F.col("triples"), prompt=True).alias("triples"))


helper("o_specs", """SELECT doc_id, source, concat('/data/generated/', source, ' v', CAST(doc_id % 3 AS @STR), '/', lang, '.qa_fa_',
  CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'cs' END, '.csv') AS path,
  CASE WHEN doc_id % 4 = 0 THEN concat('run ', source, '!') ELSE '' END AS label FROM documents""")
_CLEAN = "regexp_replace(trim({0}), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g')"


@query("source_identity", f"""SELECT doc_id, base_id, CASE WHEN rn = 1 THEN base_id ELSE concat(base_id, '_', CAST(rn AS VARCHAR)) END AS source_id
FROM (SELECT doc_id, base_id, row_number() OVER (PARTITION BY base_id ORDER BY doc_id) AS rn FROM (
  SELECT doc_id, trim({_CLEAN.format("concat(trim(" + _CLEAN.format("regexp_extract(path, '/generated/([^/]+)', 1)") + ", '_'), '__', coalesce(nullif(label, ''), regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')))")}, '_') AS base_id
  FROM o_specs) a) b""")
def source_identity(t: Tables):
    from textjudge.plans.registry import HELPERS

    specs = t.sql(HELPERS["o_specs"]).withColumn(
        "base_id", K.source_identity(F.col("path"), F.col("label"))
    )
    chunk = F.floor(F.col("doc_id") / 10_000)
    return N.number_repeats(specs, "base_id", ["doc_id"], chunk, "source_id").select(
        "doc_id", "base_id", "source_id"
    )


helper("o_lang", """SELECT event_id, concat(CASE WHEN k % 2 = 0 THEN 'sentences_' ELSE '' END, dataset, '_', variant,
    CASE WHEN k % 5 = 0 THEN '' ELSE concat('_', language) END) AS stem,
  CASE k % 4 WHEN 0 THEN ' sk ' WHEN 1 THEN 'de' ELSE '' END AS row_language,
  CASE WHEN k % 7 = 0 THEN 'hsb' ELSE '' END AS override FROM v_judged_faith""")
_CODE = """coalesce(nullif(override, ''), nullif(trim(row_language), ''),
  list_filter(string_split(stem, '_'), lambda x: x IN ('en', 'cs', 'sk', 'hsb'))[-1])"""
_NAME = f"""CASE {_CODE} WHEN 'en' THEN 'English' WHEN 'cs' THEN 'Czech' WHEN 'sk' THEN 'Slovak'
  WHEN 'hsb' THEN 'Upper Sorbian' ELSE 'the target language' END"""


@query("resolve_language", f"""SELECT event_id, {_CODE} AS code, {_NAME} AS name,
  CASE WHEN {_CODE} IS NULL THEN {_NAME} ELSE concat({_NAME}, ' (', {_CODE}, ')') END AS target,
  CASE split_part(replace(stem, 'sentences_', ''), '_', 1) WHEN 'cs-qa' THEN 'Czech' WHEN 'sk-qa' THEN 'Slovak'
    ELSE 'the original source language' END AS entity_language FROM o_lang""")
def resolve_language(t: Tables):
    from textjudge.plans.registry import HELPERS

    rows = t.sql(HELPERS["o_lang"])
    code = K.resolve_language(F.col("override"), F.col("row_language"), F.col("stem"))
    return rows.withColumn("r", code).select(
        "event_id", "r.code", "r.name", "r.target", K.entity_language(F.col("stem")).alias("entity_language")
    )


@query("truncate_text", """SELECT doc_id, CASE WHEN length(text) > 500
  THEN concat(left(text, 500), ' ... [sentence truncated]') ELSE text END AS sentence FROM documents""")
def truncate_text(t: Tables):
    return t.documents.select("doc_id", truncate_sentence(F.col("text")).alias("sentence"))


@query("entry_filters", """SELECT DISTINCT eid, category, size FROM v_triples WHERE kind = 'original'
  AND category IN ('1-URGENT', '2-HIGH', '5-LOW') AND size BETWEEN 2 AND 5 AND contains(lower(eid), 'id1')""")
def entry_filters(t: Tables):
    return N.filter_entries(
        t.v_triples, kind="original", categories=["1-URGENT", "2-HIGH", "5-LOW"], sizes=(2, 5), eid_part="ID1"
    ).select("eid", "category", "size").distinct()


_JUDGED_BY = """SELECT event_id, CASE k % 3 WHEN 0 THEN 'judge-a' WHEN 1 THEN '' ELSE NULL END AS requested,
  CASE WHEN user_id % 2 = 0 THEN 'judge-a' ELSE 'judge-b' END AS actual,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://judge.example/v1/' WHEN 2 THEN 'https://judge.example/v1/chat/completions'
    ELSE 'https://other.example/v1' END AS url FROM v_judged_faith"""


@query("annotations_for_judge", f"""SELECT event_id FROM ({_JUDGED_BY}) x
  WHERE coalesce(nullif(requested, ''), actual) = 'judge-a' AND
    CASE WHEN url = '' THEN true ELSE regexp_replace(url, '/chat/completions$|/+$', '') = 'https://judge.example/v1' END""")
def annotations_for_judge(t: Tables):
    rows = t.sql(_JUDGED_BY)
    wanted = K.annotation_by_judge(
        F.col("requested"), F.col("actual"), F.col("url"), "judge-a",
        "https://judge.example/v1/chat/completions",
    )
    return rows.filter(wanted).select("event_id")


_TWO_KINDS = """SELECT CASE WHEN pos % 2 = 0 THEN 'cs-qa' ELSE 'other-set' END AS dataset, eid, pos,
  CASE WHEN pos % 3 = 0 THEN 'modified' ELSE 'original' END AS kind FROM v_triples"""


@query("kind_by_dataset", f"""SELECT dataset, eid, pos, kind FROM ({_TWO_KINDS}) x
  WHERE kind = CASE dataset WHEN 'cs-qa' THEN 'original' WHEN 'sk-qa' THEN 'original' ELSE 'modified' END""")
def kind_by_dataset(t: Tables):
    return t.sql(_TWO_KINDS).filter(F.col("kind") == K.kind_for_dataset(F.col("dataset")))
