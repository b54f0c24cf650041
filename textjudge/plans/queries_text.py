"""Text and verdict queries (C4-C25) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import categories as C
from textjudge.functions import cleaning as G
from textjudge.functions import terms as T
from textjudge.functions import verdicts as J
from textjudge.functions.keys import KEY
from textjudge.operators import construct as N
from textjudge.operators import issues as I
from textjudge.plans.registry import HELPERS, helper, query
from textjudge.plans.views import Tables

_KEYS = ", ".join(KEY)
_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _quote(x: str) -> str:
    """One layer of wrapping quotes in DuckDB SQL."""
    pairs = [('"', '"'), ("''", "''"), ("`", "`"), ("“", "”"), ("„", "“")]
    test = " OR ".join(f"(starts_with({x}, '{a}') AND ends_with({x}, '{b}'))" for a, b in pairs)
    inner = _strip(f"substr({x}, 2, length({x}) - 2)")
    return f"CASE WHEN length({x}) >= 2 AND ({test}) THEN {inner} ELSE {x} END"


def _layers(source: str, column: str, steps: list, rounds: int) -> str:
    """Nested sub-selects that apply ``steps`` to ``column`` ``rounds`` times."""
    sql = source
    for _ in range(rounds):
        for step in steps:
            sql = f"(SELECT * REPLACE ({step(column)} AS {column}) FROM {sql} q)"
    return sql


_META_TAIL = "(?i)" + fixed.TRAILING_META_PATTERN
_META_LINE = rf"(?i){fixed.META_LINE_PATTERN}"
_DOC_LINES = f"""(SELECT doc_id, content, array_to_string(list_filter(list_transform(list_filter(
    list_transform(string_split_regex(content, '{_BREAK}'), lambda x: {_strip('x')}),
    lambda x: x <> '' AND NOT regexp_matches(x, '^\\s*```') AND NOT regexp_matches(x, '{_META_LINE}')),
    lambda x: {_strip(f"regexp_replace(x, '{fixed.LIST_MARKER_PATTERN}', '')")}), lambda x: x <> ''), ' ') AS txt
  FROM v_chatter)"""


@query(
    "clean_generated",
    "SELECT doc_id, " + _strip("regexp_replace(txt, '\\s+', ' ', 'g')") + " AS sentence FROM "
    + _layers(
        _layers(_DOC_LINES, "txt", [_quote], 3), "txt",
        [lambda x: _strip(f"regexp_replace({x}, '{_META_TAIL}', '', 'g')"), _quote, _quote, _quote], 3,
    ) + " z",
)
def clean_generated(t: Tables):
    return t.v_chatter.select("doc_id", G.clean_generated(F.col("content")).alias("sentence"))


@query("strip_quotes", "SELECT doc_id, txt FROM " + _layers(
    f"(SELECT doc_id, {_strip('content')} AS txt FROM v_chatter)", "txt", [_quote], 4) + " z")
def strip_quotes(t: Tables):
    return t.v_chatter.select("doc_id", G.strip_quotes(F.col("content")).alias("txt"))


@query("split_reasoning", f"""SELECT doc_id, {_strip("regexp_replace(content, '(?is)<think>(.*?)</think>', '', 'g')")} AS content,
  nullif(array_to_string(list_filter(list_transform(regexp_extract_all(content, '(?is)<think>(.*?)</think>', 1),
    lambda x: {_strip('x')}), lambda x: x <> ''), chr(10) || chr(10)), '') AS reasoning FROM v_chatter""")
def split_reasoning(t: Tables):
    return t.v_chatter.select("doc_id", G.split_reasoning(F.col("content")).alias("s")).select(
        "doc_id", "s.content", "s.reasoning"
    )


@query("merged_reasoning", """SELECT doc_id, nullif(concat_ws(chr(10) || chr(10), nullif(trim(source), ''), nullif(trim(lang), '')), '') AS reasoning FROM documents""")
def merged_reasoning(t: Tables):
    return t.documents.select("doc_id", G.merge_reasoning(F.col("source"), F.col("lang")).alias("reasoning"))


@query("file_names", """SELECT page_id, regexp_replace(coalesce(nullif(trim(url), ''), 'unknown'), '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages""")
def file_names(t: Tables):
    from textjudge.functions.keys import sanitize_file_name

    return t.spark.read.parquet(f"{t.sf_dir}/pages.parquet").select("page_id", sanitize_file_name(F.col("url")).alias("name"))


@query("raw_if_different", f"""SELECT doc_id, CASE WHEN lower(raw) = lower({_strip('text')}) THEN '' ELSE raw END AS raw_response
  FROM (SELECT c.doc_id, text, {_strip("regexp_replace(content, '\\s+', ' ', 'g')")} AS raw
    FROM v_chatter c JOIN documents d ON c.doc_id = d.doc_id) x""")
def raw_if_different(t: Tables):
    both = t.v_chatter.join(t.documents.select("doc_id", "text"), "doc_id")
    return both.select(
        "doc_id", G.raw_if_different(F.col("content"), F.col("text")).alias("raw_response")
    )


_FIRST_LINE = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[1]"


@query("first_paragraph", f"SELECT doc_id, {_FIRST_LINE} AS paragraph FROM documents")
def first_paragraph(t: Tables):
    return t.documents.select("doc_id", G.first_paragraph(F.col("text")).alias("paragraph"))


@query("extract_verdict", """SELECT event_id, j IS NOT NULL AS has_verdict,
  CAST(json_extract_string(j, '$.faithfulness_score') AS INT) AS score,
  json_array_length(j, '$.incorrect_information')::INT AS n_items
  FROM (SELECT event_id, CASE WHEN json_valid(x) THEN x::JSON END AS j FROM (
    SELECT event_id, nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '') AS x FROM v_raw_responses) a) b""")
def extract_verdict(t: Tables):
    rows = t.v_raw_responses.withColumn("v", J.extract_verdict(F.col("raw")))
    items = F.try_variant_get("v", "$.incorrect_information", "array<variant>")
    return rows.select(
        "event_id",
        F.col("v").isNotNull().alias("has_verdict"),
        F.try_variant_get("v", "$.faithfulness_score", "int").alias("score"),
        F.when(items.isNotNull(), F.size(items)).alias("n_items"),
    )


@query("quarantine_rows", """SELECT event_id, CASE WHEN s IS NULL THEN 'malformed or missing verdict'
    ELSE concat('invalid or missing faithfulness_score: ', CAST(s AS VARCHAR)) END AS problem
  FROM (SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.faithfulness_score') AS INT) AS s FROM (
    SELECT event_id, nullif(regexp_extract(raw, '(?s)\\{.*\\}'), '') AS x FROM v_raw_responses) a) b
  WHERE s IS NULL OR s NOT BETWEEN 1 AND 5""")
def quarantine_rows(t: Tables):
    from textjudge.sources.judged import quarantine

    return quarantine(t.v_raw_responses, "raw", ["event_id"])


helper("o_payload", """SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN concat('{"model":"m1","choices":[{"finish_reason":"stop","message":{"content":"', source, '","reasoning":" because "}}],"usage":{"prompt_tokens":', CAST(n_chars AS @STR), ',"cost":0.5}}')
    WHEN 1 THEN concat('{"choices":[{"message":{"content":"', lang, '","reasoning":"","reasoning_text":"text ', lang, '"}}],"usage":{"total_tokens":7}}')
    WHEN 2 THEN '{"choices":[{"message":{"content":null,"reasoning_details":[{"text":" one "},"two",{"content":"three"},{"type":"x"}]}}]}'
    WHEN 3 THEN '{"choices":[],"model":"m2"}'
    ELSE 'not json' END AS payload FROM documents""")


@query("response_fields", """SELECT doc_id, json_extract_string(j, '$.choices[0].message.content') AS raw_content,
  CASE doc_id % 5 WHEN 2 THEN concat('one', chr(10), 'two', chr(10), 'three') ELSE
    coalesce(nullif(trim(json_extract_string(j, '$.choices[0].message.reasoning')), ''),
      nullif(trim(json_extract_string(j, '$.choices[0].message.reasoning_text')), '')) END AS reasoning,
  json_extract_string(j, '$.choices[0].finish_reason') AS finish_reason, json_extract_string(j, '$.model') AS response_model,
  CAST(json_extract_string(j, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens,
  CAST(json_extract_string(j, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens,
  CAST(json_extract_string(j, '$.usage.total_tokens') AS BIGINT) AS total_tokens,
  CAST(json_extract_string(j, '$.usage.cost') AS DOUBLE) AS cost
  FROM (SELECT doc_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM o_payload) x""")
def response_fields(t: Tables):
    rows = t.sql(HELPERS["o_payload"]).withColumn("p", F.try_parse_json("payload"))
    return rows.select("doc_id", *[c.alias(n) for n, c in J.response_fields(F.col("p")).items()])


_LABEL = "regexp_replace(lower(regexp_extract(split_part(trim(comment), ':', 1), '^\\s*(\\S+)', 1)), '[,.;]+$', '')"
_CATEGORY = "CASE label " + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in fixed.DEEP_ISSUE_LABELS.items()) + " ELSE '' END"
helper("o_items", f"""SELECT *, {_CATEGORY} AS category, label IN ('degenerate', 'repetition', 'supported') AS is_other_label,
  trim(regexp_extract(correct_info, '\\|([^|]*)\\|', 1)) AS predicate,
  CASE WHEN label <> '' AND starts_with(lower(trim(comment)), label)
    THEN trim(regexp_replace(substr(trim(comment), length(label) + 1), '^:+', '')) ELSE trim(comment) END AS comment_detail
  FROM (SELECT *, {_LABEL} AS label FROM v_issue_items) x""")


@query("comment_parts", "SELECT event_id, item_index, label, comment_detail, predicate FROM o_items")
def comment_parts(t: Tables):
    label = C.comment_label(F.col("comment"))
    return t.v_issue_items.withColumn("label", label).select(
        "event_id", "item_index", "label",
        C.comment_detail(F.col("comment"), F.col("label")).alias("comment_detail"),
        C.triple_predicate(F.col("correct_info")).alias("predicate"),
    )


helper("o_report_cats", f"""SELECT event_id, string_agg(category, '; ' ORDER BY first_at) AS issue_categories FROM (
    SELECT event_id, category, min(item_index) AS first_at FROM (
      SELECT event_id, item_index, CASE lower(regexp_extract(comment, '(?i){C.EXPLICIT_LABEL}', 1)) """ + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in fixed.REPORT_ISSUE_LABELS.items()) + """ END AS category FROM v_issue_items) a
    WHERE category IS NOT NULL GROUP BY ALL) b GROUP BY event_id""")


def judged_records(t: Tables):
    """Judgments with their verdict items as an array, the shape of a parsed record."""
    listed = F.array_sort(
        F.collect_list(F.struct("item_index", "comment", "correct_info", "info_used"))
    )
    items = t.v_issue_items.groupBy("event_id").agg(listed.alias("items"))
    joined = t.v_judged_faith.join(items, "event_id", "left")
    empty = F.array().cast(
        "array<struct<item_index:int,comment:string,correct_info:string,info_used:string>>"
    )
    return joined.withColumn("items", F.coalesce("items", empty))


@query("issue_categories", """SELECT j.event_id, coalesce(issue_categories,
    CASE WHEN score BETWEEN 1 AND 4 THEN 'not_given' ELSE '' END) AS issue_categories
  FROM v_judged_faith j LEFT JOIN o_report_cats c ON c.event_id = j.event_id""")
def issue_categories(t: Tables):
    rows = I.with_report_categories(judged_records(t))
    return rows.select("event_id", F.array_join("issue_categories", "; ").alias("issue_categories"))


# refusals in the sentence, in the explanation, in both and in none; issues of a sentence do not count
helper("o_explained", """SELECT event_id, item_index, replace(comment, '_', ' ') AS explanation, CASE event_id % 5
    WHEN 0 THEN 'It is not possible to describe this.' WHEN 1 THEN 'Vztah obrácen, nelze popsat' WHEN 2 THEN 'omits the date, wrong direction'
    WHEN 3 THEN NULL ELSE 'The order contains a part.' END AS sentence FROM v_issue_items
  UNION ALL SELECT event_id, -1, concat(comment, CASE event_id % 3 WHEN 0 THEN ' unable to say' ELSE '' END), concat('sentence ', CAST(event_id AS @STR)) FROM v_judged_fluency
  UNION ALL SELECT doc_id, -2, text, CASE doc_id % 4 WHEN 0 THEN 'nonsense' ELSE lang END FROM documents""")


@query("classify_issue", f"""SELECT event_id, item_index,
  CASE WHEN regexp_matches(concat(coalesce(sentence, ''), ' ', coalesce(explanation, '')), '(?i){fixed.REFUSAL_PATTERN.replace("'", "''")}') THEN 'refusal' """ + " ".join(
    f"WHEN regexp_matches(explanation, '(?i){p}') THEN '{name}'" for name, p in fixed.ISSUE_PATTERNS)
    + " ELSE '' END AS issue FROM o_explained")
def classify_issue(t: Tables):
    rows = t.sql(HELPERS["o_explained"])
    return rows.select(
        "event_id", "item_index", C.classify_issue(F.col("sentence"), F.col("explanation")).alias("issue")
    )


@query("fluency_categories", "SELECT event_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(comment, '(?i){p}') THEN '{name}' END" for name, p in fixed.FLUENCY_PATTERNS)
    + "], lambda x: x IS NOT NULL), '; ') AS categories FROM v_judged_fluency")
def fluency_categories(t: Tables):
    cats = C.fluency_categories(F.col("comment"))
    return t.v_judged_fluency.select("event_id", F.array_join(cats, "; ").alias("categories"))


@query("normalize_member", "SELECT doc_id, strip_accents(replace(replace(text, ' ', '_'), '_', '')) AS norm FROM documents")
def normalize_member(t: Tables):
    return t.documents.select(
        "doc_id", T.normalize_member(T.member_value(F.col("text"))).alias("norm")
    )


helper("o_raw_assets", """SELECT 'datum' AS type, CASE WHEN o_custkey % 5 = 0 THEN 'soon' WHEN o_custkey % 7 = 0 THEN '31-02-2001'
    ELSE concat(CAST(1 + o_custkey % 28 AS @STR), '-', CAST(1 + o_orderkey % 12 AS @STR), '-', CAST(1950 + o_custkey % 70 AS @STR)) END AS value FROM orders
  UNION ALL SELECT 'cislo', CASE WHEN l_suppkey % 4 = 0 THEN 'many' ELSE concat(CAST(l_suppkey AS @STR), ' 0', CAST(l_linenumber AS @STR)) END FROM lineitem
  UNION ALL SELECT 'misto', p_name FROM part
  UNION ALL SELECT 'zamestnani', concat(p_type, ' ', p_brand) FROM part
  UNION ALL SELECT 'jmeno', c_name FROM customer""")


@query("clean_assets", """SELECT DISTINCT type, CASE type WHEN 'zamestnani' THEN lower(replace(value, ' ', '_'))
    WHEN 'misto' THEN replace(value, ' ', '_') WHEN 'cislo' THEN replace(value, ' ', '') ELSE value END AS value
  FROM o_raw_assets WHERE CASE type WHEN 'datum' THEN try_strptime(value, '%d-%m-%Y') IS NOT NULL
    WHEN 'cislo' THEN regexp_matches(replace(value, ' ', ''), '^[+-]?\\d+$') ELSE true END AND type <> 'jmeno'
  UNION ALL SELECT type, value FROM o_raw_assets WHERE type = 'jmeno'""")
def clean_assets(t: Tables):
    return N.clean_assets(t.sql(HELPERS["o_raw_assets"]))


helper("o_responses", """SELECT eid, concat('<out>', chr(10), '<phrase>About ', eid, '</phrase>', chr(10),
    string_agg(concat('  <mtriple>', replace(subject, '_', ' '), ' | ', predicate, ' | ', object, '</mtriple>'), chr(10) ORDER BY pos),
    chr(10), 'a line without bars', chr(10)) AS response FROM v_triples GROUP BY eid""")


def responses(t: Tables):
    text = HELPERS["o_responses"].replace(
        "string_agg(concat('  <mtriple>', replace(subject, '_', ' '), ' | ', predicate, ' | ', object, '</mtriple>'), chr(10) ORDER BY pos)",
        "@LISTAGG(concat('  <mtriple>', replace(subject, '_', ' '), ' | ', predicate, ' | ', object, '</mtriple>'), chr(10), pos)",
    ).replace("chr(10), pos", "'\\n', pos")
    return t.sql(text)


@query("parse_mtriples", """SELECT eid, concat('About ', eid) AS phrase, (pos - 1)::INT AS pos, subject, predicate, object
  FROM v_triples""")
def parse_mtriples(t: Tables):
    # the lines are a column of their own and the outer form gets no filter on the size of
    # the list, so each response is read once
    rows = responses(t).select("eid", T.response_lines(F.col("response")).alias("_lines"))
    parsed = rows.select(
        "eid",
        T.line_phrase(F.col("_lines")).alias("phrase"),
        F.posexplode_outer(T.line_triples(F.col("_lines"))).alias("pos", "t"),
    )
    return parsed.where("pos IS NOT NULL").select("eid", "phrase", "pos", "t.*")


_TAG_SQL = """SELECT eid, concat(replace(min(object), '_', ' '), ': misto', chr(10), 'not a pair', chr(10),
  min(subject), ': jmeno', chr(10), max(object), ': no_such_type') AS answer FROM v_triples GROUP BY eid"""


@query("tag_members", f"""SELECT eid, pos, CASE WHEN subject = first_subject THEN 'jmeno' END AS subject_type,
  CASE WHEN replace(object, '_', '') = replace(first_object, '_', ' ') THEN 'misto' END AS object_type
  FROM v_triples JOIN (SELECT eid, min(subject) AS first_subject, min(object) AS first_object FROM v_triples GROUP BY eid) m USING (eid)""")
def tag_members(t: Tables):
    answers = t.sql(_TAG_SQL)
    triples = t.v_triples.select("eid", "pos", "subject", "object")
    return N.tag_members(triples, answers, fixed.MEMBER_TYPES["cs"]).select(
        "eid", "pos", "subject_type", "object_type"
    )


@query("update_member_tags", """SELECT DISTINCT eid, member, CASE WHEN member = first_member THEN 'misto' END AS type
  FROM (SELECT eid, subject AS member FROM v_triples UNION ALL SELECT eid, object FROM v_triples) u
  JOIN (SELECT eid, min(object) AS first_member FROM v_triples GROUP BY eid) f USING (eid)""")
def update_member_tags(t: Tables):
    updates = t.v_triples.groupBy("eid").agg(F.min("object").alias("value")).withColumn(
        "type", F.lit("misto")
    )
    return N.update_tags(N.unique_values(t.v_triples), updates)


@query("unique_members", """SELECT eid, norm, min(value) AS value FROM (
    SELECT eid, subject AS value, replace(subject, '_', '') AS norm FROM v_triples
    UNION ALL SELECT eid, object, replace(object, '_', '') FROM v_triples) u GROUP BY eid, norm""")
def unique_members(t: Tables):
    return N.unique_members(N.members(t.v_triples), ["eid"]).select("eid", "norm", "value")


@query("lexical_terms", """SELECT eid, string_agg(term, '; ' ORDER BY nth) AS terms FROM (
  SELECT eid, term, min(nth) AS nth FROM (
    SELECT eid, replace(subject, '_', ' ') AS term, pos * 2 AS nth FROM v_triples
    UNION ALL SELECT eid, replace(object, '_', ' '), pos * 2 + 1 FROM v_triples) a GROUP BY eid, term) b GROUP BY eid""")
def lexical_terms(t: Tables):
    entries = N.entries(t.v_triples)
    text = T.format_triples(F.col("triples"), prompt=True)
    listed = F.to_json(
        F.transform("triples", lambda x: T.format_triple(x["subject"], x["predicate"], x["object"], True))
    )
    # one half of the entries carries the JSON list, the other only the formatted text
    json_part = F.when(F.size("triples") > 1, listed)
    terms = T.lexical_terms(T.row_triples(json_part, text))
    return entries.select("eid", F.array_join(terms, "; ").alias("terms"))


_TEMPLATES = "(VALUES ('en', 'Describe {size} facts about {category}:'), ('cs', 'Popis {size} faktu, tema {category}:'))"


@query("build_prompts", f"""SELECT eid, language, concat(replace(replace(template, '{{size}}', CAST(size AS VARCHAR)), '{{category}}', category),
    chr(10), triples) AS prompt
  FROM (SELECT eid, min(category) AS category, max(size) AS size, string_agg(concat('  - ', replace(subject, '_', ' '), ' | ',
    predicate, ' | ', replace(object, '_', ' ')), chr(10) ORDER BY pos) AS triples FROM v_triples GROUP BY eid) e,
  {_TEMPLATES} t(language, template)""")
def build_prompts(t: Tables):
    templates = [
        ("en", "Describe {size} facts about {category}:\n{triples_str}"),
        ("cs", "Popis {size} faktu, tema {category}:\n{triples_str}"),
    ]
    return N.entry_prompts(N.entries(t.v_triples), templates)


_JUDGE_TEMPLATE = "Judge {eid} in {target_language}: {sentence}\nFacts:\n{modified_triples}"


@query("judge_prompts", """SELECT source_id, eid, concat('Judge ', eid, ' in Czech (cs): ', s, chr(10), 'Facts:', chr(10), triples) AS prompt
  FROM (SELECT source_id, eid, replace(sentence, '_', ' ') AS s FROM v_outputs WHERE trim(sentence) <> '') o
  JOIN (SELECT eid, string_agg(concat('- ', replace(subject, '_', ' '), ' | ', predicate, ' | ', replace(object, '_', ' ')),
    chr(10) ORDER BY pos) AS triples FROM v_triples GROUP BY eid) e USING (eid)""")
def judge_prompts(t: Tables):
    rows = N.enrich_sentences(t.v_outputs, N.entries(t.v_triples))
    prompt = N.judge_prompt(_JUDGE_TEMPLATE, F.lit("Czech (cs)"))
    return rows.select("source_id", "eid", prompt.alias("prompt"))


_FLUENCY_TEMPLATE = "Rate this {language} sentence about {entity_language} facts ({lexical_terms}): {sentence}"


helper("o_terms", """SELECT eid, string_agg(concat('- ', term), chr(10) ORDER BY nth) AS terms FROM (
  SELECT eid, term, min(nth) AS nth FROM (
    SELECT eid, replace(subject, '_', ' ') AS term, pos * 2 AS nth FROM v_triples
    UNION ALL SELECT eid, replace(object, '_', ' '), pos * 2 + 1 FROM v_triples) a GROUP BY eid, term) b GROUP BY eid""")


@query("fluency_prompts", """SELECT source_id, eid, concat('Rate this Czech sentence about English facts (', terms, '): ', replace(sentence, '_', ' ')) AS prompt
  FROM v_outputs JOIN o_terms USING (eid) WHERE trim(sentence) <> ''""")
def fluency_prompts(t: Tables):
    # terms belong to the entry: they are read once, not for each of its sentences
    listed = F.to_json("modified_triples_json")
    terms = T.lexical_terms(T.row_triples(listed, F.col("modified_triples")))
    rows = N.enrich_sentences(t.v_outputs, N.entries(t.v_triples), {"lexical_terms": terms})
    prompt = N.fluency_prompt(_FLUENCY_TEMPLATE, F.lit("Czech"), F.lit("English"), F.col("lexical_terms"))
    return rows.select("source_id", "eid", prompt.alias("prompt"))


helper("o_verdict_json", """SELECT event_id, CASE k % 5
    WHEN 0 THEN concat('{"eid":"', eid, '","parsed":{"faithfulness_score":3,"incorrect_information":[{"info_used":"a ', CAST(event_id AS @STR), '","correct_info":"x | p | ', eid, '","comment":"omission: detail ', CAST(event_id AS @STR), '"},{"comment":"reverse","info_used":" b "}],"style_comment":" fine ', CAST(event_id AS @STR), ' "}}')
    WHEN 1 THEN concat('{"eid":"', eid, '","request_cost":0.25,"parsed":{"score":2,"unsupported_facts":["f1 ', CAST(event_id AS @STR), '","f2"],"rationale":"since ', eid, '"}}')
    WHEN 2 THEN concat('{"eid":"', eid, '","parsed":{"faithfulness_score":4,"incorrect_information":{"comment":"negation","correct_info":"z ', CAST(event_id AS @STR), '"}}}')
    WHEN 3 THEN concat('{"eid":"', eid, '","parsed":{"faithfulness_score":5,"incorrect_information":"none"},"style_comment":"ok ', CAST(event_id AS @STR), '"}')
    ELSE concat('{"eid":"', eid, '","parsed":null,"rationale":["r1 ', CAST(event_id AS @STR), '","","r2"]}') END AS record, k FROM v_judged_faith""")


@query("verdict_text", """SELECT event_id, CASE k % 5
    WHEN 0 THEN concat('{"comment":"omission: detail ', CAST(event_id AS @STR), '","correct_info":"x | p | ', eid, '","info_used":"a ', CAST(event_id AS @STR), '"}; {"comment":"reverse","info_used":" b "}')
    WHEN 1 THEN concat('f1 ', CAST(event_id AS @STR), '; f2; since ', eid) WHEN 2 THEN concat('{"comment":"negation","correct_info":"z ', CAST(event_id AS @STR), '"}') WHEN 3 THEN 'none'
    ELSE concat('r1 ', CAST(event_id AS @STR), '; r2') END AS incorrect,
  CASE k % 5 WHEN 0 THEN concat('fine ', CAST(event_id AS @STR)) WHEN 3 THEN concat('ok ', CAST(event_id AS @STR)) ELSE '' END AS style,
  CASE k % 5 WHEN 0 THEN concat('x | p | ', eid) WHEN 2 THEN concat('z ', CAST(event_id AS @STR)) ELSE '' END AS correct_info,
  CASE k % 5 WHEN 0 THEN concat('a ', CAST(event_id AS @STR), '; b') ELSE '' END AS info_used FROM v_judged_faith""")
def verdict_text(t: Tables):
    rows = t.sql(HELPERS["o_verdict_json"]).withColumn("r", F.try_parse_json("record"))
    # a column of its own, so that the items are read once for both fields
    rows = rows.withColumn("_items", J.items(F.col("r")))
    record, items = F.col("r"), F.col("_items")
    return rows.select(
        "event_id",
        J.incorrect_information(record).alias("incorrect"),
        J.style_comment(record).alias("style"),
        J.item_field(items, record, "correct_info").alias("correct_info"),
        J.item_field(items, record, "info_used").alias("info_used"),
    )


@query("annotation_frame", """SELECT event_id, eid, CASE WHEN k % 5 = 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS request_cost,
  CASE k % 5 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 4.0 WHEN 3 THEN 5.0 END::DOUBLE AS faithfulness_score,
  CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 END::INT AS n_items,
  CASE k % 5 WHEN 0 THEN concat('a ', CAST(event_id AS @STR)) WHEN 1 THEN concat('f1 ', CAST(event_id AS @STR)) WHEN 2 THEN '' WHEN 3 THEN '' END AS first_info,
  CASE k % 5 WHEN 0 THEN concat(' fine ', CAST(event_id AS @STR), ' ') WHEN 1 THEN concat('since ', eid) END AS style_comment FROM v_judged_faith""")
def annotation_frame(t: Tables):
    rows = t.sql(HELPERS["o_verdict_json"]).withColumn("r", F.try_parse_json("record"))
    fields = J.annotation_fields(F.col("r"))
    items = fields["incorrect_information"]
    return rows.select(
        "event_id",
        *[fields[n].alias(n) for n in ("eid", "request_cost", "faithfulness_score", "style_comment")],
        F.when(items.isNotNull(), F.size(items)).alias("n_items"),
        F.try_element_at(items, F.lit(1))["info_used"].alias("first_info"),
    )


_WORD = fixed.WORD_PATTERN.replace("'", "''")


def keyword_oracle(source: str, group: str, text: str, stop, size: int) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    words = (
        f"list_filter(list_transform(regexp_extract_all({text}, '{_WORD}'), lambda w: lower(w)),"
        f" lambda w: w NOT IN ({listed}))"
    )
    grams = "toks" if size == 1 else (
        "list_transform(range(1, len(toks)), lambda i: concat(toks[i], ' ', toks[i + 1]))"
    )
    return f"""SELECT {group}, term, n FROM (SELECT {group}, term, count(*) AS n,
      row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, term) AS rn
    FROM (SELECT {group}, unnest({grams}) AS term FROM (SELECT {group}, {words} AS toks FROM {source}) a) b
    GROUP BY {group}, term) c WHERE rn <= 25"""


@query("keyword_unigrams", keyword_oracle("documents", "lang", "text", fixed.ERROR_STOPWORDS, 1))
def keyword_unigrams(t: Tables):
    return I.keywords(t.spread("documents", "lang", "text"), ["lang"], "text", fixed.ERROR_STOPWORDS, 1)


@query("keyword_bigrams", keyword_oracle("documents", "lang", "text", fixed.ERROR_STOPWORDS, 2))
def keyword_bigrams(t: Tables):
    return I.keywords(t.spread("documents", "lang", "text"), ["lang"], "text", fixed.ERROR_STOPWORDS, 2)


@query("compact_payload", """SELECT doc_id, CASE WHEN length(text) > 4000 THEN length(text) END AS original_length,
  CASE WHEN length(text) > 4000 THEN left(text, 4000) ELSE text END AS kept FROM documents""")
def compact_payload(t: Tables):
    rows = t.documents.select("doc_id", "text", G.compact_payload(F.col("text"), fixed.PAYLOAD_LIMIT).alias("p"))
    cut = F.from_json("p", "_truncated_json string, _original_length int")
    long = F.length("text") > fixed.PAYLOAD_LIMIT
    return rows.select(
        "doc_id",
        F.when(long, cut["_original_length"]).alias("original_length"),
        F.when(long, cut["_truncated_json"]).otherwise(F.col("p")).alias("kept"),
    )
