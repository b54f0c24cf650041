"""Evaluation-shaped views over the driver tables.

Each view is one SQL text. Five tokens differ per engine (see ``FIXTURES.md``);
``spark_view`` resolves them for Spark and ``oracle`` for DuckDB, so both sides
read the same parquet through the same definition.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "v_judged_faith": """
SELECT event_id, concat('m', CAST(user_id % 9 AS @STR)) AS model,
  CASE WHEN event_id % 2 = 0 THEN 'cs-qa' ELSE 'sk-qa' END AS dataset,
  CASE @K % 3 WHEN 0 THEN 'fa' WHEN 1 THEN 'cf' ELSE 'fi' END AS variant,
  CASE CAST(floor(event_id / 2) AS BIGINT) % 4
    WHEN 0 THEN 'en' WHEN 1 THEN 'cs' WHEN 2 THEN 'sk' ELSE 'hsb' END AS language,
  concat('Id', CAST(CAST(floor(event_id / 400) AS BIGINT) AS @STR)) AS eid,
  ts, @K AS k, user_id,
  CASE WHEN @K = 13 THEN NULL WHEN @K = 77 THEN 7 ELSE 1 + ((@K * 7 + user_id) % 5) END AS score
FROM events""",
    "v_judged_fluency": """
SELECT event_id, model, dataset, variant, language, eid, ts,
  CASE WHEN k = 29 THEN NULL ELSE 1 + ((k * 3 + user_id * 2) % 5) END AS score,
  CASE k % 10 WHEN 0 THEN 'Wrong genitive case and word order.' WHEN 1 THEN 'Missing comma; awkward phrasing.'
    WHEN 2 THEN 'The sentence is not Czech.' WHEN 3 THEN 'Spelling mistake in the verb form.'
    WHEN 4 THEN 'Uses the Slovak word instead of the Czech equivalent.'
    WHEN 5 THEN 'Not a complete sentence, a list of terms.'
    WHEN 6 THEN 'The date format is unusual.' WHEN 7 THEN 'Sounds odd and redundant.'
    WHEN 8 THEN 'Untranslated term left in English.' ELSE 'Fine overall.' END AS comment
FROM v_judged_faith""",
    "v_latest_faith": """
SELECT model, dataset, variant, language, eid, ts, k, score, event_id FROM (
  SELECT j.*, row_number() OVER (PARTITION BY model, dataset, variant, language, eid
    ORDER BY ts DESC, event_id DESC) AS rn
  FROM v_judged_faith j WHERE score BETWEEN 1 AND 5) x WHERE rn = 1""",
    "v_latest_fluency": """
SELECT model, dataset, variant, language, eid, ts, score, comment, event_id FROM (
  SELECT j.*, row_number() OVER (PARTITION BY model, dataset, variant, language, eid
    ORDER BY ts DESC, event_id DESC) AS rn
  FROM v_judged_fluency j WHERE score BETWEEN 1 AND 5) x WHERE rn = 1""",
    "v_answers": """
SELECT model, dataset, variant, language, eid, i AS repeat_idx,
  CASE @HASH(akey) % 12 WHEN 0 THEN 'FA' WHEN 1 THEN 'FA' WHEN 2 THEN 'CFA' WHEN 3 THEN 'CFA' WHEN 4 THEN 'FI'
    WHEN 5 THEN '**FI**' WHEN 6 THEN 'Label: CFA' WHEN 7 THEN 'The set is factual.' WHEN 8 THEN 'FA or FI'
    WHEN 9 THEN 'kontrafaktualni' WHEN 10 THEN 'DELEKA' ELSE '' END AS answer
FROM (SELECT z.*, concat_ws('|', model, dataset, variant, language, eid, CAST(i AS @STR)) AS akey
  FROM (SELECT model, dataset, variant, language, eid, @SEQ(1,5) AS i FROM v_latest_faith) z) y""",
    "v_issue_items": """
SELECT event_id, model, dataset, variant, language, eid, score, i AS item_index,
  concat(CASE (k + i * 5) % 12 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'wrong_object' WHEN 2 THEN 'wrong_predicate'
    WHEN 3 THEN 'reverse' WHEN 4 THEN 'negation' WHEN 5 THEN 'omission' WHEN 6 THEN 'over_specific'
    WHEN 7 THEN 'wrong_language' WHEN 8 THEN 'wrong_transform' WHEN 9 THEN 'repetition' WHEN 10 THEN 'degenerate'
    ELSE 'borderline' END, ': the sentence adds detail number ', CAST(k AS @STR)) AS comment,
  concat(eid, ' | ', CASE (k + i) % 4 WHEN 0 THEN 'locatedIn' WHEN 1 THEN 'hasChild' WHEN 2 THEN 'type'
    ELSE 'partOf' END, ' | value') AS correct_info,
  concat('claim ', CAST(i AS @STR)) AS info_used
FROM (SELECT j.*, @SEQ(0,2) AS i FROM v_judged_faith j) z WHERE score < 5 AND i <= k % 3""",
    "v_triples": """
SELECT concat('Id', CAST(l_orderkey AS @STR)) AS eid, coalesce(o_orderpriority, 'other') AS category,
  'NA' AS shape, 'NA' AS shape_type, 'original' AS kind,
  row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS size,
  concat('Order_', CAST(l_orderkey AS @STR)) AS subject,
  CASE l_linenumber % 4 WHEN 0 THEN 'hasPart' WHEN 1 THEN 'shippedFrom' WHEN 2 THEN 'contains'
    ELSE 'type' END AS predicate,
  concat(replace(p_name, ' ', '_'), '_', CAST(l_partkey AS @STR)) AS object, p_type AS object_type
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "v_outputs": """
SELECT concat('src', CAST(s AS @STR)) AS source_id, eid,
  CASE @HASH(okey) % 5 WHEN 0 THEN concat(subject, ' ', predicate, ' ', object, '.') WHEN 1 THEN ''
    ELSE concat(replace(subject, '_', ' '), ' goes with ', replace(object, '_', ' '), '.') END AS sentence
FROM (SELECT z.*, concat_ws('|', eid, CAST(s AS @STR)) AS okey
  FROM (SELECT eid, subject, predicate, object, @SEQ(0,2) AS s FROM v_triples WHERE pos = 1) z) y""",
    "v_entry_xml": """
SELECT eid, concat('<entry category="', min(category), '" eid="', eid, '" shape="NA" shape_type="NA" size="',
  CAST(count(*) AS @STR), '"><originaltripleset>',
  @LISTAGG(concat('<otriple>', subject, ' | ', predicate, ' | ', object, '</otriple>'),'',pos),
  '</originaltripleset></entry>') AS xml
FROM v_triples GROUP BY eid""",
    # keys changed on purpose: joins meet misses although every row is read
    "v_generated": """
SELECT model, dataset, variant, language, CASE WHEN k = 50 THEN concat(eid, '-other') ELSE eid END AS eid, k % 11 AS triple_count
FROM v_latest_faith""",
    "v_fluency_elsewhere": """
SELECT model, dataset, variant, language, CASE WHEN score >= 3 THEN eid ELSE concat(eid, '-other') END AS eid FROM v_judged_fluency""",
    "v_context": """
SELECT concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS @STR), CASE WHEN p_size > 10 THEN '' ELSE '-other' END) AS member,
  concat('about ', p_brand) AS context FROM part""",
    "v_raw_responses": """
SELECT event_id, CASE WHEN k = 13 THEN 'no verdict here' WHEN k = 14 THEN '{"faithfulness_score": 4, "incorrect'
  ELSE concat('Verdict follows. {"faithfulness_score": ', CAST(coalesce(score, 0) AS @STR),
    ', "incorrect_information": []} end') END AS raw
FROM v_judged_faith""",
    "v_annotations": """
SELECT d.doc_id AS uid, concat('A', CAST(d.doc_id % 3 AS @STR)) AS annotator,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE concat(CAST(1 + (d.doc_id * 3 + quality * 2) % 5 AS @STR),
    CASE WHEN d.doc_id % 7 = 0 THEN '?' ELSE '' END) END AS human_score,
  1 + (d.doc_id * 3 + quality * 2 + CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 0 END) % 5 AS judge_score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_chatter": """
SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN concat('```', chr(10), '- ', text, chr(10), '```', chr(10), 'length: 12')
    WHEN 1 THEN concat('"', text, '" (length 20)')
    WHEN 2 THEN concat('1. ', text, chr(10), chr(10), 'Vety: 3')
    WHEN 3 THEN concat('<think>plan the words</think>', text, ' length: 5')
    WHEN 4 THEN concat('`', chr(39), text, chr(39), '`')
    ELSE text END AS content
FROM documents""",
}


def _split_args(text: str, start: int) -> tuple[list[str], int]:
    depth, args, current, i, quoted = 1, [], "", start, False
    while True:
        ch = text[i]
        if ch == "'":
            quoted = not quoted
        if not quoted:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    return args + [current], i + 1
            elif ch == "," and depth == 1:
                args.append(current)
                current, i = "", i + 1
                continue
        current += ch
        i += 1


_CALLS = {
    "spark": {
        "HASH": lambda x: f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)",
        "DRAW": lambda x: f"CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)",
        "SEQ": lambda a, b: f"explode(sequence({a}, {b}))",
        "LISTAGG": lambda x, s, o: f"listagg({x}, {s}) WITHIN GROUP (ORDER BY {o})",
    },
    "duckdb": {
        "HASH": lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)",
        "DRAW": lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)",
        "SEQ": lambda a, b: f"unnest(range({a}, {b} + 1))",
        "LISTAGG": lambda x, s, o: f"string_agg({x}, {s} ORDER BY {o})",
    },
}
_WORDS = {
    "spark": {"STR": "STRING", "K": "CAST(get_json_object(props, '$.k') AS INT)"},
    "duckdb": {"STR": "VARCHAR", "K": "CAST(json_extract_string(props, '$.k') AS INT)"},
}


def render(sql: str, engine: str) -> str:
    """Resolve the engine tokens of one SQL text."""
    for name, build in _CALLS[engine].items():
        marker = f"@{name}("
        while marker in sql:
            at = sql.index(marker)
            args, end = _split_args(sql, at + len(marker))
            sql = sql[:at] + build(*args) + sql[end:]
    for name, text in _WORDS[engine].items():
        sql = re.sub(rf"@{name}\b", lambda _m, t=text: t, sql)
    return sql


def _needed(sql: str, pool: dict[str, str]) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[vo]_\w+\b", text):
            if name in pool and name not in order:
                visit(pool[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str, engine: str, pool: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the view definitions that it refers to."""
    pool = VIEWS if pool is None else pool
    parts = [f"{n} AS ({render(pool[n], engine)})" for n in _needed(sql, pool)]
    body = render(sql, engine)
    if not parts:
        return body
    head = ",\n".join(parts)
    if re.match(r"\s*WITH\b", body, re.I):
        return f"WITH {head},\n" + re.sub(r"^\s*WITH\b", "", body, count=1, flags=re.I)
    return f"WITH {head}\n{body}"


#: rows that one task sorts, and texts that one task reads
ROWS_PER_TASK, TEXTS_PER_TASK = 1_000_000, 20_000
_WITH_PART = "lineitem LEFT JOIN part ON l_partkey = p_partkey"


def spread_lines(sql: str, parts: int) -> str:
    """Spark text whose line items are grouped by order, with ``parts`` tasks for its sorts.

    Hints only: joins with parts, joins with orders and the windows over an order keep
    their partitions instead of the fixed number of the session.
    """
    by_order = f"SELECT /*+ REPARTITION({parts}, l_orderkey) */ * FROM "
    by_part = f"(SELECT /*+ REPARTITION({parts}, p_partkey) */ * FROM part)"
    if f"FROM {_WITH_PART}" in sql:
        return sql.replace(f"FROM {_WITH_PART}", f"FROM ({by_order}{_WITH_PART.replace('JOIN part', f'JOIN {by_part}')})")
    return re.sub(r"\bFROM lineitem\b", f"FROM ({by_order}lineitem)", sql)


def order_part(sql: str, k: int, parts: int) -> str:
    """Spark text that reads the line items of part ``k`` of all orders, dealt by a hash of the order."""
    return re.sub(r"\bFROM lineitem\b", f"FROM (SELECT * FROM lineitem WHERE pmod(xxhash64(l_orderkey), {parts}) = {k})", sql)


class Tables:
    """Driver tables and evaluation views as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, sql: str, part: tuple[int, int] | None = None) -> DataFrame:
        """Run a SQL text that may refer to driver tables and views; ``part`` as in ``order_part``."""
        text = with_views(sql, "spark")
        if "PARTITION BY l_orderkey" in text and (parts := self.tasks("lineitem", ROWS_PER_TASK)) > self.width:
            text = spread_lines(text, parts)
        if part is not None:
            text = order_part(text, *part)
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text, re.I)]
        for t in used:
            text = re.sub(
                rf"\b(FROM|JOIN)\s+{t}\b",
                lambda m, t=t: f"{m.group(1)} parquet.`{self.sf_dir}/{t}.parquet`",
                text,
                flags=re.I,
            )
        return self.spark.sql(text)

    def by_orders(self, view: str, rows: int, most: int) -> list[DataFrame]:
        """A view of whole orders in parts of about ``rows`` line items, ``most`` parts at most; together they are the view."""
        parts = min(most, self.tasks("lineitem", rows))
        return [self.sql(f"SELECT * FROM {view}", (k, parts)) for k in range(parts)] if parts > 1 else [getattr(self, view)]

    @property
    def width(self) -> int:
        """Number of shuffle partitions the session asks for."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def tasks(self, name: str, rows: int) -> int:
        """Tasks for a table at ``rows`` rows each; the count comes from the file footers."""
        return math.ceil(getattr(self, name).count() / rows)

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table dealt over tasks, for work that its few row groups would bind to few tasks."""
        return getattr(self, name).select(*columns).repartition(max(self.width, self.tasks(name, TEXTS_PER_TASK)))
