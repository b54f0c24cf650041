"""Scan and sink queries (A1-A14): files derived from the tables are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textjudge.functions.keys import KEY
from textjudge.operators import votes as V
from textjudge.plans.registry import query
from textjudge.plans.queries_text import judged_records
from textjudge.plans.views import Tables
from textjudge.sources import judged as J
from textjudge.sources import sinks as K
from textjudge.sources import tables as S
from textjudge.sources import xml as X
from textjudge.sources.files import first_lines as first_lines_of

_KEYS = ", ".join(KEY)


def _stem():
    return F.concat_ws("_", "dataset", "variant", "language")


def _judged_tree(t: Tables, stamp: str = "lpad(event_id, 12, '0')") -> str:
    """JSON-lines tree of the raw judgments, a file per model by event, some lines cut short."""
    path = K.scratch(t.spark)
    record = F.to_json(
        F.struct(
            "eid",
            _stem().alias("source_label"),
            F.concat_ws("__", "model", _stem()).alias("source_id"),
            F.expr(stamp).alias("timestamp"),
            F.concat(F.lit("sentence "), F.col("event_id")).alias("sentence"),
            F.struct(F.col("score").alias("faithfulness_score"), F.col("items").alias("incorrect_information")).alias("parsed"),
        )
    )
    broken = F.when(F.col("k") == 31, F.substring(record, 1, 40)).otherwise(record)
    rows = judged_records(t).select(broken.alias("value"), F.col("model").alias("_m"), "event_id")
    rows.repartition("_m").sortWithinPartitions("_m", "event_id").drop("event_id").write.partitionBy("_m").text(path)
    return path


_LINES = "row_number() OVER (PARTITION BY model ORDER BY event_id) AS line_no"


@query("scan_judged", f"""SELECT {_KEYS}, score, line_no FROM (SELECT *, {_LINES} FROM v_judged_faith) x
  WHERE score BETWEEN 1 AND 5 AND k <> 31 QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY event_id DESC) = 1""")
def scan_judged(t: Tables):
    """Time stamps are equal for all judgments of a key: the last line of the file wins."""
    from textjudge.operators.merge import newest

    judged = J.read_judged(t.spark, _judged_tree(t, "cast(event_id div 400 as string)"), glob="*.txt")
    valid = judged.filter(F.col("score").isNotNull())
    return newest(valid, KEY, J.latest_order()).select(*KEY, "score", "line_no")


@query("scan_bad_lines", f"""SELECT model, line_no, problem FROM (SELECT model, {_LINES}, CASE WHEN k = 31 THEN 'malformed JSON'
  WHEN score IS NULL OR score NOT BETWEEN 1 AND 5 THEN 'invalid or missing score' END AS problem FROM v_judged_faith) x
  WHERE problem IS NOT NULL UNION ALL SELECT DISTINCT model, NULL, 'header without eid' FROM v_judged_faith""")
def scan_bad_lines(t: Tables):
    """Quarantine of a judged tree together with the bad files of an output tree."""
    path = K.scratch(t.spark)
    lost = t.v_judged_faith.select(F.lit("x").alias("name"), F.col("model").alias("_m"), F.lit("cs-qa_fa_en").alias("_f")).distinct()
    lost.coalesce(1).write.partitionBy("_m", "_f").option("header", "true").csv(path)
    judged = J.read_judged(t.spark, _judged_tree(t), glob="*.txt")
    bad = J.bad_lines(judged, S.bad_files(t.spark, path, place=_place))
    return bad.select(_place(F.col("path"))[0].alias("model"), "line_no", "problem")


@query("first_lines", """SELECT model, line_no, event_id, place FROM (SELECT model, event_id,
  row_number() OVER (PARTITION BY model ORDER BY event_id) AS line_no, row_number() OVER (ORDER BY model, event_id) - 1 AS place
  FROM v_judged_faith) x WHERE place < 1500""")
def first_lines(t: Tables):
    """The first lines of a tree of one file per model, in the order of the files."""
    path = K.scratch(t.spark)
    rows = t.v_judged_faith.select(F.concat(F.lit("event "), F.col("event_id")).alias("value"), F.col("model").alias("_m"), "event_id")
    rows.repartition("_m").sortWithinPartitions("_m", "event_id").drop("event_id").write.partitionBy("_m").text(path)
    found = first_lines_of(t.spark, path, 1500, "*.txt")
    return found.select(_place(F.col("path"))[0].alias("model"), "line_no", F.substring("line", 7, 20).cast("long").alias("event_id"), "place")


@query("failures_by_type", """SELECT concat('Error', CAST(user_id % 4 AS VARCHAR)) AS error_type, count(*) AS n FROM v_judged_faith
  WHERE score IS NULL OR score > 5 GROUP BY 1""")
def failures_by_type(t: Tables):
    path = K.scratch(t.spark)
    failed = t.v_judged_faith.filter("score IS NULL OR score > 5")
    record = F.struct(
        "eid", F.concat(F.lit("Error"), F.col("user_id") % 4).alias("error_type"), F.lit("no answer").alias("error")
    )
    failed.select(F.to_json(record).alias("value")).write.text(path)
    return J.failures_by_type(J.read_failures(t.spark, path, glob="*.txt"))


def _place(path):
    """Partition folders of a test tree stand for the model folder and file name."""
    return F.regexp_extract(path, "_m=([^/]*)", 1), F.regexp_extract(path, "_f=([^/]*)", 1)


def _mixed_tree(t: Tables, df, columns: list[str]) -> str:
    """Output files with three column orders in one tree, by variant."""
    path = K.scratch(t.spark)
    orders = {"fa": columns, "cf": columns[::-1], "fi": [*columns[1:], columns[0]]}
    for variant, order in orders.items():
        part = df.where(F.col("variant") == variant).select(*order, F.col("model").alias("_m"), _stem().alias("_f"))
        part.write.mode("append").partitionBy("_m", "_f").option("header", "true").option("escape", '"').csv(path)
    return path


_WIDE = ["eid", "sentence", *[f"sentence_{i}" for i in range(1, 6)]]


@query("scan_classified", f"""SELECT model, label, count(*) AS n FROM o_labels
  JOIN (SELECT {_KEYS} FROM v_answers WHERE trim(answer) <> '' GROUP BY ALL) g USING ({_KEYS}) GROUP BY ALL""")
def scan_classified(t: Tables):
    from textjudge.functions.labels import parse_label

    path = _mixed_tree(t, V.pivot_repeats(t.v_answers), _WIDE)
    long = S.read_classified(t.spark, path, place=_place)
    return long.groupBy("model", parse_label(F.col("answer")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_generated", f"SELECT {_KEYS}, triple_count FROM v_generated")
def scan_generated(t: Tables):
    rows = t.v_generated.select(
        *KEY, F.col("triple_count").alias("size"), F.lit("one, \"two\"\nthree").alias("sentence")
    )
    path = _mixed_tree(t, rows, ["eid", "size", "sentence"])
    return S.read_generated(t.spark, path, place=_place).select(*KEY, "triple_count")


@query("scan_sentences", f"SELECT {_KEYS}, sentence, NULL::VARCHAR AS shape, size FROM (SELECT {_KEYS}, 'a, \"b\"' AS sentence, triple_count AS size FROM v_generated) x")
def scan_sentences(t: Tables):
    rows = t.v_generated.select(
        *KEY, F.col("triple_count").alias("size"), F.lit("NA").alias("shape"), F.lit('a, "b"').alias("sentence")
    )
    path = _mixed_tree(t, rows, ["shape", "eid", "size", "sentence"])
    return S.read_sentences(t.spark, path, place=_place).select(*KEY, "sentence", "shape", "size")


@query("scan_triples", """SELECT eid, pos, category, NULL::VARCHAR AS shape, subject, predicate, object FROM v_triples""")
def scan_triples(t: Tables):
    path = K.scratch(t.spark)
    rows = t.v_triples.select(*S.TRIPLE_COLUMNS, "pos").repartition("eid").sortWithinPartitions("eid", "pos")
    rows.drop("pos").write.option("header", "true").csv(path)
    back = S.read_triples(t.spark, path)
    return back.select("eid", "pos", "category", "shape", "subject", "predicate", "object")


@query("flatten_xml", "SELECT eid, category, size::INT AS size, kind, pos::INT AS pos, subject, predicate, object FROM v_triples")
def flatten_xml(t: Tables):
    return X.parse_entry_text(t.v_entry_xml, "xml").select(
        "eid", "category", "size", "kind", "pos", "subject", "predicate", "object"
    )


@query("export_entries_xml", "SELECT eid, category, size::INT AS size, kind, pos::INT AS pos, subject, predicate, object FROM v_triples")
def export_entries_xml(t: Tables):
    path = K.scratch(t.spark)
    X.write_benchmark_xml(t.v_triples, path, F.col("eid"))
    return X.read_benchmark_xml(t.spark, path).select(
        "eid", "category", "size", "kind", "pos", "subject", "predicate", "object"
    )


@query("export_numbered_xml", "SELECT concat('Id', eid) AS eid, category, size::INT AS size, pos::INT AS pos, subject, predicate, object FROM v_triples")
def export_numbered_xml(t: Tables):
    path = K.scratch(t.spark)
    X.write_benchmark_xml(t.v_triples.withColumnRenamed("eid", "id"), path)
    return X.read_benchmark_xml(t.spark, path).select("eid", "category", "size", "pos", "subject", "predicate", "object")


@query("scan_context_lines", "SELECT p_name AS keyword, concat('about ', p_brand) AS context FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def scan_context_lines(t: Tables):
    from pyspark.sql import Window

    path = K.scratch(t.spark)
    first = t.part.withColumn("n", F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))).where("n = 1")
    first.select(F.concat("p_name", F.lit("===about "), "p_brand").alias("value")).write.text(path)
    return S.read_context_lines(t.spark, path)


@query("bronze_tree", f"SELECT {_KEYS}, score FROM v_latest_faith")
def bronze_tree(t: Tables):
    from textjudge.plans.queries_scores import latest_faith

    path = K.scratch(t.spark)
    K.write_bronze(latest_faith(t).select(*KEY, "score"), path)
    return t.spark.read.parquet(path).select(*KEY, "score")


_TYPED = """SELECT l_orderkey AS id, 'c' AS category, concat('About ', CAST(l_orderkey AS @STR)) AS phrase,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  concat('Order ', CAST(l_orderkey AS @STR)) AS subject, CASE WHEN l_linenumber = 1 THEN 'jmeno' ELSE 'unknown' END AS subject_type,
  'hasPart' AS predicate, concat('Part_', CAST(l_partkey AS @STR)) AS object,
  CASE WHEN l_linenumber % 2 = 0 THEN 'misto' END AS object_type FROM lineitem"""


@query("tagged_xml_roundtrip", f"""SELECT id, category, phrase, pos::INT AS pos, replace(subject, ' ', '_') AS subject,
  CASE WHEN subject_type = 'jmeno' THEN 'jmeno' END AS subject_type, predicate, object, object_type FROM ({_TYPED}) x""")
def tagged_xml_roundtrip(t: Tables):
    path = K.scratch(t.spark)
    X.write_tagged_xml(t.sql(_TYPED), path)
    return X.read_tagged_xml(t.spark, path, "cs")


@query("assets_pool", "SELECT p_type AS type, p_name AS value FROM part")
def assets_pool(t: Tables):
    # asset files hold one object each: one file per slice of the part table
    path = K.scratch(t.spark)
    lists = t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("slice"), "p_type").agg(
        F.collect_list("p_name").alias("names")
    )
    objects = lists.groupBy("slice").agg(
        F.map_from_entries(F.collect_list(F.struct("p_type", "names"))).alias("m")
    )
    objects.select("slice", F.to_json("m").alias("value")).repartition("slice").write.partitionBy(
        "slice"
    ).text(path)
    return S.read_assets(t.spark, path + "/*")


@query("scan_qa", "SELECT doc_id AS id, source AS category, text AS question_orig, lang AS answer_orig FROM documents")
def scan_qa(t: Tables):
    path = K.scratch(t.spark)
    qa = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"),
        F.col("text").alias("question_orig"), F.col("lang").alias("answer_orig"), "n_chars",
    )
    qa.write.parquet(path)
    return S.read_qa(t.spark, path)


@query("annotation_sheet", "SELECT uid::VARCHAR AS uid, annotator, coalesce(human_score, '') AS human_score FROM v_annotations")
def annotation_sheet(t: Tables):
    path = K.scratch(t.spark)
    sheet = t.v_annotations.select("uid", "annotator", F.coalesce("human_score", F.lit("")).alias("human_score"))
    K.write_annotations(sheet, path)
    return S.read_annotations(t.spark, path)


@query("report_partitioned", """SELECT model AS generator_model, dataset, variant, count(*) AS rows FROM v_judged_faith
  WHERE score BETWEEN 1 AND 5 GROUP BY ALL""")
def report_partitioned(t: Tables):
    path = K.scratch(t.spark)
    cases = t.v_judged_faith.filter("score BETWEEN 1 AND 5").select(
        F.col("model").alias("generator_model"), "dataset", "variant", "language", "eid", "score"
    )
    K.write_report_tree({"score_cases": cases}, path, fmt="parquet")
    back = t.spark.read.parquet(f"{path}/score_cases")
    return back.groupBy("generator_model", "dataset", "variant").agg(F.count(F.lit(1)).alias("rows"))
