"""Plans that read a text once, and partitions and files that follow the input."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textjudge.functions import terms as T
from textjudge.functions import verdicts as J
from textjudge.operators import construct as N
from textjudge.operators import substitute as U
from textjudge.operators.lineage import shared_folder
from textjudge.plans import queries_issues, views
from textjudge.plans.views import Tables
from textjudge.sources import judged, xml
from textjudge.sources.sinks import scratch
from tests.harness import DATA, plain

SF = f"{DATA}/sf0.001"


def optimized(df) -> str:
    """Optimized plan with long expressions uncut."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.maxMetadataStringLength")
    conf.set("spark.sql.maxMetadataStringLength", "1000000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.set("spark.sql.maxMetadataStringLength", was)


def test_quarantine_parses_a_text_once_per_operator(spark):
    raw = ['{"faithfulness_score": 4}', '{"faithfulness_score": 9} x', "none", None, "[1]", '{"faithfulness_score": "a"}', '{"a": 1']
    rows = judged.quarantine(spark.createDataFrame(list(enumerate(raw)), "id int, raw string"), "raw", ["id"])
    assert optimized(rows).count("parseJson") <= 2
    bad, none = "invalid or missing faithfulness_score: ", "malformed or missing verdict"
    assert {r.id: r.problem for r in rows.collect()} == {1: bad + "9", 2: none, 3: none, 4: none, 5: bad + "None", 6: none}


def test_scores_of_a_record_parse_it_once(spark):
    lines = ['{"parsed": {"s": 4.0}}', '{"parsed": {"s": "4"}}', '{"parsed": {"s": 2.5}}', '{"parsed": {"s": 9}}', "{", '{"parsed": {"s": 1}}']
    rows = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("r", F.try_parse_json("line"))
    scored = rows.select("line", J.score_in_range(J.field(F.col("r"), "$.parsed"), "s").alias("score")).where("score IS NOT NULL")
    assert optimized(scored).count("parseJson") <= 2
    assert sorted(r.score for r in scored.collect()) == [1, 4]


def test_kind_reads_its_value_once(spark):
    texts = ["1", "1.5", "1e300", '"a(b<"', "[1]", '{"a(": 1}', "true", "null", "x"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    named = rows.select("i", J.kind(F.try_parse_json("x")).alias("k"))
    assert optimized(named).count("parseJson") == 1
    assert [r.k for r in named.orderBy("i").collect()] == ["int", "real", "real", "text", "list", "object", "bool", "", ""]


def test_comment_text_reads_its_value_once(spark):
    texts = ['["a", " b ", {"x":1}, null]', '{"x":1}', '" t "', "null"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    read = rows.select("i", J.comment_text(F.try_parse_json("x")).alias("t"))
    assert optimized(read).count("parseJson") == 1
    assert [r.t for r in read.orderBy("i").collect()] == ['a; b; {"x":1}', '{"x":1}', "t", ""]


def test_comments_are_classified_once(spark):
    comments = spark.range(4).selectExpr("1 AS score", "concat('word order, comma ', if(id % 2 = 0, id, null)) AS comment")
    rows = queries_issues.fluency_by_category(SimpleNamespace(v_judged_fluency=comments))
    assert optimized(rows).count("bword order") == 1
    assert sorted(map(tuple, rows.collect())) == [(c, f"word order, comma {i}") for c in ("Punctuation", "WordOrder") for i in (0, 2)]


def test_responses_are_read_once(spark):
    plan = optimized(entry.queries()["parse_mtriples"](spark, SF))
    assert plan.count("^<mtriple>") == 1
    assert plan.count("|[") == 1  # the line breaks


def test_terms_are_read_once_per_entry(spark):
    listed = F.from_json("j", "array<string>")
    rows = spark.createDataFrame([('["a","b"]',), ("[]",)], "j string").select(T.format_terms(listed).alias("t"))
    assert optimized(rows).count("from_json") == 1
    assert rows.collect()[0].t == "- a\n- b"
    sentences = spark.createDataFrame([("e", f"s{i}") for i in range(3)] + [("e", " ")], "eid string, sentence string")
    triples = spark.createDataFrame([("e", "c", "NA", "NA", 1, "original", 1, "a_b", "p", "o")],
                                    "eid string, category string, shape string, shape_type string, size int, kind string, pos int, subject string, predicate string, object string")
    rows = N.enrich_sentences(sentences, N.entries(triples), {"upper": F.upper("modified_triples")})
    assert sorted((r.sentence, r.upper) for r in rows.collect()) == [(f"s{i}", "- A B | P | O") for i in range(3)]


@pytest.mark.parametrize("name", ["source_meta", "kind_by_dataset", "tagged_xml_roundtrip"])
def test_sorts_of_an_order_follow_the_rows(spark, monkeypatch, name):
    query, seen = entry.queries()[name], []
    few = sorted(map(str, query(spark, SF).collect()))
    real = Tables.sql
    monkeypatch.setattr(Tables, "sql", lambda t, text: seen.append(real(t, text)) or seen[-1])
    monkeypatch.setattr(views, "ROWS_PER_TASK", 300)
    assert sorted(map(str, query(spark, SF).collect())) == few
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert seen[0].rdd.getNumPartitions() == -(-rows // 300) > 8


def test_tagged_entries_are_written_in_bounded_files(spark):
    rows = [(i, "c", "p", 1, "s", None, "q", f"o{i}", "misto") for i in range(25)]
    triples = spark.createDataFrame(rows, "id long, category string, phrase string, pos int, subject string, subject_type string, predicate string, object string, object_type string")
    path = scratch(spark)
    xml.write_tagged_xml(triples.coalesce(1), path, 2)
    assert shared_folder(spark) in path and len(spark.read.text(path).inputFiles()) >= 13
    assert sorted(r.object for r in xml.read_tagged_xml(spark, path, "cs").collect()) == sorted(r[7] for r in rows)


def test_spread_tables_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TEXTS_PER_TASK", 10)
    t = Tables(spark, SF)
    wide, rows = t.spread("documents", "lang", "text"), t.documents.select("lang", "text")
    assert wide.rdd.getNumPartitions() == -(-rows.count() // 10)
    show = lambda df: sorted(str([plain(v) for v in r]) for r in df.collect())
    assert show(wide) == show(rows)


def test_every_line_break_splits(spark):
    from textjudge.functions.cleaning import _LINE_BREAK, lines

    breaks = ["\r\n", *map(chr, (0x0A, 0x0D, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029))]
    others = "".join(map(chr, (0x09, 0x20, 0x1F, 0xA0, 0x200B, 0x2027, 0x202A)))
    text = "".join(f"{i}{b}" for i, b in enumerate(breaks)) + others
    got = spark.createDataFrame([(text,)], "t string").select(lines(F.col("t")).alias("l")).first().l
    assert got == [*map(str, range(len(breaks))), others]
    assert len(_LINE_BREAK) < 20


def test_members_are_replaced_by_bytes(spark):
    rows = spark.createDataFrame([("a_b c__é_",), (None,), ("",)], "t string")
    shown = rows.select(T.display(F.col("t")), T.member_value(F.col("t")), T.normalize_member(F.col("t")))
    assert [tuple(r) for r in shown.collect()] == [("a b c  é ", "a_b_c__é_", "ab ce"), (None,) * 3, ("",) * 3]
    assert "translate(t" not in optimized(rows.select(T.display(F.col("t")), T.member_value(F.col("t"))))


def test_an_answer_is_stripped_once(spark):
    from textjudge.functions.labels import parse_label

    plan = optimized(spark.createDataFrame([("FA",)], "a string").select(parse_label(F.col("a")).alias("l")))
    assert plan.count("coalesce(a#") == 1


TRIPLES = "eid string, subject string, predicate string, object string, object_type string"


def triples(spark, rows):
    return spark.createDataFrame([(e, f"S_{e}", "p", o, t) for e, o, t in rows], TRIPLES)


def test_members_and_replacements_are_sorted_once(spark):
    rows = triples(spark, [(f"Id{i % 9}", f"v_{i % 7}", "t") for i in range(60)])
    agg = U.tagged_members(rows)._jdf.queryExecution().executedPlan().toString()
    assert agg.count("Exchange ") == agg.count("Sort [") == 1
    new = spark.createDataFrame([("Id1", "v1", "x"), ("Id1", "v2", "y"), ("Id3", "v3", "z"), (None, "v1", "n")], "eid string, norm string, new_value string")
    swapped = U.apply_replacements(rows, new)
    assert "ObjectHashAggregate" not in swapped._jdf.queryExecution().executedPlan().toString()
    want = {("Id1", "v_1"): "x", ("Id1", "v_2"): "y", ("Id3", "v_3"): "z"}
    old = [(f"Id{i % 9}", f"v_{i % 7}") for i in range(60) if i % 9 in (1, 3)]
    assert sorted((r.eid, r.object) for r in swapped.collect()) == sorted((e, want.get((e, o), o)) for e, o in old)


def test_invented_members_are_chosen_before_they_meet_the_pool(spark):
    rows = triples(spark, [(f"Id{i}", o, t) for i in range(40) for o, t in ((f"v_{i % 3}", "many"), ("only_one", "sole"), ("other", "sole"), ("w", "none"))] + [(None, "v_1", "many")] * 5)
    assets = spark.createDataFrame([("many", f"v_{k}") for k in range(6)] + [("sole", "only_one"), ("sole", "onlyone"), ("gone", "g")], "type string, value string")
    out = U.fictional(rows, assets, max_changes=3)
    # one join of chosen members with forms, one with the pool, one with the triples; no exchange between members and choice
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    chosen, forms = plan.index("_rank#"), plan.index("max(own_size#")
    assert plan[:forms].count("Window [row_number()") >= 1 and chosen < forms
    got = {(r.eid, r.object) for r in out.collect()}
    assert None not in {e for e, _ in got}
    kept = {o for _, o in got}
    # the sole form of a type has no alternative; a member of another form takes it, in one of its spellings
    assert "only_one" in kept and "w" in kept and "g" not in kept
    changed = U.fictional(rows.filter("object = 'only_one' OR object = 'w'"), assets)
    assert changed.count() == 0
    swapped = U.fictional(rows.filter("object = 'other'"), assets).collect()
    assert len(swapped) == 40 and {r.object for r in swapped} <= {"only_one", "onlyone"}
    many = U.fictional(rows.filter("object_type = 'many'"), assets).collect()
    assert len(many) == 40 and all(r.object != f"v_{int(r.eid[2:]) % 3}" for r in many)


def whole(spark, df, max_changes, types, rows_per_bucket):
    """Counterfactual entries with all triples and the whole numbered pool at once."""
    own = U.tagged_members(df)
    numbered, _ = U.number_pool(own if types is None else own.filter(F.col("type").isin(*types)), ["eid"], rows_per_bucket)
    chosen = U.choose_members(numbered.filter("pool_size > own_size"), max_changes, 140)
    return U.apply_replacements(df, U.draw_replacements(chosen, numbered, 140))


def member_triples(spark, n):
    """Spellings of one form, forms that fill most of a type, types of one form, repeated triples, rows without an entry."""
    rows = []
    for i in range(n):
        eid = None if i % 17 == 0 else f"Id{i // 3}"
        rows.append((eid, ("a_b", "ab", "áb", "c", f"v_{i % 11}")[i % 5], "mixed"))
        rows.append((eid, "hot_value" if i % 9 else f"rare_{i}", "crowded"))
        rows.append((eid, ("only_one", "onlyone")[i % 2], "sole"))
        rows += rows[-3:] if i % 13 == 0 else []
    return triples(spark, rows)


@pytest.mark.parametrize("rows_per_bucket, run, changes, types", [(50_000, 64, 2, None), (9, 4, 3, None), (50_000, 2, 4, ["crowded", "sole"])])
def test_counterfactual_in_parts_is_the_whole(spark, monkeypatch, rows_per_bucket, run, changes, types):
    monkeypatch.setattr(U, "ROWS_PER_BUCKET", rows_per_bucket)
    monkeypatch.setattr(U, "RUN", run)
    df = member_triples(spark, 300)
    want = sorted(map(str, whole(spark, df, changes, types, rows_per_bucket).collect()))
    assert 0 < len(want) < df.count()
    for n in (1, 3):
        parts = [df.where(F.pmod(F.hash("eid"), F.lit(n)) == k) for k in range(n)]
        got = U.counterfactual(df if n == 1 else parts, changes, types, seed=140)
        assert sorted(map(str, got.collect())) == want
        assert got.columns == df.columns


def test_counterfactual_without_sole_types_and_without_rows(spark):
    df = member_triples(spark, 90).where("object_type = 'mixed'")
    want = sorted(map(str, whole(spark, df, 2, None, 50_000).collect()))
    assert sorted(map(str, U.counterfactual([df.where("subject < 'S_Id2'"), df.where("subject >= 'S_Id2' OR subject IS NULL")], 2, seed=140).collect())) == want
    assert U.counterfactual([df.limit(0), df.limit(0)]).count() == 0


def test_counterfactual_leaves_little_on_the_disk(spark, tmp_path, monkeypatch):
    """Neither the pool nor its numbers stay behind; only what the last part and the result need does."""
    monkeypatch.setattr(U, "shared_folder", lambda s: str(tmp_path), raising=False)
    U.materialize(spark.range(1))
    kept = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for root in (kept, tmp_path) for p in root.rglob("*") if p.is_file())
    n = 20_000
    df = spark.range(n).selectExpr("concat('Id', id div 4) AS eid", "concat('S_', id) AS subject", "'p' AS predicate", "concat('some_name_', id % 700) AS object", "'t' AS object_type")
    before = size()
    assert U.counterfactual(df).count() > n / 2
    assert size() - before < 20 * n
    U.counterfactual([df.where(F.pmod(F.hash("eid"), F.lit(3)) == k) for k in range(3)])
    assert {p.name for p in tmp_path.glob("*/*")} == {"numbered", "replacements", "result"}


def test_parts_of_orders_are_the_view(spark, tmp_path):
    lines = [(None if i % 10 == 0 else i // 3, i % 5, 1, i % 7, float(i % 2)) for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"n {k}", "t") for k in (0, 1, 2, 2)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, "1-URGENT") for k in (1, 2, 2, 5)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    for per_task in (views.ROWS_PER_TASK, 4):
        t = Tables(spark, str(tmp_path))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(views, "ROWS_PER_TASK", per_task)
            parts = t.by_orders("v_triples", 10, 4)
            every = t.v_triples
        assert len(parts) == 4 and len(t.by_orders("v_triples", 60, 4)) == 1
        rows = [p.collect() for p in parts]
        assert sorted(map(str, sum(rows, []))) == sorted(map(str, every.collect()))
        eids = [{r.eid for r in part} for part in rows]
        assert sum(map(len, eids)) == len(set().union(*eids))
        # the part is taken where line items are read
        assert optimized(parts[1]).rindex("xxhash64") > optimized(parts[1]).rindex("Join")
