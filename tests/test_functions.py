"""Literal-row tests of the text and key functions, one branch each."""

import pytest
from pyspark.sql import functions as F

from textjudge.functions import categories as C
from textjudge.functions import cleaning as G
from textjudge.functions import keys as K
from textjudge.functions import labels as L
from textjudge.functions import terms as T
from textjudge.functions import verdicts as J


def values(spark, items, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", column.alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


V = F.col("v")


def test_parse_label(spark):
    cases = {
        "FA": "FA", "**fi**": "FI", "Label: CFA": "CFA", "FA or FI": "", "": "", None: "",
        "The set is factual.": "FA", "kontrafaktuálních": "CFA", "FIKTÍVNY": "FI", "DELEKA": "",
        "FA counterfactual": "FA",
    }
    assert values(spark, cases, L.parse_label(V)) == list(cases.values())


def test_parse_answer(spark):
    cases = {
        "FA": ("FA", "exact"), "`fi`.": ("FI", "recovered"), "": ("", "empty"), None: ("", "empty"),
        "FA FA": ("", "multiple"), "CFA because": ("CFA", "recovered"),
        "my answer - FI ok": ("FI", "recovered"), "so counterfactual": ("CFA", "recovered"),
        "factual or fictional": ("", "multiple"), "well FA is fictional": ("", "multiple"),
        "maybe FA": ("FA", "recovered"), "nothing": ("", "unparsed"),
    }
    got = values(spark, cases, L.parse_answer(V))
    assert [(r["label"], r["status"]) for r in got] == list(cases.values())


def test_sanitize_answer(spark):
    cases = {
        "CF": "CFA", "FA then FI": "INVALID", "It is FA here": "FA", "fictional it is": "FI",
        "factual, not fictional story": "INVALID", "no  label\nat all": "no label at all", "": "",
        "FA yes": "FA", "we say fa": "FA",
    }
    assert values(spark, cases, L.sanitize_answer(V)) == list(cases.values())


def test_clean_generated(spark):
    cases = {
        "```\n- A word.\n```": "A word.",
        "1. \"Quoted 'x'\"": "Quoted 'x'",
        "Text (len 5)": "Text",
        "Text length: 12": "Text",
        "\"'nested'\" (dĺžka 3)": "nested",
        "dlžka vety: 4\nBody": "Body",
        "a b": "a b",
        "  ": "",
        "": "",
    }
    assert values(spark, cases, G.clean_generated(V)) == list(cases.values())
    once = values(spark, cases, G.clean_generated(V))
    assert values(spark, once, G.clean_generated(V)) == once


@pytest.mark.parametrize("depth", [1, 3, 40])
def test_strip_quotes_any_depth(spark, depth):
    text = '"' * depth + "x" + '"' * depth
    assert values(spark, [text, "„y“", "'", '""'], G.strip_quotes(V)) == ["x", "y", "'", ""]


def test_split_reasoning(spark):
    got = values(spark, ["<think> a </think>x<THINK>\nb</think>", "plain"], G.split_reasoning(V))
    assert [(r["content"], r["reasoning"]) for r in got] == [("x", "a\n\nb"), ("plain", None)]


def test_score_policies(spark):
    records = [
        '{"parsed":{"faithfulness_score":4}}', '{"parsed":{"faithfulness_score":4.0}}',
        '{"parsed":{"faithfulness_score":"4"}}', '{"parsed":{"faithfulness_score":4.5}}',
        '{"parsed":{"score":"score 3 of 9"}}', '{"parsed":null,"score":7}', "not json",
    ]
    record = F.try_parse_json(V)
    parsed = J.field(record, "$.parsed")
    key = "faithfulness_score"
    assert values(spark, records, J.score_in_range(parsed, key)) == [4, 4, None, None, None, None, None]
    assert values(spark, records, J.score_below_max(parsed, key)) == [4, 4, None, 4, None, None, None]
    assert values(spark, records, J.score_cascade(record)) == [4, 4, 4, None, 3, 7, None]


def test_report_categories(spark):
    cases = [(["- Negation: x", "reverse y", "reversed"], 3), ([], 2), ([], 5)]
    df = spark.createDataFrame(cases, "c array<string>, s int")
    got = [r[0] for r in df.select(C.report_categories(F.col("c"), F.col("s"))).collect()]
    assert got == [["contradiction", "reverse_relation"], ["not_given"], []]


def test_classify_issue(spark):
    cases = {
        "I cannot say": "refusal", "the direction is off": "reverse_relation", "omits it": "missing_information",
        "it adds x": "unsupported_or_hallucinated", "a conflict": "contradiction", "wrong person": "wrong_entity",
        "bad predicate": "wrong_relation", "the year": "wrong_number_date_unit", "poor grammar": "language_or_style",
        "vague": "ambiguous_or_unclear", "hallucinated": "", "nedá sa": "refusal", "": "",
    }
    assert values(spark, cases, C.classify_issue(F.lit(""), V)) == list(cases.values())


def test_comment_parts(spark):
    comments = ["Wrong_Object, x: detail", "", "omission: a: b", ": odd"]
    labels = values(spark, comments, C.comment_label(V))
    assert labels == ["wrong_object", "", "omission", ""]
    assert values(spark, ["omission: a: b"], C.comment_detail(V, F.lit("omission"))) == ["a: b"]


def test_leaked_predicates(spark):
    sentence = "A hasPart B and isPartOf; x_hasChild type"
    predicates = F.array(*[F.lit(p) for p in ("hasPart", "type", "hasChild", "isPartOf", "hasPart")])
    assert values(spark, [sentence], T.leaked_predicates(V, predicates)) == [["hasPart", "isPartOf"]]


def test_normalize_member(spark):
    cases = {"Ján_Novák": "JanNovak", "é": "e", "Łódź": "Łodz", "plain_A": "plainA"}
    assert values(spark, cases, T.normalize_member(V)) == list(cases.values())


def test_assets(spark):
    dates = ["01-02-2001", "1-2-2001", "31-02-2001", "2001-01-01", "1-2-20011"]
    assert values(spark, dates, T.valid_date(V)) == [True, True, False, False, False]
    numbers = ["12", "-3", "1_000", "1.5", "x", "_1"]
    assert values(spark, numbers, T.valid_number(V)) == [True, True, True, False, False, False]


def test_keys(spark):
    stems = {"a_b_fa_en": ("a_b", "fa", "en"), "x_cf": ("x", "cf", "unknown"), "solo": ("solo", "unknown", "unknown")}
    got = values(spark, stems, K.parse_source_stem(V))
    assert [(r["dataset"], r["variant"], r["language"]) for r in got] == list(stems.values())
    names = {"llama4-scout-openrouter": "llama4-scout", "qwen3.5-122b": "qwen3_5-122b", "a.b.c": "a_b.c"}
    assert values(spark, names, K.classified_model(V)) == list(names.values())
    assert values(spark, ["a_b.c"], K.model_candidates(V)) == [["a_b.c", "a.b.c", "a_b_c"]]
    urls = {None: "https://d/v1/chat/completions", " https://x/v1// ": "https://x/v1/chat/completions",
            "https://x/chat/completions": "https://x/chat/completions"}
    assert values(spark, urls, K.endpoint(V, "https://d/v1/chat/completions")) == list(urls.values())
    assert values(spark, [0, 1, 3, 4, 9, 10], K.triple_bucket(V), "int") == [None, "1", "2--3", "4--9", "4--9", None]
    assert values(spark, ["Ab ", "a b/č!", "__", None], K.sanitize_identifier(V)) == ["Ab", "a_b_č", "source", "source"]


def test_row_triples_fall_back_to_text(spark):
    text = F.lit("- s_1 | p | o\nbroken\n- s_1 | q | o 2")
    terms = T.lexical_terms(T.row_triples(F.lit("not json"), text))
    assert values(spark, ["x"], terms) == [["s 1", "o", "o 2"]]
