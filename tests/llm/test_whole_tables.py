"""Operators against plain Python on the whole small table."""

import hashlib
import math
import re
from collections import Counter

import pytest

from textjudge.llm import compression, rules, secret_scan

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(-1, None), (-2, ""), (-3, " \t\n "), (-4, "a\n\t\na\na b\n a\n"), (-5, "Ünï 漢字 😀 #5 é! " * 30), (None, "x y z " * 40)]
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return found.union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(4).cache()


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def plain_statistics(text):
    text = text or ""
    words, lines = words_of(text), [x for x in text.split("\n") if x.strip(" ")]
    chars, count, n_lines = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda marks: sum(c in marks for c in text) / chars
    spaces = sum(c in " \t\n\x0b\x0c\r" for c in text)
    return {
        "log_words": math.log1p(len(words)), "word_length": (len(text) - spaces) / count, "longest_word": math.log1p(max(map(len, words), default=0)),
        "kinds_share": len(set(words)) / count, "kinds_root": len(set(words)) / math.sqrt(count), "line_kinds_share": len(set(lines)) / n_lines,
        "line_words": math.log1p(len(words) / n_lines), "symbol_share": share("#*$%&|<>"), "bar_share": share("|"), "upper_share": share(rules.UPPER),
        "digit_share": share("0123456789"), "mark_share": share("!?"), "stop_share": share(".,;:"), "space_share": spaces / chars,
    }


def test_rule_scores_equal_plain_rules(spark, docs):
    texts = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "coalesce(text, '') AS whole")
    found = rules.statistics(texts).cache()
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = plain_statistics(r.whole)
        assert sorted(want) == sorted(rules.FEATURES)
        assert all(math.isclose(r[f], want[f], rel_tol=1e-12, abs_tol=1e-12) for f in rules.FEATURES), r.doc_id
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").selectExpr("doc_id", "int(quality) AS label").where("label in (0, 1)")
    model = rules.fit_rules(found.join(labels, "doc_id").where(rules.training_row(found.doc_id)))
    assert model.rules and all(weight for _, weight in model.rules)
    for r in found.select("whole", *rules.FEATURES, model.score().alias("score")).collect():
        # the bounds are held against the numbers Spark found, so that no last digit decides
        total = model.intercept + sum(weight for rule, weight in model.rules if rule.holds({f: r[f] for f in rules.FEATURES}))
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def plain_rules(text):
    words, text = words_of(text), text or ""
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_base_rules_equal_plain_counts(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = compression.compression_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == plain_rules(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def plain_spans(text):
    found = []
    for place, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_secrets_equal_plain_patterns(spark, docs):
    planted = [
        (-10, 'PassWord" : "abcdefgh" token=short tokenapikey=12345678 SECRET==========x'), (-11, "AKIA" + "B" * 12 + " AKIA" + "C" * 11 + " xAKIA" + "D" * 30),
        (-12, "漢😀 " + "0123456789abcdef" * 2 + " " + "f" * 31 + "G api_key='" + "a" * 40 + "'"), (-13, "ſecret=abcdefgh toKen=abcdefgh toKen:abcdefghi"),
    ]
    both = docs.union(spark.createDataFrame(planted, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in both.collect()}
    got = secret_scan.scan_secrets(both).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        kinds = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"]), r.doc_id
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), r.doc_id
        assert set(listed) <= set(r.spans.split(","))
