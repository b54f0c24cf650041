"""Operator invariants, skewed inputs and brute-force checks on small fixtures."""

import json
import math
import random
from collections import Counter, defaultdict
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from textjudge.operators import agreement as A
from textjudge.operators import joins as O
from textjudge.operators import merge as M
from textjudge.operators import resample as R
from textjudge.operators import sampling as P
from textjudge.operators import scores as S
from textjudge.operators import substitute as U
from textjudge.operators import votes as V
from textjudge.operators.index import chunked_index, hash_bucket
from textjudge.sources import assets
from textjudge.sources.xml import write_benchmark_xml

KEYS = "model string, dataset string, variant string, language string, eid string"


def test_score_stats_by_hand(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("b", None), ("c", 7)], "eid string, score int")
    r = S.score_stats(df).first()
    assert (r["records"], r["valid_scored_records"], r["unique_eids"]) == (5, 3, 3)
    assert r["median_score"] == 2.0 and r["min_score"] == 1 and r["max_score"] == 5
    assert math.isclose(r["stddev_score"], 1.699673171197595)
    empty = S.score_stats(df.filter("eid = 'c'")).first()
    assert empty["mean_score"] is None and empty["score_1_pct"] == 0.0


def test_latest_with_a_hot_key(spark):
    """One key holds most rows; the rank filter runs before the shuffle."""
    df = spark.range(3000).selectExpr(
        "'m' AS model", "'d' AS dataset", "'v' AS variant", "'l' AS language",
        "IF(id % 3 < 2, 'hot', concat('e', id)) AS eid", "id AS ts", "id AS event_id",
    )
    out = S.latest(df)
    assert out.count() == 1001
    assert out.filter("eid = 'hot'").first()["ts"] == 2998
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.count("WindowGroupLimit") == 2


def test_votes_long_and_wide_agree_and_shares_sum_to_one(spark):
    rng = random.Random(3)
    words = ["FA", "CFA", "FI", "x", "", "FA or FI"]
    rows = [("m", "cs-qa", "fa", "en", f"e{i}", r, rng.choice(words)) for i in range(80) for r in range(1, 6)]
    long = spark.createDataFrame(rows, KEYS + ", repeat_idx int, answer string")
    wide = V.pivot_repeats(long)
    a = {r["eid"]: r for r in V.vote_long(long).collect()}
    for r in V.vote_wide(wide).collect():
        b = a[r["eid"]]
        assert all(r[c] == b[c] for c in r.asDict())
        total = sum(r[f"vote_share_{x}"] for x in ("CFA", "FA", "FI"))
        assert math.isclose(total, 1.0) or total == 0.0
    for key, r in a.items():
        said = [x[6] for x in rows if x[4] == key and x[6] in ("FA", "CFA", "FI")]
        expected = Counter(said).most_common(1)[0][0] if said else ""
        assert r["vote_first_seen"] == expected
    shown = V.label_distribution(V.vote_long(long)).agg(F.sum("pct")).first()[0]
    assert shown == 100


def test_join_rejects_duplicate_keys(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([("a", 3)], "k string, y int")
    with pytest.raises(Exception, match="not unique"):
        O.join_one_to_one(left, right, ["k"]).collect()


def records(spark, rows):
    df = spark.createDataFrame(
        [(e, s, "j", "j", None, t, n) for e, s, t, n in rows],
        "eid string, source_id string, requested_judge_model string, judge_model string, "
        "requested_judge_api_url string, sentence string, n int",
    )
    return M.with_record_key(df, "https://d/v1/chat/completions")


def test_upsert_modes_are_idempotent(spark):
    old = records(spark, [("1", "s", "x", 0), ("2", "s", " ", 1), ("3", "s", "z", 2)])
    new = records(spark, [("1", "s", "new", 3), ("2", "s", "new", 4), ("4", "s", "new", 5)])
    wanted = {"append": [0, 1, 2, 4, 5], "replace_empty": [0, 2, 4, 5], "overwrite": [2, 3, 4, 5]}
    for mode, ids in wanted.items():
        once = M.upsert(old, new, mode, [F.desc("n")])
        twice = M.upsert(once, new, mode, [F.desc("n")])
        assert sorted(r["n"] for r in once.collect()) == ids
        assert sorted(r["n"] for r in twice.collect()) == [i for i in ids if mode != "append" or i in ids]


def test_resume_merge_keeps_old_cells(spark):
    old = spark.createDataFrame([("1", "a", "b"), ("2", "c", None)], "eid string, x string, y string")
    new = spark.createDataFrame([("1", " ", "q", "z"), ("3", "", "s", "t")], "eid string, x string, y string, w string")
    got = {r["eid"]: tuple(r)[1:] for r in M.resume_merge(old, new).collect()}
    assert got == {"1": ("a", "q", "z"), "2": ("c", None, None), "3": ("", "s", "t")}


def test_pending_prefix_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, todo boolean").repartition(7)
    for limit in (1, 10, 79, 500, 0):
        wanted, pending = [], 0
        for i, todo in rows:
            wanted.append(i)
            pending += todo
            if limit and todo and pending >= limit:
                break
        got = M.pending_prefix(df, F.col("todo"), limit, ["i"]).collect()
        assert sorted(r["i"] for r in got) == wanted


def test_chunked_index_is_dense_per_group(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "concat('k', id) AS k")
    out = chunked_index(df, ["g"], ["k"], hash_bucket("k"), "idx", total="n").collect()
    seen = defaultdict(list)
    for r in out:
        seen[r["g"]].append(r["idx"])
        assert r["n"] >= 1
    assert sum(map(len, seen.values())) == 5000
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())


def test_agreement_against_crosstab(spark):
    rng = random.Random(1)
    rows = [(i, "A", float(rng.randint(1, 5)), rng.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "uid int, annotator string, human double, judge int")
    got = A.metrics(df).filter("annotator = 'ALL'").first()
    h, j = [r[2] for r in rows], [r[3] for r in rows]
    n = len(rows)
    observed = sum((a - b) ** 2 for a, b in zip(h, j))
    expected = sum((a - b) ** 2 for a in h for b in j) / n
    assert math.isclose(got["quadratic_weighted_kappa"], 1 - observed / expected, rel_tol=1e-12)

    def ranks(x):
        return [sum(v < y for v in x) + (sum(v == y for v in x) + 1) / 2 for y in x]

    rh, rj = ranks(h), ranks(j)
    mh, mj = sum(rh) / n, sum(rj) / n
    cov = sum((a - mh) * (b - mj) for a, b in zip(rh, rj))
    rho = cov / math.sqrt(sum((a - mh) ** 2 for a in rh) * sum((b - mj) ** 2 for b in rj))
    assert math.isclose(got["spearman_correlation"], rho, rel_tol=1e-9)
    assert A.human_score is not None


def boot_rows(spark, clusters):
    return spark.range(clusters * 4).selectExpr(
        "'m' AS model", "'d' AS dataset", "'v' AS variant", f"concat('e', id % {clusters}) AS eid",
        "CAST(1 + (id * 7 + id DIV 13) % 5 AS INT) AS score",
    )


def test_bootstrap_interval_is_plausible(spark):
    rows = boot_rows(spark, 150)
    r = R.model_intervals(rows, samples=300).first()
    assert r["source_item_clusters"] == 150 and r["judged_rows"] == 600
    assert r["ci_95_low"] < r["mean_score"] < r["ci_95_high"]
    sums = defaultdict(list)
    for x in rows.collect():
        sums[x["eid"]].append(x["score"])
    means = [sum(v) / len(v) for v in sums.values()]
    mean = sum(means) / len(means)
    error = math.sqrt(sum((m - mean) ** 2 for m in means)) / len(means)
    assert math.isclose(r["ci_95_high"] - r["ci_95_low"], 2 * 1.96 * error, rel_tol=0.2)


def single_clusters(spark, clusters):
    rows = boot_rows(spark, clusters).select("model", "dataset", "variant", "eid", F.lit(1).alias("num"), F.lit(1).alias("den"))
    return rows.dropDuplicates()


@pytest.mark.parametrize("bucket", [R.BUCKET, 30])
def test_replicates_have_exactly_n_draws(spark, bucket):
    one = single_clusters(spark, 400)
    reps = R.replicate_sums(one, ["model"], ["num", "den"], 50, 9, bucket=bucket).collect()
    assert [(r["num"], r["den"]) for r in reps] == [(400, 400)] * 50
    # rows of a cluster share its weight, whatever the partitioning
    cells = one.withColumn("part", F.concat(F.lit("c"), F.abs(F.xxhash64("eid")) % 3))
    again = [R.replicate_sums(x, ["model"], ["den"], 50, 9, cell="part", bucket=bucket).collect() for x in (cells, cells.union(cells).repartition(7))]
    assert {(r["rep"], r["cell"], 2 * r["den"]) for r in again[0]} == {(r["rep"], r["cell"], r["den"]) for r in again[1]}
    assert len({r["den"] for r in again[0] if r["cell"] == "c1"}) > 10


def test_weights_are_multinomial():
    """Mean and variance one, replicates uncorrelated, with and without a tree above the bucket."""
    sizes = np.array([40, 10, 0, 30, 25, 25, 60, 10])
    samples = 4000
    draws = np.array([R.draws_of(b, sizes, 77, samples) for b in range(len(sizes))])
    assert (draws.sum(0) == 200).all() and (draws[2] == 0).all()
    whole = [np.concatenate([w for _, w in R.weights(1000 + b, draws[b], n)]) for b, n in enumerate(sizes) if n]
    for w in (np.concatenate(whole, axis=1), np.concatenate([x for _, x in R.weights(5, np.full(samples, 200), 200)])):
        assert w.shape == (samples, 200) and (w.sum(1) == 200).all()
        assert abs(w.mean(0) - 1).max() < 0.1 and abs(w.var(0) - 0.995).max() < 0.16
        # the covariance of two clusters is -1/n, of two replicates 0
        assert abs(np.cov(w.T)[~np.eye(200, dtype=bool)].mean() + 1 / 200) < 2e-4
        between = np.corrcoef(w[:300])[~np.eye(300, dtype=bool)]
        assert abs(between.mean()) < 0.005 and between.max() < 0.45


def test_products_are_exact():
    w, big = np.array([[3, 1], [0, 4]]), np.array([[2**55 + 1], [5]])
    assert R.product(w, big).tolist() == [[3 * (2**55 + 1) + 5], [20]]
    assert R.product(w, big % 1000).tolist() == (w @ (big % 1000)).tolist()


@pytest.mark.parametrize("listed", [1024, 3])
def test_intervals_equal_sorted_interpolation(spark, listed):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0], [2500, 7]), "c": np.array([5.5]), "d": rng.integers(0, 5, 900) / 3, None: 10.0 ** rng.integers(-9, 9, 2000)}
    rows = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x] + [("a", None)], "g string, v double")
    names = {"low": 0.025, "tail": 0.05 / 12, "high": 0.975}
    got = {r["g"]: r for r in R.intervals(rows, ["g"], "v", names, listed=listed).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        for name, q in names.items():
            assert math.isclose(got[g][name], float(np.quantile(x, q)), rel_tol=1e-12)


def test_bootstrap_plan_draws_nothing_per_row(spark):
    """Draws are made inside the buckets: no mixing step is left in the plan."""
    plan = R.model_intervals(boot_rows(spark, 20), samples=20)._jdf.queryExecution().toString()
    assert plan.count(str(R.MULTIPLIER)) <= 3


def test_counterfactual_never_keeps_the_member(spark):
    rows = [(f"Id{i}", 1, f"S_{i}", "p", "hot_value" if i % 3 == 0 else f"v_{i % 9}", "t") for i in range(300)]
    df = spark.createDataFrame(
        rows, "eid string, pos int, subject string, predicate string, object string, object_type string")
    old = {(r[0], r[1]): r[4] for r in rows}
    out = U.counterfactual(df).collect()
    assert len(out) == 300
    assert all(r["object"] != old[(r["eid"], r["pos"])] for r in out)
    picked = Counter(r["object"] for r in out)
    assert picked["hot_value"] > max(v for k, v in picked.items() if k != "hot_value")
    assert U.counterfactual(df.filter("object = 'hot_value'")).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [50_000, 40, 7])
def test_pool_numbers_are_dense_and_forms_contiguous(spark, rows_per_bucket):
    rng = random.Random(2)
    rows = [(t, "hot" if i % 3 == 0 else f"n{rng.randint(0, 60)}", f"v{i}", f"e{i:04}") for i in range(900) for t in ("a", "b")[: 1 + (i % 10 == 0)]]
    pool = spark.createDataFrame(rows, "type string, norm string, value string, eid string")
    numbered, sizes = U.number_pool(pool, ["eid"], rows_per_bucket)
    got = numbered.collect()
    assert {r["type"]: r["pool_size"] for r in sizes.collect()} == Counter(r[0] for r in rows)
    assert sorted((r["type"], r["norm"], r["value"], r["eid"]) for r in got) == sorted(rows)
    for t in ("a", "b"):
        own = [r for r in got if r["type"] == t]
        assert sorted(r["idx"] for r in own) == list(range(len(own))) and {r["pool_size"] for r in own} == {len(own)}
        for norm in {r["norm"] for r in own}:
            form = [r for r in own if r["norm"] == norm]
            start = min(r["idx"] for r in form)
            assert sorted(r["idx"] for r in form) == list(range(start, start + len(form)))
            assert {(r["own_start"], r["own_size"]) for r in form} == {(start, len(form))}


def test_stratified_sample_is_balanced(spark):
    rng = random.Random(2)
    rows = [(f"u{i}", "fa", "small", "en", rng.choice(["1", "2-4", "5"]), rng.choice("abc"),
             rng.choice(["cs-qa", "sk-qa"]), rng.randint(1, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "uid string, variant string, size_bucket string, language string, "
                               "stratum string, model string, dataset string, fluency int")
    for sample in (P.stratified(df), P.round_robin(df)):
        got = sample.collect()
        assert len(got) == 15 == len({r["uid"] for r in got})
        assert set(Counter(r["stratum"] for r in got).values()) == {5}
    models = Counter(r["model"] for r in P.stratified(df).collect())
    assert set(models.values()) == {5}


def test_spend_total_ignores_unreadable_costs(spark):
    df = spark.createDataFrame([("0.1",), ("0.2",), ("x",), (None,)], "request_cost string")
    assert math.isclose(M.spend_total(df).first()["spend"], 0.3)


def test_real_layout_trees(spark, tmp_path):
    from textjudge.sources import judged as J
    from textjudge.sources import tables as T

    folder = tmp_path / "classified" / "qwen3_5-122b"
    folder.mkdir(parents=True)
    (folder / "cs-qa_fa_en.csv").write_text(
        "﻿eid,category,sentence,sentence_1,sentence_2\nId1,c,FA,FA,\"two\nlines\"\nId2,c,FI,FI,\n", encoding="utf-8")
    (folder / "cs-qa_cf_en.csv").write_text("eid,size,sentence\nId1,3,CFA\n", encoding="utf-8")
    got = sorted((r["model"], r["variant"], r["eid"], r["repeat_idx"], r["answer"])
                 for r in T.read_classified(spark, str(tmp_path / "classified")).collect())
    m = "qwen3.5-122b"
    assert got == [(m, "cf", "Id1", 1, "CFA"), (m, "fa", "Id1", 1, "FA"), (m, "fa", "Id1", 2, "two\nlines"),
                   (m, "fa", "Id2", 1, "FI"), (m, "fa", "Id2", 2, "")]

    judged = tmp_path / "judged" / "gemma"
    judged.mkdir(parents=True)
    line = {"eid": "Id1", "source_label": None, "timestamp": "1", "parsed": {"faithfulness_score": 4}}
    (judged / "judge_sk-qa_fi_hsb_x.jsonl").write_text(json.dumps(line) + "\n\n{broken\n", encoding="utf-8")
    (judged / "judge_sk-qa_fi_hsb_x.failures.jsonl").write_text('{"error_type":"E"}\n', encoding="utf-8")
    rows = J.read_judged(spark, str(tmp_path / "judged"))
    good = rows.filter("score IS NOT NULL").collect()
    assert [(r["model"], r["dataset"], r["variant"], r["language"], r["eid"], r["score"]) for r in good] == [
        ("gemma", "sk-qa", "fi", "hsb", "Id1", 4)]
    lost = spark.createDataFrame([("x.csv", "header without eid")], "path string, problem string")
    bad = sorted((r["problem"], r["line_no"]) for r in J.bad_lines(rows, lost).collect())
    assert bad == [("header without eid", None), ("malformed JSON", 3)]
    assert J.failures_by_type(J.read_failures(spark, str(tmp_path / "judged"))).first()["n"] == 1


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    from textjudge.sources import files

    rng = random.Random(8)
    texts = {f"f{k}.txt": [f"{k}.{i} " + "x" * rng.randint(0, 40) if i % 7 else "" for i in range(n)] for k, n in enumerate((300, 0, 1, 700, 5))}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if lines else ""), encoding="utf-8")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c, v in zip(before, ("700", "1")):
            spark.conf.set(c, v)
        got = files.numbered_lines(spark, str(tmp_path))
        assert got.select("path", F.input_file_name()).rdd.getNumPartitions() > 20
        rows = sorted((r["place"], r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in got.collect())
        want = [(name, i, line) for name in sorted(texts) for i, line in enumerate(texts[name], 1)]
        assert rows == [(place, *x) for place, x in enumerate(want)]
        for n in (0, 1, 299, 302, 2000):
            first = sorted((r["place"], r["line"]) for r in files.first_lines(spark, str(tmp_path), n).collect())
            assert first == [(place, x[2]) for place, x in enumerate(want[:n])]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_first_rows_open_no_later_file(spark, tmp_path):
    from textjudge.sources import files
    from textjudge.sources import tables as T

    for k in range(8):
        (tmp_path / f"f{k}.csv").write_text("eid,sentence\n" + "".join(f"{k}-{i},\"two\nlines\"\n" for i in range(3)), encoding="utf-8")
    opened = []

    def read(paths):
        opened.append(len(paths))
        return files.split_lines(spark, paths)

    assert files.first_rows(spark, str(tmp_path), 10, read).count() == 10
    # seven lines a file: the first one, then two more; the rest is never read
    assert opened == [1, 2, 3]
    rows = sorted((r["place"], r["eid"], r["sentence"]) for r in T.first_sentences(spark, str(tmp_path), 4).collect())
    assert rows == [(0, "0-0", "two\nlines"), (1, "0-1", "two\nlines"), (2, "0-2", "two\nlines"), (3, "1-0", "two\nlines")]


def test_one_pruned_scan_per_header(spark, tmp_path):
    from textjudge.sources import tables as T

    for k, header in enumerate(["eid,size,sentence", "sentence,eid,size", "eid,size,sentence"]):
        folder = tmp_path / f"m{k}"
        folder.mkdir()
        cells = {"eid": f"Id{k}", "size": "4", "sentence": "text"}
        (folder / "cs-qa_fa_en.csv").write_text(header + "\n" + ",".join(cells[c] for c in header.split(",")) + "\n", encoding="utf-8")
    got = T.read_generated(spark, str(tmp_path))
    assert sorted((r["model"], r["eid"], r["triple_count"]) for r in got.collect()) == [(f"m{k}", f"Id{k}", 4) for k in range(3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "FileScan csv" in x]
    assert len(scan) == 2 and "Join" not in plan and all(x.split("ReadSchema: struct<")[1].count(":") == 2 for x in scan)


def study_tree(root):
    """A tiny study in the on-disk layout: judged, fluency, classified, generated, triples."""
    rng = random.Random(4)
    models = ["qwen3_5-122b", "gemma4-31B", "qwen3-1_7b"]
    for model in models:
        for variant in ("fa", "cf", "fi"):
            stem = f"cs-qa_{variant}_en"
            for kind, key in (("judged", "faithfulness_score"), ("fluency", "fluency_score")):
                folder = root / kind / model
                folder.mkdir(parents=True, exist_ok=True)
                lines = []
                for i in range(12):
                    score = rng.randint(1, 5)
                    parsed = {key: score, "incorrect_information": [{"comment": "omission: x"}] if score < 5 else []}
                    lines.append(json.dumps({
                        "eid": f"Id{i}", "source_label": stem, "source_id": f"{model}__{stem}",
                        "timestamp": "1", "judge_model": "j", "sentence": "A hasPart B.", "parsed": parsed}))
                (folder / f"judge_{stem}_j.jsonl").write_text("\n".join(lines) + "\n{bad\n", encoding="utf-8")
            for kind, head in (("classified", "eid,size,sentence,sentence_1,sentence_2,sentence_3,sentence_4,sentence_5"),
                               ("generated", "eid,size,sentence")):
                folder = root / kind / model
                folder.mkdir(parents=True, exist_ok=True)
                rows = [head]
                for i in range(12):
                    labels = [rng.choice(["FA", "CFA", "FI"]) for _ in range(5)]
                    labels[4] = f"**{labels[4]}**" if i == 0 else labels[4]
                    rows.append(f"Id{i},{1 + i % 4}," + ",".join([labels[0], *labels] if kind == "classified" else ["text"]))
                (folder / f"{stem}.csv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    folder = root / "triples" / "cs-qa"
    folder.mkdir(parents=True)
    for variant in ("fa", "cf", "fi"):
        rows = ["eid,category,shape,shape_type,size,kind,subject,predicate,object"]
        rows += [f"Id{i},c,NA,NA,1,original,s,hasPart,o" for i in range(12)]
        (folder / f"{variant}.csv").write_text("\n".join(rows) + "\n", encoding="utf-8")


def test_study_from_disk_to_reports(spark, tmp_path):
    from textjudge.plans.report import build_report, results_tables

    study_tree(tmp_path)
    at = lambda name: str(tmp_path / name)
    build_report(spark, at("judged"), at("out"), at("triples"), at("classified"), at("generated"), sample_size=3)
    overall = spark.read.option("header", "true").csv(at("out/score_stats_overall")).first()
    assert int(overall["records"]) == 108 and int(overall["valid_scored_records"]) == 108
    leaks = spark.read.option("header", "true").csv(at("out/predicate_leakage_predicates")).first()
    assert (leaks["predicate"], int(leaks["mentions"])) == ("hasPart", 108)
    table = lambda name: spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(at(f"out/{name}"))
    assert table("warnings").where("line_no IS NOT NULL").count() == 9
    cases = [r.asDict() for r in table("score_cases").collect()]
    assert len(cases) == 108
    place = lambda r: (r["generator_model"], r["dataset"], r["eid"], r["variant"], r["language"], r["path"], int(r["line_no"]))
    for name, scope in (("overall", ()), ("model", ("generator_model",)), ("variant", ("generator_model", "dataset", "variant"))):
        groups = defaultdict(list)
        for r in cases:
            groups[(*(r[c] for c in scope), r["score"])].append(place(r))
        assert sorted(map(place, table(f"score_samples_{name}").collect())) == sorted(p for g in groups.values() for p in sorted(g)[:3])
    issues = Counter(r["issue"] for r in table("issue_examples").collect())
    assert issues == Counter({r["category"]: int(r["n"]) for r in table("issue_counts").select(*[F.col(a).alias(b) for a, b in zip(table("issue_counts").columns[:2], ("category", "n"))]).collect()})
    assert Counter(r["issue"] for r in table("issue_samples").collect()) == Counter({k: min(3, n) for k, n in issues.items()})
    assert sum(int(r["leak_count"]) for r in table("predicate_leakage_examples").collect()) == 108
    assert table("predicate_leakage_samples").count() == 3
    covered = table("coverage").collect()
    assert len(covered) == 9 and all(int(r["expected_rows"]) >= int(r["judged_rows"]) > 0 for r in covered)
    odd = table("classification_format_examples").collect()
    assert {r["eid"] for r in odd} == {"Id0"} and all(int(r["non_exact"]) == 1 for r in odd)
    assert table("classification_format_samples").count() == 9
    tables = results_tables(spark, at("judged"), at("fluency"), at("classified"), at("generated"), samples=20)
    sizes = {name: df.count() for name, df in tables.items()}
    assert sizes["model_summary"] == 3 and sizes["confusion_matrix"] == 27
    assert sizes["predicted_class_contrasts"] == 6 and sizes["model_intervals"] == 6
    assert sizes["issues_by_model"] == 24


def test_a_key_with_many_copies_fails_small(spark):
    many = spark.range(400_000).selectExpr("IF(id % 2 = 0, 'hot', cast(id AS string)) AS k", "id AS v", "repeat('x', 50) AS t")
    checked = O.assert_unique(many, ["k"])
    with pytest.raises(Exception, match="is not unique"):
        checked.count()
    # copies meet inside the tasks: no window, and counts are partial before the exchange
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan
    good = spark.createDataFrame([("a", 1, None), (None, 2, "x")], "k string, v int, t string")
    assert sorted(map(tuple, O.assert_unique(good, ["k"]).collect()), key=str) == sorted([("a", 1, None), (None, 2, "x")], key=str)
    assert O.assert_unique(good.select("k"), ["k"]).count() == 2


def test_stored_upsert_survives_a_killed_write(spark, tmp_path):
    path = str(tmp_path / "table")
    columns = "eid string, source_id string, judge string, at string, n int, sentence string"
    old = spark.createDataFrame([("e1", "s1", "j", "u", 1, "one"), ("e2", "s1", "j", "u", 2, ""), ("e1", "s2", "j", "u", 3, "three")], columns)
    old.write.partitionBy("source_id").parquet(path)
    batch = spark.createDataFrame([("e2", "s1", "j", "u", 5, "five"), ("e9", "s3", "j", "u", 6, "six"), ("e1", "s1", "j", "u", 7, "seven")], columns)
    rows = lambda: sorted((r["eid"], r["source_id"], r["n"]) for r in spark.read.parquet(path).collect())
    before = rows()
    untouched = {p.name for p in (tmp_path / "table" / "source_id=s2").iterdir()}
    dies = batch.withColumn("sentence", F.when(F.col("eid") == "e9", F.raise_error(F.lit("killed"))).otherwise(F.col("sentence")))
    with pytest.raises(Exception, match="killed"):
        M.upsert_stored(dies, path, "replace_empty", [F.desc("n")], ["source_id"])
    assert rows() == before
    M.upsert_stored(batch, path, "replace_empty", [F.desc("n")], ["source_id"])
    assert rows() == [("e1", "s1", 1), ("e1", "s2", 3), ("e2", "s1", 5), ("e9", "s3", 6)]
    assert {p.name for p in (tmp_path / "table" / "source_id=s2").iterdir()} == untouched and (tmp_path / "table" / "_SUCCESS").exists()
    M.upsert_stored(batch, path, "replace_empty", [F.desc("n")], ["source_id"])
    assert rows() == [("e1", "s1", 1), ("e1", "s2", 3), ("e2", "s1", 5), ("e9", "s3", 6)]
    with pytest.raises(ValueError):
        M.upsert_stored(batch, path, "append", [F.desc("n")], ["n"])


def test_label_counts_keep_an_exact_rest(spark):
    rows = [("s", f"l{i % 30}") for i in range(1000)] + [("t", "only")] * 3 + [("t", None)]
    got = M.label_counts(spark.createDataFrame(rows, "source_id string, label string"), most=4).collect()
    assert sum(r["n"] for r in got if r["source_id"] == "s") == 1000 and sum(r["rest"] for r in got) == 1
    assert sorted((r["label"], r["n"]) for r in got if r["source_id"] == "s" and not r["rest"]) == [(f"l{i}", 34) for i in range(4)]
    assert {(r["label"], r["n"]) for r in got if r["source_id"] == "t"} == {("only", 3), (None, 1)}


def test_prompts_are_no_cross_join(spark):
    from textjudge.operators import construct as N

    entries = spark.createDataFrame([("e", "c", 1, [("s", "p", "o")])], "eid string, category string, size int, triples array<struct<subject:string,predicate:string,object:string>>")
    got = N.entry_prompts(entries, [("en", "{size}"), ("cs", "{category}")])
    assert {(r["language"], r["prompt"]) for r in got.collect()} == {("en", "1"), ("cs", "c")}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_checks_ride_on_the_job_that_needs_the_rows(spark, tmp_path):
    from textjudge.operators import quality as Q

    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 9)], "k string, score int")
    rules = {"null key": F.col("k").isNotNull(), "score out of range": F.col("score").between(1, 5), "negative": F.col("score") >= 0}
    watched, seen = Q.watched(df, rules)
    watched.write.parquet(str(tmp_path / "rows"))
    got = {r["check"]: r["n"] for r in Q.observed(spark, seen).collect()}
    assert got == {"null key": 1, "score out of range": 1}
    watched, seen = Q.watched(df.limit(0), rules)
    watched.write.parquet(str(tmp_path / "none"))
    assert [tuple(r) for r in Q.observed(spark, seen).collect()] == [("no rows", "empty table", 0)]


def test_csv_trees_with_other_headers(spark, tmp_path):
    from textjudge.sources import tables as T

    folder = tmp_path / "out" / "gemma"
    folder.mkdir(parents=True)
    write = lambda name, text: (folder / name).write_text(text, encoding="utf-8")
    write("cs-qa_fa_en.csv", "\ufeffcategory,eid,size,sentence\nc,Id1,2,\"a, \"\"b\"\"\nc\"\n")
    write("cs-qa_cf_en.csv", 'size,"sen\ntence",eid,sentence,eid\n3,x,eid,FA,other\n')
    write("cs-qa_fi_en.csv", "name,sentence\nId9,lost\n")
    write("notes.csv", "eid,sentence\nId8,lost\n")
    root = str(tmp_path / "out")
    rows = {r["variant"]: r for r in T.read_sentences(spark, root).collect()}
    assert set(rows) == {"fa", "cf"}
    assert (rows["fa"]["eid"], rows["fa"]["category"], rows["fa"]["size"], rows["fa"]["sentence"]) == ("Id1", "c", 2, 'a, "b"\nc')
    # a row may hold the text of a header; of two columns with one name the first counts
    assert (rows["cf"]["eid"], rows["cf"]["size"], rows["cf"]["sentence"]) == ("eid", 3, "FA")
    bad = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in T.bad_files(spark, root).collect()}
    assert bad == {"cs-qa_fi_en.csv": "header without eid", "notes.csv": "file name is no combination"}


def test_more_repeats_than_columns_is_an_error(spark):
    from textjudge.operators import votes as V

    df = spark.createDataFrame([("k", 1, "FA"), ("k", 6, "FI")], "key string, repeat_idx int, answer string")
    with pytest.raises(Exception, match="repeat outside 1..5: 6"):
        V.pivot_repeats(df, ["key"]).collect()
    assert V.pivot_repeats(df, ["key"], repeats=6).first()["sentence_6"] == "FI"


def test_vote_shares_of_many_answers(spark):
    from textjudge.operators import votes as V

    rows = [("k", i, "FA" if i <= 4 else "FI") for i in range(1, 8)]
    df = spark.createDataFrame(rows, "key string, repeat_idx int, answer string")
    got = V.vote_long(df, ["key"]).first()
    assert got["units_FA"] + got["units_FI"] == V.VOTE_UNIT
    assert got["units_FA"] * 7 == 4 * V.VOTE_UNIT


def test_a_cluster_needs_its_shared_folder():
    from types import SimpleNamespace

    from textjudge.operators.lineage import shared_folder

    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))


ASSETS = {
    "people \\ \"quoted\"": ["Ann \"A\" Lee", "back\\slash\\", "", "\u00e9\u6f22\U0001f600", "a: [b], {c}", "tab\tline\n", "\\\""],
    "none": [], "null list": None, "plain": [1, -2.5, True, False, None, "x", 3], "last": ["one"], "ends plain": ["y", 4, None],
}


@pytest.mark.parametrize("split", ["64", "1000000"])
@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_assets_are_read_in_splits(spark, tmp_path, monkeypatch, split, layout):
    monkeypatch.setattr(assets, "RANGE", 4 if split == "64" else 1 << 18)
    more = {f"t{i}": [f"v{i}-{j}" for j in range(i % 7)] for i in range(40)}
    files = {"a.json": ASSETS, "b.json": more, "c.json": {}, "sub/d.json": {"one": ["z"] * 30}}
    for name, table in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(table, **layout), encoding="utf8")
    (tmp_path / "empty.json").write_text("")
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    want = [(t, plain(v)) for table in files.values() for t, values in table.items() for v in values or []]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [tuple(r) for r in assets.read_assets(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", ['{"a": "b"}', '{"a": {"b": ["c"]}}', '{"a": ["b"], "c"}', '["a"]', '{"a": ["b" "c"]}', '{"a": [["b"]]}', '{"a": ["b"', '{"a": ["b"], '])
def test_other_json_files_stop_the_job(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="no object of lists"):
        assets.read_assets(spark, str(tmp_path)).collect()


def test_benchmark_files_have_one_wrapper(spark, tmp_path):
    rows = [(i, f"c <{i % 3}> & \"d\"", pos, f"s{i}", "p & <q>", f"o{pos}") for i in range(60) for pos in range(1, i % 4 + 1)]
    triples = spark.createDataFrame(rows, "id long, category string, pos int, subject string, predicate string, object string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        write_benchmark_xml(triples.repartition(5), str(tmp_path / "out"))
        write_benchmark_xml(triples.where("id < 0"), str(tmp_path / "none"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = {}
    for file in (tmp_path / "out").glob("part-*"):
        root = ElementTree.parse(file).getroot()
        assert root.tag == "benchmark" and [e.tag for e in root] == ["entries"]
        ids = [int(e.get("eid")[2:]) for e in root[0]]
        assert ids == sorted(ids) and {e.tag for e in root[0]} <= {"entry"}
        for e in root[0]:
            assert [x.tag for x in e] == ["originaltripleset"] and (e.get("shape"), e.get("shape_type")) == ("NA", "NA")
            assert list(e.keys()) == ["category", "eid", "shape", "shape_type", "size"]
            found[e.get("eid")] = (e.get("category"), int(e.get("size")), [x.text for x in e[0]])
    want = {}
    for i, category, _, *triple in rows:
        want.setdefault(f"Id{i}", (category, i % 4, []))[2].append(" | ".join(triple))
    assert found == want
    (none,) = (tmp_path / "none").glob("part-*")
    assert [len(e) for e in ElementTree.parse(none).getroot()] == [0]
