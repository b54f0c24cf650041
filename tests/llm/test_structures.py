"""Manifest, packing and trie against plain versions, on hard rows and with small limits."""

import gc
import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.harness import DATA, difference, duck, duck_rows, spark_rows
from tests.llm import brute
from tests.llm.test_cases import CLASHING, SCHEMA, TEXTS, VOCABULARY
from textjudge.llm import components, concat_cut, ctw, ids, merkle, oracles, packed, packing, queries, trie
from textjudge.operators import lineage

PIECES = {"doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"}


def key(row):
    return [(v is None, str(v)) for v in row]


@pytest.fixture(scope="module")
def ugly(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if k % 7 == 0 else len(t or ""), *["clash"] * len(CLASHING)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(VOCABULARY)
    made.no_padding()
    made.no_truncation()
    return made


# --- concatenate and cut -----------------------------------------------------


def check_windows(pieces, rows, tokenizer, length):
    """Every id lies in exactly one piece, windows are gapless, all but the last are full."""
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)
    pieces = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    whole, documents = b"", []
    for n, r in enumerate(pieces):
        assert r.sequence_id * length + r.offset == len(whole) // 4 and len(r.ids) == 4 * r.length > 0
        assert r.offset + r.length <= length
        whole += r.ids
        if r.start == 0:
            documents.append(b"")
        assert len(documents[-1]) == 4 * r.start
        documents[-1] += r.ids
        if r.start + r.length == r.doc_tokens:
            assert len(documents[-1]) == 4 * r.doc_tokens
    assert sorted(documents) == want
    return whole


@pytest.mark.parametrize("length", [64, 100, 1 << 20])
def test_concatenate_and_cut(spark, ugly, tokenizer, length):
    pieces = concat_cut.pack_documents(ugly, VOCABULARY, length=length)
    assert set(pieces.columns) == PIECES
    rows = pieces.collect()
    whole = check_windows(rows, TEXTS, tokenizer, length)
    built = sorted(concat_cut.sequences(spark.createDataFrame(rows, pieces.schema), length, pad_id=7).collect())
    total = len(whole) // 4
    assert [r.sequence_id for r in built] == list(range(-(-total // length)))
    padded = whole + (7).to_bytes(4, "little") * (-total % length)
    assert b"".join(bytes(r.ids) for r in built) == padded
    for r in built:
        assert r.n_tokens == sum(b.length for b in r.boundaries) and [b.offset for b in r.boundaries] == sorted(b.offset for b in r.boundaries)
    assert sum(len(r.boundaries) for r in built) == len(rows)


def test_concatenate_and_cut_repeats_and_empty_tables(spark, tokenizer):
    rows = [(7, "the same row")] * 500 + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_windows(concat_cut.pack_documents(docs, VOCABULARY, length=128).collect(), rows, tokenizer, 128)
    assert concat_cut.pack_documents(docs.limit(0), VOCABULARY).count() == 0
    assert concat_cut.sequences(concat_cut.pack_documents(docs.limit(0), VOCABULARY)).count() == 0


def test_op12_packs_whole_documents(spark, tokenizer):
    got = queries.QUERIES["op12_concatenate_cut"](spark, f"{DATA}/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    encoded = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    assert {r.doc_id for r in got} == set(texts)
    at = 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == at and r.doc_tokens == len(encoded[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(encoded[r.doc_id][r.start : r.start + r.length].tobytes())
        at += r.length
    assert at == sum(map(len, encoded.values()))


def test_library_ids_equal_the_tokenizer_file(tokenizer):
    encode = ids.encoder(open(VOCABULARY, encoding="utf-8").read()).encode
    r = random.Random(6)
    marks = " \n\t\r\x0b\x0c\x85\xa0 　'aAzZéß漢😀٣²Ⅷ_-<|>#\x1c\x00"
    texts = ["", "<|endoftext|>a<|endoftext|>", "x" * 50_000, " " * 50_000, "\n" * 50_000, "don't we'll I'D 'S"]
    texts += ["".join(r.choice(marks) for _ in range(r.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_are_refused():
    import json

    spec = json.load(open(VOCABULARY, encoding="utf-8"))
    ids.Encoder(json.dumps(spec))
    for change in ({"dropout": 0.1}, {"ignore_merges": True}, {"byte_fallback": True}, {"merges": spec["model"]["merges"][1::-1] + spec["model"]["merges"][2:]}):
        with pytest.raises(ValueError):
            ids.Encoder(json.dumps(spec | {"model": spec["model"] | change}))
    with pytest.raises(ValueError):
        ids.Encoder(json.dumps(spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}))


def test_packing_refuses_ids_beyond_16_bits(ugly):
    with pytest.raises(ValueError, match="16-bit"):
        packing.pack_documents(ugly, VOCABULARY, end_id=70_000)


# --- manifest ------------------------------------------------------------------


def check_manifest(docs, **options):
    got = [tuple(r) for r in merkle.prove(docs, **options).collect()]
    want = brute.manifest_proofs([r.asDict() for r in docs.collect()])
    assert sorted((r[:6] for r in got), key=key) == sorted(want, key=key)
    assert all(r[6] == (r[5] == r[3]) for r in got)
    return got


@pytest.mark.parametrize("piece", [0, 2])
def test_manifest_equals_plain_trees(spark, ugly, monkeypatch, piece):
    monkeypatch.setattr(merkle, "PIECE_LEVEL", piece)
    monkeypatch.setattr(merkle, "PIECE", 16**piece)
    check_manifest(ugly)
    r = random.Random(3)
    names = ["a"] * 60 + ["b", "é", "z", None, "Zz", "a b", ""] + [f"s{i}" for i in range(40)]
    rows = [(r.choice([None, *range(900)]), r.choice(["ABC def", "", None, "Éa Z"]), r.choice(["en", None]), r.choice(names), r.choice([1, None])) for _ in range(2000)]
    # a third of all rows is one row
    rows += [rows[0]] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = check_manifest(docs, rows_per_part=100)
    assert 0 < sum(not r[6] for r in got) < len(got) / 5
    for some in ("source = 'a'", "source IS NULL", "source = 'é'"):
        check_manifest(docs.where(some), rows_per_part=300)


def test_manifest_of_few_rows(spark, ugly):
    assert merkle.prove(ugly.limit(0)).count() == 0
    one = check_manifest(ugly.limit(1))
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == hashlib.sha256(b"").hexdigest()
    alone = ugly.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("source", F.col("doc_id").cast("string"))
    check_manifest(alone)


def test_manifest_settings_are_put_back(spark, ugly):
    before = {c: spark.conf.get(c, None) for c in merkle.CLIMBING}
    merkle.prove(ugly).count()
    assert {c: spark.conf.get(c, None) for c in merkle.CLIMBING} == before


@pytest.mark.parametrize("name", ["op11_merkle_climb", "op13_prefix_trie"])
def test_oracles(spark, name):
    for sf in ("sf0.001", "sf0.01"):
        got = spark_rows(queries.QUERIES[name](spark, f"{DATA}/{sf}"))
        assert difference(got, duck_rows(duck(f"{DATA}/{sf}"), queries.ORACLES[name])) == ""


def test_oracle_crc32():
    assert duck(f"{DATA}/sf0.001").execute("SELECT " + oracles.crc32("'123456789'")).fetchone()[0] == zlib.crc32(b"123456789")


# --- trie -------------------------------------------------------------------------


def tie(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def check_trie(df, **options):
    got = sorted(map(tuple, trie.prefix_trie(df, borrow=trie.Borrow(100, 6), **options).collect()), key=str)
    want = brute.conversation_trie([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], tie=tie)
    assert got == sorted(want, key=str)
    return got


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(5)
    rows = []
    for c in range(430):
        if r.random() > 0.1:
            rows += [(c, r.choice([t, None, t]), r.choice(["u", "a", None]), r.choice(["hi", "yo", None, "é😀", ""])) for t in range(r.choice([1, 2, 3, 4, 8]))]
    # long copies, a conversation without its base, negative ids, repeated rows, no id
    for c in (500, 501, 502, 517, 533, 590, 1000):
        rows += [(c, t, "u", f"t{t % 50}") for t in range(300)]
    rows += [(-5, 1, "u", "x"), (-100, 1, "u", "y"), (-3, 2, "u", "z"), (None, 1, "u", "x"), (1717, 0, "u", "short")]
    rows += [(777, 1, "u", "same")] * 200 + [(701, 1, "u", "same")] * 1500
    clash = [(*x, "clash", "clash") for x in rows]
    return spark.createDataFrame(clash, "conv_id long, turn long, role string, text string, digest string, part string").repartition(3).cache()


@pytest.mark.parametrize("rows_per_shard", [1 << 18, 300, 11])
def test_trie_equals_dictionaries(talks, rows_per_shard):
    got = check_trie(talks, rows_per_shard=rows_per_shard)
    assert max(r[1] for r in got) > 1490


def test_trie_of_few_rows(spark, talks):
    assert check_trie(talks.limit(0)) == []
    assert check_trie(talks.where("conv_id IS NULL")) == []
    # a conversation that is left without turns is still a member of the root
    lone = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][0]
    got = check_trie(spark.createDataFrame([(lone, 0, "u", "gone")], "conv_id long, turn long, role string, text string"))
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_trie_without_borrowing(talks):
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(talks).collect()}
    assert got[(500, 300)].n_convs == 7 and got[(500, 300)].n_children == 0


def test_colliding_digests_stop_the_job(monkeypatch, talks):
    monkeypatch.setattr(trie, "mixed", lambda x: x & np.uint64(1))
    table = talks.where("conv_id = 500").select(F.lit(0).alias("part"), "conv_id", F.unhex(F.md5("text")).alias("digest"), F.length("text").cast("long").alias("chars")).toArrow()
    with pytest.raises(ValueError, match="another seed"):
        trie.Shard(table, trie.Carry(), trie.Borrow(1, 1), 0).nodes()


def test_slots_are_a_minimal_perfect_hash():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 20, 500).astype(np.uint64), r.integers(0, 20, 500).astype(np.uint64)
    rank, first = trie.slots(a, b)
    pairs = sorted(set(zip(a.tolist(), b.tolist())))
    assert [(int(a[k]), int(b[k])) for k in first] == pairs
    assert all(pairs[k] == (x, y) for k, x, y in zip(rank.tolist(), a.tolist(), b.tolist()))


# --- disk ----------------------------------------------------------------------


def shuffle_files(spark) -> set:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_rounds_of_components_leave_no_shuffle_files(spark):
    """Only what the last round read may still lie on disk, not the files of every round."""
    edges = spark.range(1, 600).selectExpr("id AS u", "id - 1 AS v")
    gc.collect()
    before = shuffle_files(spark)
    found = components.components(edges)
    for _ in range(50):
        left = len(shuffle_files(spark) - before)
        if left <= 60:
            break
        time.sleep(0.2)
    assert left <= 60
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(1, 600)}


def test_numbers_are_squeezed_without_loss():
    r = np.random.default_rng(2)
    for values in (np.empty(0, np.uint64), np.array([0, 1 << 63, (1 << 64) - 1], np.uint64), np.sort(r.integers(0, 1 << 56, 1000).astype(np.uint64))):
        assert (packed.unsqueeze(packed.squeeze(values)) == values).all()
    values = np.concatenate(([0.0, -0.0, 1e-300, -np.inf], r.normal(size=1000)))
    assert packed.unsqueeze(packed.squeeze(values), "<f8").tobytes() == values.tobytes()


def test_context_tree_keeps_small_lists(spark, monkeypatch):
    """Lists of byte strings, counts and answers lie in the shared folder until the end."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = [(k, " ".join(r.choices(words, k=400))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []

    def recorded(df):
        out = lineage.stored(df)
        kept.append(sum(len(row[c]) for row in out.collect() for c, kind in out.dtypes if kind == "binary"))
        return out

    monkeypatch.setattr(ctw, "stored", recorded)
    assert ctw.score_texts(docs).count() == len(rows)
    # 4 bytes for each byte of these texts; 15 with lists that are only packed
    assert kept and sum(kept) < 8 * sum(len(t) for _, t in rows)
