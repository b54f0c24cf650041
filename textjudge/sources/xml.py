"""Benchmark and tagged-entry XML, read and written with the built-in XML source."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import text_or_empty
from textjudge.functions.terms import member_value, parse_triple

ENTRY_SCHEMA = (
    "_eid string, _category string, _shape string, _shape_type string, _size int, "
    "originaltripleset struct<otriple:array<string>>, modifiedtripleset struct<mtriple:array<string>>"
)
MEMBER = "struct<_value:string,_type:string>"
TAGGED_SCHEMA = (
    "_id long, _category string, phrase string, "
    f"triples struct<triple:array<struct<subject:{MEMBER},predicate:string,object:{MEMBER}>>>"
)
# the member attribute is itself called value, so the text tag needs another name
OPTIONS = {"attributePrefix": "_", "valueTag": "_text"}
#: an XML file is read by one task, so files of tagged entries hold no more than these
ENTRIES_PER_FILE = 50_000


def flatten_entries(entries: DataFrame) -> DataFrame:
    """Parsed entries to long triples with kind and position; a malformed triple fails."""
    texts = F.array(
        F.struct(F.lit("original").alias("kind"), F.col("originaltripleset.otriple").alias("t")),
        F.struct(F.lit("modified").alias("kind"), F.col("modifiedtripleset.mtriple").alias("t")),
    )
    meta = [
        F.col("_eid").alias("eid"),
        F.col("_category").alias("category"),
        F.col("_shape").alias("shape"),
        F.col("_shape_type").alias("shape_type"),
        F.coalesce("_size", F.lit(0)).alias("size"),
    ]
    sets = entries.select(*meta, F.inline(texts))
    rows = sets.select(*[c for c in sets.columns if c != "t"], F.posexplode("t").alias("_i", "text"))
    message = F.concat(F.lit("malformed triple: "), F.col("text"))
    parsed = parse_triple(F.col("text"))
    checked = F.when(parsed.isNull(), F.raise_error(message).cast("struct<subject:string,predicate:string,object:string>")).otherwise(parsed)
    return (
        rows.filter(F.col("text").isNotNull())
        .withColumn("_p", checked)
        .select("eid", "category", "shape", "shape_type", "size", "kind", (F.col("_i") + 1).alias("pos"), "_p.*")
    )


def read_benchmark_xml(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").options(**OPTIONS).option("rowTag", "entry").schema(ENTRY_SCHEMA)
    return flatten_entries(raw.load(path))


def parse_entry_text(df: DataFrame, column: str) -> DataFrame:
    """The same for entries held as XML text in a column."""
    parsed = df.select(F.from_xml(F.col(column), ENTRY_SCHEMA, OPTIONS).alias("e"))
    return flatten_entries(parsed.select("e.*"))


def entry_records(triples: DataFrame, eid: Column, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Entries in the shape of the benchmark format; entries without triples do not occur."""
    text = F.concat_ws(" | ", "subject", "predicate", "object")
    listed = F.array_sort(F.collect_list(F.struct("pos", text.alias("text"))))
    grouped = triples.groupBy(*keys).agg(
        F.min_by("category", "pos").alias("category"), F.transform(listed, lambda x: x["text"]).alias("t")
    )
    return grouped.select(
        *keys,
        F.struct(
            F.col("category").alias("_category"),
            eid.alias("_eid"),
            F.lit("NA").alias("_shape"),
            F.lit("NA").alias("_shape_type"),
            F.size("t").alias("_size"),
            F.struct(F.col("t").alias("otriple")).alias("originaltripleset"),
        ).alias("entry")
    )


def write_wrapped(lines: DataFrame, path: str, head: Sequence[str], tail: Sequence[str]) -> None:
    """The one text column of ``lines`` as text files, each between ``head`` and ``tail``.

    One file per task that has rows, committed by Spark's own writer, so a task that is
    repeated leaves one file. The first task writes a file even without rows.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = lambda texts: pa.RecordBatch.from_pydict({"value": pa.array(texts, pa.string())})
        begun = TaskContext.get().partitionId() == 0
        if begun:
            yield record(head)
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                yield record(head)
            yield batch
        if begun:
            yield record(tail)

    values = lines.select(F.col(lines.columns[0]).cast("string").alias("value"))
    # no file may be cut, so a limit of the session on rows per file does not count here
    write = lambda df: df.write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)
    write(values.mapInArrow(wrapped, "value string"))
    spark = lines.sparkSession
    if spark.read.text(path).isEmpty():  # a table that Spark knows to be empty has no task
        write(spark.createDataFrame([(x,) for x in (*head, *tail)], "value string").coalesce(1))


def write_benchmark_xml(triples: DataFrame, path: str, eid: Column | None = None) -> None:
    """One ``benchmark/entries`` element per file with its ``entry`` elements, one file per task.

    Entries of a file are in the order of their ids. Without triples there is one file
    without entries.
    """
    key = "id" if eid is None else "eid"
    name = eid if eid is not None else F.concat(F.lit("Id"), F.col("id").cast("string"))
    entries = entry_records(triples, name, [key]).sortWithinPartitions(key).select(F.to_xml("entry", {**OPTIONS, "rowTag": "entry"}))
    write_wrapped(entries, path, ['<?xml version="1.0" encoding="utf-8"?>', "<benchmark>", "<entries>"], ["</entries>", "</benchmark>"])


def _known_type(kind: Column, types: Sequence[str]) -> Column:
    return F.when(kind.isin(*types), kind)


def tagged_triples(raw: DataFrame, language: str) -> DataFrame:
    """Typed triples in long form; unknown types become null, incomplete triples are skipped."""
    types = fixed.MEMBER_TYPES[language]
    rows = raw.select(
        F.coalesce("_id", F.lit(0)).alias("id"),
        text_or_empty(F.col("_category")).alias("category"),
        F.nullif("phrase", F.lit("")).alias("phrase"),
        F.posexplode("triples.triple").alias("_i", "t"),
    )
    whole = rows.filter("t.subject IS NOT NULL AND t.predicate IS NOT NULL AND t.object IS NOT NULL")

    def member(name: str) -> list[Column]:
        value = member_value(text_or_empty(F.col(f"t.{name}._value")))
        return [
            value.alias(name),
            _known_type(F.col(f"t.{name}._type"), types).alias(f"{name}_type"),
        ]

    return whole.select(
        "id", "category", "phrase", (F.col("_i") + 1).alias("pos"),
        *member("subject"), F.col("t.predicate").alias("predicate"), *member("object"),
    )


def read_tagged_xml(spark: SparkSession, path: str, language: str) -> DataFrame:
    raw = (
        spark.read.format("xml").options(**OPTIONS)
        .option("rowTag", "phrased_triple").schema(TAGGED_SCHEMA)
    )
    return tagged_triples(raw.load(path), language)


def write_tagged_xml(triples: DataFrame, path: str, per_file: int = ENTRIES_PER_FILE) -> None:
    """Typed triples (id, category, phrase, pos, members with types) as tagged entries, ``per_file`` at most in a file."""

    def member(name: str) -> Column:
        kind = F.coalesce(F.col(f"{name}_type"), F.lit("null"))
        return F.struct(F.col(name).alias("_value"), kind.alias("_type")).alias(name)

    triple = F.struct("pos", member("subject"), F.col("predicate"), member("object"))
    listed = F.array_sort(F.collect_list(triple))
    bare = F.transform(
        listed, lambda x: F.struct(x["subject"].alias("subject"), x["predicate"].alias("predicate"), x["object"].alias("object"))
    )
    entries = triples.groupBy("id", "category", "phrase").agg(bare.alias("t")).select(
        F.col("id").alias("_id"),
        F.col("category").alias("_category"),
        text_or_empty(F.col("phrase")).alias("phrase"),
        F.struct(F.col("t").alias("triple")).alias("triples"),
    )
    (
        entries.write.mode("overwrite").format("xml").options(**OPTIONS).option("maxRecordsPerFile", per_file)
        .option("rootTag", "phrased_triples").option("rowTag", "phrased_triple").save(path)
    )
