"""CSV, JSON, text and parquet inputs of a study."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textjudge.functions import keys as K
from textjudge.sources.assets import read_assets  # noqa: F401
from textjudge.sources.files import first_rows, in_splits, list_files

BOM = chr(0xFEFF)
#: files whose first record is read at the same time
OPEN_FILES = 16
TRIPLE_COLUMNS = "eid category shape shape_type size kind subject predicate object".split()


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _reader(spark: SparkSession):
    # NA and empty text stay text: only chosen columns turn NA into null
    return (
        spark.read.option("header", "true")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("recursiveFileLookup", "true")
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
    )


def file_place(path: Column) -> tuple[Column, Column]:
    """Model folder and file stem of ``<model>/<stem>.csv``."""
    return K.parent_name(path), K.file_stem(path)


def _first_record(spark: SparkSession, path: str) -> list[str]:
    """Cells of the first record of a file, which is opened and read no further."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(place.getFileSystem(conf).open(place), "UTF-8"))
    try:
        text = reader.readLine() or ""
        while text.count('"') % 2 and (more := reader.readLine()) is not None:
            text += "\n" + more
    finally:
        reader.close()
    return next(csv.reader(io.StringIO(text)), [])


def read_headers(spark: SparkSession, root: str, place=file_place) -> DataFrame:
    """Catalogue, one row per file: path, names (its first record), model, combo and problem.

    ``problem`` says why no row of the file can be used: its header names no ``eid``, or
    its name is no combination. It is null for good files. Only first records are read,
    many files at a time; the catalogue is as long as the list of files.
    """
    files = [(r.path, r.file_path) for r in list_files(spark, root, "*.csv").collect()]
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        records = list(pool.map(lambda f: _first_record(spark, f[0]), files))
    clean = [[(c or "").lstrip(BOM).strip() for c in cells] for cells in records]
    found = spark.createDataFrame([(*f, names) for f, names in zip(files, clean)], "path string, file_path string, names array<string>")
    folder, stem = place(F.col("file_path"))
    named = found.select("path", "names", K.canonical_model(folder).alias("model"), K.parse_combo(stem).alias("combo"))
    problem = (
        F.when(~F.array_contains("names", "eid"), F.lit("header without eid"))
        .when(F.col("combo.dataset").isNull(), F.lit("file name is no combination"))
    )
    return named.withColumn("problem", problem)


def bad_files(spark: SparkSession, root: str, place=file_place) -> DataFrame:
    """(path, problem) of the files that the readers of a tree cannot use."""
    return read_headers(spark, root, place).where("problem IS NOT NULL").select("path", "problem")


class HeaderScan:
    """One scan of all files that share a header; only the cells asked for are parsed."""

    def __init__(self, spark: SparkSession, names: Sequence[str], paths: list[str], place=file_place):
        self.names = list(names)
        schema = _strings([f"_c{i}" for i in range(len(self.names))])
        folder, stem = place(F.col("_metadata.file_path"))
        rows = _reader(spark).schema(schema).csv(paths)
        self.rows = rows.select("*", "_metadata", K.canonical_model(folder).alias("model"), K.parse_combo(stem).alias("_combo")).select("*", "_combo.*")

    def cell(self, name: str) -> Column:
        """The first column of that name, null where the files have none."""
        return F.col(f"_c{self.names.index(name)}") if name in self.names else F.lit(None).cast("string")

    def select(self, *columns: Column | str) -> DataFrame:
        """The key of each row and more columns."""
        return self.rows.withColumn("eid", self.cell("eid")).select(*K.KEY, *columns)


def scans(spark: SparkSession, root: str, place=file_place) -> list[HeaderScan]:
    """A scan per distinct header of a ``<model>/<stem>.csv`` tree, bad files left out.

    Files of one tree may have different headers, in any column order; a row never meets
    its header, as all files of a scan have the same one.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in read_headers(spark, root, place).where("problem IS NULL").select("names", "path").toLocalIterator():
        by_header.setdefault(tuple(r.names), []).append(r.path)
    return [HeaderScan(spark, names, sorted(paths), place) for names, paths in sorted(by_header.items())]


def _stacked(frames: Sequence[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


KEY_SCHEMA = ", ".join(f"{c} string" for c in K.KEY)


def read_classified(spark: SparkSession, root: str, place=file_place) -> DataFrame:
    """Classification answers in long form (key, repeat_idx, answer).

    Repeat columns are ``sentence_<n>``; the bare ``sentence`` counts only in files
    without repeats. Empty answers stay, as they count as unparsed.
    """

    def answers(scan: HeaderScan) -> DataFrame:
        repeats = {n: int(m[1]) for n in scan.names if (m := re.fullmatch(r"sentence_([0-9]+)", n))}
        used = repeats or ({"sentence": 1} if "sentence" in scan.names else {})
        each = [F.struct(F.lit(i).alias("repeat_idx"), F.coalesce(scan.cell(n), F.lit("")).alias("answer")) for n, i in used.items()]
        return scan.select(F.inline(F.array(*each))) if each else None

    found = [f for s in scans(spark, root, place) if (f := answers(s)) is not None]
    return _stacked(found, spark, f"{KEY_SCHEMA}, repeat_idx int, answer string")


def read_generated(spark: SparkSession, root: str, place=file_place) -> DataFrame:
    """(key, triple_count) of every generated sentence; null where a file has no size."""
    found = [s.select(s.cell("size").try_cast("int").alias("triple_count")) for s in scans(spark, root, place)]
    return _stacked(found, spark, f"{KEY_SCHEMA}, triple_count int")


def read_sentences(spark: SparkSession, root: str, place=file_place) -> DataFrame:
    """Sentences with their entry meta data; NA and empty shapes become null."""

    def sentences(s: HeaderScan) -> DataFrame:
        blank = lambda n: F.nullif(F.nullif(s.cell(n), F.lit("NA")), F.lit("")).alias(n)
        return s.select(
            s.cell("category").alias("category"), blank("shape"), blank("shape_type"),
            s.cell("size").try_cast("int").alias("size"), s.cell("sentence").alias("sentence"),
        )

    found = [sentences(s) for s in scans(spark, root, place)]
    return _stacked(found, spark, f"{KEY_SCHEMA}, category string, shape string, shape_type string, size int, sentence string")


def first_sentences(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows of one file or of files with one header, in file order, with ``place``."""
    found = [r.path for r in list_files(spark, path, "*.csv").orderBy("path").take(1)]
    names = [c.lstrip(BOM).strip() for c in _first_record(spark, found[0])] if found else []
    unique = [c if c and c not in names[:i] else f"_c{i}" for i, c in enumerate(names)]
    read = lambda paths: in_splits(_reader(spark).schema(_strings(unique)).csv(paths))
    return first_rows(spark, path, n, read, "*.csv").drop("line_no")


def read_triples(spark: SparkSession, root: str, na_as_null: bool = True) -> DataFrame:
    """Flat triple files with the position of each triple inside its entry.

    File order is kept through block offset and row order inside the block; it is
    turned into a position within the (small) entry only.
    """
    raw = _reader(spark).schema(_strings(TRIPLE_COLUMNS)).csv(root)
    path = F.col("_metadata.file_path")
    keyed = raw.select(
        K.parent_name(path).alias("dataset"),
        K.file_stem(path).alias("variant"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        *TRIPLE_COLUMNS,
    )
    order = Window.partitionBy("dataset", "variant", "eid").orderBy("_block", "_row")
    out = keyed.withColumn("pos", F.row_number().over(order)).withColumn(
        "size", F.col("size").try_cast("int")
    )
    if na_as_null:
        blank = {c: F.nullif(F.col(c), F.lit("NA")) for c in ("shape", "shape_type")}
        out = out.withColumns(blank)
    return out.drop("_block", "_row")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question-answer source; only four columns are read."""
    return spark.read.parquet(path).select("id", "category", "question_orig", "answer_orig")


def read_context_lines(spark: SparkSession, path: str) -> DataFrame:
    from textjudge.operators.construct import read_context

    return read_context(spark.read.text(path))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation sheet; a byte order mark in the first header is removed."""
    df = _reader(spark).csv(path)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])
