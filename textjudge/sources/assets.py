"""Files of one JSON object ``{type: [value, ...]}`` of any size, read in splits.

Quotation marks end the records of the text source, so a file is split like any text
file, whatever its layout, and no task holds more than one split. A mark is counted unless
an odd run of backslashes stands before it; with the counts of earlier splits added, an odd
number of marks before a record means that it lies in a string. A string followed by a colon
is a type, and others belong to the type before them. Running sums and the type before a
string are found inside splits and ranges of strings, and carried on from one row per split
or range, so nothing grows with the file but the number of these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textjudge.operators.lineage import materialize
from textjudge.sources.files import BROADCAST_SPLITS, in_splits

#: strings of a file that one task follows in order
RANGE = 1 << 18

_PLAIN = r"(?:[-+0-9.eE]+|true|false|null)"
_LISTED = rf"{_PLAIN}(?:\s*,\s*{_PLAIN})*"
#: what may stand between a type and the next string, and between a value and the next string
AFTER_TYPE = rf"^\s*:\s*(?:\[\s*(?:{_LISTED}\s*,\s*)?|(?:null|\[\s*(?:{_LISTED}\s*)?\])\s*(?:,\s*|\}}\s*))$"
AFTER_VALUE = rf"^\s*(?:,\s*(?:{_LISTED}\s*,\s*)?|(?:,\s*{_LISTED}\s*)?\]\s*(?:,\s*|\}}\s*))$"
BEFORE_ALL = rf"^{chr(0xFEFF)}?\s*\{{\s*(?:\}}\s*)?$"
NOTHING = rf"^{chr(0xFEFF)}?\s*$"
#: ends of files and lists
CLOSED = r"(?:\]|:\s*null)\s*(?:,\s*|\}\s*)$"


def _carried(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(totals) if totals.count() <= BROADCAST_SPLITS else totals, keys)


def quoted(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """(path, k, string, gap): the k-th string of a file, still escaped, and what follows it.

    ``k`` is -1 for what stands before the first string (which is null there).
    """
    raw = spark.read.option("lineSep", '"').option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths)
    escaped = F.length(F.regexp_extract("value", r"(\\*)$", 1)) % 2 == 1
    rows = in_splits(raw).withColumn("mark", F.when(escaped, 0).otherwise(1).cast("long"))
    splits = rows.groupBy("path", "block").agg(F.sum("mark").alias("marks"))
    earlier = F.sum("marks").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(splits.select("path", "block", F.coalesce(earlier, F.lit(0)).alias("earlier")))
    inside = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    counted = _carried(rows.withColumn("own", F.coalesce(F.sum("mark").over(inside), F.lit(0))), starts, ["path", "block"])
    n = F.col("earlier") + F.col("own")
    placed = counted.select("path", "block", "row", "value", n.alias("n")).withColumn("k", F.floor((F.col("n") - 1) / 2))
    # a string comes in several records only where marks are escaped
    part = F.struct("block", "row", "value")
    text = lambda odd: F.collect_list(F.when(F.col("n") % 2 == odd, part))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["value"]), '"')
    strings = placed.groupBy("path", "k").agg(text(1).alias("s"), text(0).alias("g"))
    return strings.select(
        "path", "k", F.when(F.col("k") >= 0, joined("s")).alias("string"), F.when(F.size("g") > 0, joined("g")).alias("gap")
    )


def _checked(gap: Column, k: Column, last: Column, is_type: Column, closed_before: Column) -> Column:
    """The gap; an error where the file is no object of lists."""
    fits = F.when(k < 0, gap.rlike(BEFORE_ALL)).when(is_type, gap.rlike(AFTER_TYPE)).otherwise(gap.rlike(AFTER_VALUE))
    turns = (k < 0) | (is_type == closed_before)
    whole = (k == last) == F.rtrim(gap).rlike(r"\}\s*$")
    nothing = (last < 0) & gap.rlike(NOTHING)
    error = F.raise_error(F.concat(F.lit("no object of lists: "), F.col("path"))).cast("string")
    return F.when((fits & turns & whole) | nothing, gap).otherwise(error)


def read_assets(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """``{type: [value, ...]}`` files as (type, value) rows; one JSON object per file.

    Values are strings, numbers, true and false (as text) or null; a list may be null.
    Anything else stops the job. Empty or blank files and empty objects give no rows. The files are read
    three times, the first time for their number of marks only.
    """
    strings = quoted(spark, paths, glob).withColumn("range", F.floor(F.col("k") / RANGE))
    is_type = F.coalesce(F.ltrim("gap").startswith(":"), F.lit(False))
    marked = strings.withColumns({"is_type": is_type, "closed": F.coalesce(F.col("gap").rlike(CLOSED) | (F.col("k") < 0), F.lit(False))})
    ranges = marked.groupBy("path", "range").agg(
        F.max_by("string", F.when(F.col("is_type"), F.col("k"))).alias("type"), F.max_by("closed", "k").alias("end"), F.max("k").alias("k")
    )
    by_file = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(
        ranges.select(
            "path", "range", F.last("type", ignorenulls=True).over(by_file).alias("type_before"),
            F.last("end").over(by_file).alias("end_before"), F.max("k").over(Window.partitionBy("path")).alias("last_k"),
        )
    )
    in_range = Window.partitionBy("path", "range").orderBy("k")
    followed = _carried(
        marked.withColumns(
            {
                "type": F.last(F.when(F.col("is_type"), F.col("string")), ignorenulls=True).over(in_range),
                "closed_before": F.lag("closed").over(in_range),
            }
        ),
        carried,
        ["path", "range"],
    )
    gap = _checked(F.col("gap"), F.col("k"), F.col("last_k"), F.col("is_type"), F.coalesce("closed_before", "end_before"))
    literals = F.filter(F.split(gap, r"[\s,:\[\]{}]+"), lambda x: x != "")
    none = F.array().cast("array<string>")
    # a null list has no values, a null in a list is one
    listed = F.when(gap.rlike(r"^\s*:\s*null") | ((F.col("k") < 0) & gap.isNotNull()), none).otherwise(literals)
    plain = F.transform(listed, lambda x: F.nullif(x, F.lit("null")))
    unescaped = lambda c: F.element_at(F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>"), 1)
    own = F.when(F.col("is_type") | (F.col("k") < 0), none).otherwise(F.array(unescaped(F.col("string"))))
    return followed.select(unescaped(F.coalesce("type", "type_before")).alias("type"), F.explode(F.concat(own, plain)).alias("value"))
