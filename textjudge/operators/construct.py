"""Entries, members and their construction: grouping, filters, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions import terms as T
from textjudge.functions.cleaning import truncate_sentence
from textjudge.functions.columns import strip, text_or_empty
from textjudge.operators.index import chunked_index

META = ["category", "shape", "shape_type", "size"]


def preferred_kind(triples: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Keep the triples of one kind per entry: modified, else original, else the first seen.

    The choice is a window over the entry, which has the same partitioning as the
    grouping that follows.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in fixed.KIND_PREFERENCE]), F.col("kind"))
    rank = F.when(order > 0, order).otherwise(len(fixed.KIND_PREFERENCE) + F.col("pos"))
    best = F.min_by("kind", rank).over(Window.partitionBy(*keys))
    return triples.withColumn("_best", best).filter(F.col("kind") == F.col("_best")).drop("_best")


def entries(
    triples: DataFrame, kind: str | None = None, keys: Sequence[str] = ("eid",)
) -> DataFrame:
    """One row per entry with its triples in file order."""
    rows = preferred_kind(triples, keys) if kind is None else triples.filter(F.col("kind") == kind)
    listed = F.array_sort(F.collect_list(F.struct("pos", "subject", "predicate", "object")))
    # meta data of the first row in file order
    meta = [F.min_by(c, "pos").alias(c) for c in ("kind", *META)]
    grouped = rows.groupBy(*keys).agg(*meta, listed.alias("triples"))
    return grouped.withColumn("triple_count", F.size("triples"))


def filter_entries(
    df: DataFrame,
    kind: str | None = None,
    categories: Sequence[str] | None = None,
    shape_types: Sequence[str] | None = None,
    sizes: tuple[int, int] | None = None,
    eid_part: str | None = None,
) -> DataFrame:
    """Row predicates of the entry browser; all of them can reach the scan."""
    tests: list[Column] = []
    if kind is not None:
        tests.append(F.col("kind") == kind)
    if categories is not None:
        tests.append(F.col("category").isin(*categories))
    if shape_types:
        tests.append(F.col("shape_type").isin(*shape_types))
    if sizes is not None:
        tests.append(F.col("size").between(*sizes))
    if eid_part:
        tests.append(F.contains(F.lower("eid"), F.lit(eid_part.lower())))
    for test in tests:
        df = df.filter(test)
    return df


def number_repeats(
    df: DataFrame, base: str, order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """Unique names: the first use of a base keeps it, later ones get ``_2``, ``_3``...

    ``chunk`` rises with ``order`` and splits a name that is used very often.
    """
    turns = chunked_index(df, [base], order, chunk, "_turn")
    later = F.concat(F.col(base), F.lit("_"), (F.col("_turn") + 1).cast("string"))
    return turns.withColumn(
        name, F.when(F.col("_turn") == 0, F.col(base)).otherwise(later)
    ).drop("_turn")


# --- entries, sentences, prompts -------------------------------------------


def enrich_sentences(
    sentences: DataFrame, entry_rows: DataFrame, per_entry: dict[str, Column] | None = None
) -> DataFrame:
    """Non-empty sentences with the triples of their entry, in prompt and list form.

    ``per_entry`` adds columns made from these forms, once per entry.
    """
    shown = entry_rows.select(
        "eid",
        "category",
        "triple_count",
        T.format_triples(F.col("triples"), prompt=True).alias("modified_triples"),
        F.transform(
            "triples", lambda x: T.format_triple(x["subject"], x["predicate"], x["object"], True)
        ).alias("modified_triples_json"),
    ).withColumns(per_entry or {})
    spoken = sentences.filter(strip(text_or_empty(F.col("sentence"))) != "")
    return spoken.join(shown, "eid")


def fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), text_or_empty(value.cast("string")))
    return template


def entry_prompts(entry_rows: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """Generation prompts: every entry with every (language, template) of a short list."""
    rows = F.transform(
        "triples",
        lambda x: F.concat(
            F.lit("  - "), T.format_triple(x["subject"], x["predicate"], x["object"], True)
        ),
    )
    listed = F.array(*[F.struct(F.lit(name).alias("language"), F.lit(text).alias("template")) for name, text in templates])
    each = entry_rows.select("eid", "category", "size", rows.alias("_rows"), F.inline(listed))
    prompt = fill(
        F.col("template"),
        {
            "size": F.col("size"),
            "category": F.col("category"),
            "triples_str": F.array_join("_rows", "\n"),
        },
    )
    return each.select("eid", "language", prompt.alias("prompt"))


def judge_prompt(template: str, language: Column, sentence_limit: int | None = None) -> Column:
    """Faithfulness prompt of an enriched sentence row; the sentence is whole unless limited."""
    sentence = T.display(F.col("sentence"))
    if sentence_limit is not None:
        sentence = truncate_sentence(sentence, sentence_limit)
    return fill(
        F.lit(template),
        {
            "eid": F.col("eid"),
            "category": F.col("category"),
            "target_language": language,
            "sentence": sentence,
            "modified_triples": T.display(F.col("modified_triples")),
        },
    )


def fluency_prompt(template: str, language: Column, entity_language: Column, terms: Column) -> Column:
    return fill(
        F.lit(template),
        {
            "language": language,
            "entity_language": entity_language,
            "lexical_terms": T.format_terms(terms),
            "sentence": T.display(F.col("sentence")),
        },
    )


# --- members and tags ------------------------------------------------------


def members(triples: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Subjects and objects as rows, with type and equality form."""
    return member_rows(triples, keys, ["subject", "object"])


def typed_members(triples: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """The members that have a type; a side without a type column makes no rows."""
    sides = [s for s in ("subject", "object") if f"{s}_type" in triples.columns]
    return member_rows(triples, keys, sides or ["object"]).filter(F.col("type").isNotNull())


def member_rows(triples: DataFrame, keys: Sequence[str], sides: Sequence[str]) -> DataFrame:
    types = {s: F.col(f"{s}_type") if f"{s}_type" in triples.columns else F.lit(None) for s in sides}
    each = F.array(*[F.struct(F.col(s).alias("value"), types[s].cast("string").alias("type")) for s in sides])
    rows = triples.select(*keys, F.inline(each))
    return rows.withColumn("norm", T.normalize_member(F.col("value")))


def unique_members(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per equality form; its smallest spelling stands for it."""
    best = F.min(F.struct("value", "type")).alias("_m")
    return rows.groupBy(*keys, "norm").agg(best).select(*keys, "norm", "_m.value", "_m.type")


def unique_values(triples: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    return (
        triples.select(*keys, F.explode(F.array("subject", "object")).alias("member"))
        .distinct()
        .withColumn("type", F.lit(None).cast("string"))
    )


def update_tags(rows: DataFrame, updates: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Exact-value tag update: ``updates`` holds (keys, value, type)."""
    new = updates.select(
        *keys, F.col("value").alias("member"), F.col("type").alias("_new"), F.lit(True).alias("_hit")
    )
    joined = rows.join(new, [*keys, "member"], "left")
    return joined.withColumn(
        "type", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("type"))
    ).drop("_new", "_hit")


def tag_members(triples: DataFrame, answers: DataFrame, types: Sequence[str]) -> DataFrame:
    """Apply ``word: tag`` answers to the members of each entry by equality form.

    The tag lines of one entry become a map on the entry row, so that both members of
    every triple are tagged with a single join on the entry.
    """
    pairs = F.filter(T.tag_pairs(F.col("answer")), lambda p: p["tag"].isin(*types))
    # a later line for the same word replaces the earlier one
    tags = F.reverse(pairs)
    keyed = answers.select("eid", tags.alias("_tags"))
    joined = triples.join(keyed, "eid", "left")

    def tag(member: str) -> Column:
        norm = T.normalize_member(F.col(member))
        hit = F.filter("_tags", lambda p: p["norm"] == norm)
        return F.try_element_at(hit, F.lit(1))["tag"]

    return joined.withColumns({"subject_type": tag("subject"), "object_type": tag("object")}).drop(
        "_tags"
    )


def clean_assets(assets: DataFrame) -> DataFrame:
    """Raw (type, value) assets to valid, distinct, normalised ones.

    Types outside the cleaning rules pass unchanged.
    """
    kind, value = F.col("type"), F.col("value")
    names = kind.isin(*fixed.NAME_TYPES)
    jobs = kind.isin(*fixed.OCCUPATION_TYPES)
    dates, numbers = kind == fixed.DATE_TYPE, kind == fixed.NUMBER_TYPE
    bare = F.regexp_replace(value, " ", "")
    clean = (
        F.when(names, T.member_value(value))
        .when(jobs, F.lower(T.member_value(value)))
        .when(numbers, bare)
        .otherwise(value)
    )
    keep = F.when(dates, T.valid_date(value)).when(numbers, T.valid_number(bare)).otherwise(True)
    ruled = names | jobs | dates | numbers
    shaped = assets.filter(keep).select("type", clean.alias("value"), ruled.alias("_ruled"))
    distinct = shaped.filter("_ruled").select("type", "value").distinct()
    return distinct.unionByName(shaped.filter(~F.col("_ruled")).select("type", "value"))


def read_context(lines_df: DataFrame, column: str = "value") -> DataFrame:
    """``keyword===context`` lines to a table with one context per keyword."""
    pairs = lines_df.select(T.context_pair(F.col(column)).alias("p")).filter("p IS NOT NULL")
    return pairs.select("p.keyword", "p.context")


def keyword_context(rows: DataFrame, context: DataFrame, member: str = "member") -> DataFrame:
    """Context of each member, ``none`` where there is no entry; both sides in display form."""
    keyed = rows.withColumn("keyword", T.display(F.col(member)))
    joined = keyed.join(context, "keyword", "left")
    return joined.withColumn("context", F.coalesce("context", F.lit(fixed.CONTEXT_DEFAULT)))


def entry_text(entry_rows: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Meta data, triple text and predicates of each entry as flat columns."""
    text = F.transform(
        "triples", lambda x: T.format_triple(x["subject"], x["predicate"], x["object"])
    )
    predicates = F.transform("triples", lambda x: x["predicate"])
    return entry_rows.select(
        *keys,
        *META,
        F.col("kind").alias("triple_kind"),
        "triple_count",
        F.array_join(text, "; ").alias("triples"),
        predicates.alias("predicate_list"),
        F.array_join(predicates, "; ").alias("predicates"),
    )


def enrich_judged(rows: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """Judged rows with the text, predicates and meta data of their source entry."""
    return rows.join(entry_text(entry_rows), "eid", "left")
