"""Record keys: file stems, combos, model names, languages, identifiers, groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import (
    col,
    first_rule,
    literal_array,
    lookup,
    null_if_empty,
    strip,
    text_or_empty,
)

KEY = ["model", "dataset", "variant", "language", "eid"]
CLUSTER = ["dataset", "variant", "eid"]


def parse_combo(label: Column) -> Column:
    """``dataset_variant_language`` anywhere in a label; null parts when absent."""

    def part(i: int) -> Column:
        return null_if_empty(F.regexp_extract(text_or_empty(label), fixed.COMBO_PATTERN, i))

    return F.struct(part(1).alias("dataset"), part(2).alias("variant"), part(3).alias("language"))


def parse_judge_stem(stem: Column) -> Column:
    """``judge_<dataset>_<variant>_<language>_<judge...>``; empty parts otherwise."""
    parts = F.split(stem, "_")
    good = (F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "judge")

    def part(i: int) -> Column:
        return F.when(good, F.get(parts, F.lit(i))).otherwise("")

    return F.struct(part(1).alias("dataset"), part(2).alias("variant"), part(3).alias("language"))


def parse_source_stem(stem: Column) -> Column:
    """Right-anchored stem parse: the data set may itself contain underscores."""
    parts = F.split(stem, "_")
    n = F.size(parts)
    last, before = F.get(parts, n - 1), F.get(parts, n - 2)
    with_language = (n >= 3) & last.isin(*fixed.LANGUAGES)
    two = n >= 2

    def head(drop: int) -> Column:
        return F.array_join(F.slice(parts, F.lit(1), F.greatest(n - drop, F.lit(0))), "_")

    unknown = F.lit("unknown")
    return F.struct(
        first_rule((with_language, head(2)), (two, head(1)), otherwise=stem).alias("dataset"),
        first_rule((with_language, before), (two, last), otherwise=unknown).alias("variant"),
        first_rule((with_language, last), otherwise=unknown).alias("language"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def infer_key(source_id: Column, source_label: Column, source_path: Column, file_path: Column) -> Column:
    """Model, data set, variant and language of one judgment record."""
    prefix = F.split_part(text_or_empty(source_id), F.lit("__"), F.lit(1))
    namespaced = F.contains(text_or_empty(source_id), F.lit("__")) & (prefix != "")
    model = F.when(namespaced, prefix).otherwise(parent_name(file_path))
    stem = F.coalesce(
        null_if_empty(source_label), null_if_empty(file_stem(source_path)), file_stem(file_path)
    )
    stem = F.regexp_replace(stem, "^judge_", "")
    stem = F.regexp_replace(stem, r"_(?:openai_)?gpt-[^_]+$", "")
    stem = F.regexp_replace(stem, "_glm-5$", "")
    return F.struct(model.alias("model"), parse_source_stem(stem).alias("key"))


def canonical_model(name: Column) -> Column:
    return lookup(name, fixed.MODEL_ALIASES, name)


def display_model(name: Column) -> Column:
    return lookup(name, fixed.MODEL_DISPLAY_ALIASES, name)


def classified_model(name: Column) -> Column:
    """Name of a classification tree's model in the judged tree."""
    bare = F.regexp_replace(name, "-openrouter$", "")
    return F.regexp_replace(bare, r"^([^.]*)\.", "$1_")


def model_candidates(name: Column) -> Column:
    """The name itself, then its first underscore as dot, then its first dot as underscore."""
    dotted = F.regexp_replace(name, "^([^_]*)_", "$1.")
    scored = F.regexp_replace(name, r"^([^.]*)\.", "$1_")
    return F.array_distinct(F.array(name, dotted, scored))


def language_group(dataset: Column, language: Column) -> Column:
    """Prompt language relative to the data set: EN, HSB, Same or Other."""
    target = F.split_part(dataset, F.lit("-"), F.lit(1))
    return first_rule(
        (language == "en", F.lit("EN")),
        (language == "hsb", F.lit("HSB")),
        (language == target, F.lit("Same")),
        otherwise=F.lit("Other"),
    )


def size_bucket(params_b: Column) -> Column:
    return first_rule(
        (params_b < 10, F.lit("small")),
        (params_b < 100, F.lit("medium")),
        (params_b.isNotNull(), F.lit("large")),
        otherwise=F.lit(None).cast("string"),
    )


def stratum(score: Column) -> Column:
    return first_rule(
        (score == 1, F.lit("1")), (score == 5, F.lit("5")), otherwise=F.lit("2-4")
    )


def triple_bucket(count: Column) -> Column:
    """Half-open size classes; null outside all of them."""
    rules = [((count > lo) & (count <= hi), F.lit(name)) for lo, hi, name in fixed.TRIPLE_BUCKETS]
    return first_rule(*rules, otherwise=F.lit(None).cast("string"))


def expected_label(variant: Column) -> Column:
    return lookup(variant, fixed.EXPECTED_LABEL)


def soft_accepts(variant: Column, label: Column) -> Column:
    pairs = []
    for name, labels in fixed.SOFT_LABELS.items():
        pairs += [F.lit(name), literal_array(labels)]
    return F.coalesce(
        F.array_contains(F.try_element_at(F.create_map(*pairs), variant), label), F.lit(False)
    )


def row_uid(*parts: Column) -> Column:
    model, dataset, variant, language, eid = parts
    return F.concat_ws("__", model, F.concat_ws("_", dataset, variant, language), eid)


def sanitize_identifier(text: Column) -> Column:
    clean = F.regexp_replace(strip(text_or_empty(text)), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(null_if_empty(F.btrim(clean, F.lit("_"))), F.lit("source"))


def sanitize_file_name(text: Column) -> Column:
    base = F.coalesce(null_if_empty(strip(text_or_empty(text))), F.lit("unknown"))
    return F.regexp_replace(base, "[^A-Za-z0-9_.-]+", "_")


def source_namespace(path: Column) -> Column:
    """Directory below ``generated``, or null."""
    return F.when(
        F.rlike(path, F.lit("(^|/)generated/[^/]+")),
        sanitize_identifier(F.regexp_extract(path, "(?:^|.*?/)generated/([^/]+)", 1)),
    )


def source_identity(path: Column, label: Column) -> Column:
    base = F.coalesce(null_if_empty(label), file_stem(path))
    space = source_namespace(path)
    return sanitize_identifier(F.concat_ws("__", space, base))


def language_from_stem(stem: Column) -> Column:
    """Last underscore part that is a known language code, or null."""
    bare = F.regexp_replace(stem, "^sentences_", "")
    known = F.filter(
        F.transform(F.split(bare, "_"), sanitize_identifier),
        lambda p: p.isin(*fixed.LANGUAGES),
    )
    return F.try_element_at(known, F.lit(-1))


def resolve_language(override: Column, row_language: Column, stem: Column) -> Column:
    """Language code and name: explicit value, then row column, then file stem."""
    raw = F.coalesce(
        null_if_empty(override), null_if_empty(strip(row_language)), language_from_stem(stem)
    )
    code = F.when(raw.isNotNull(), sanitize_identifier(raw))
    name = lookup(text_or_empty(code), fixed.LANGUAGE_NAMES, F.lit(fixed.DEFAULT_LANGUAGE_NAME))
    return F.struct(
        code.alias("code"),
        name.alias("name"),
        F.when(code.isNotNull(), F.concat(name, F.lit(" ("), code, F.lit(")")))
        .otherwise(name)
        .alias("target"),
    )


def entity_language(stem: Column) -> Column:
    bare = F.regexp_replace(stem, "^sentences_", "")
    parts = F.split(bare, "_")
    dataset = F.when(F.size(parts) >= 2, sanitize_identifier(F.get(parts, F.lit(0))))
    names = {d: fixed.LANGUAGE_NAMES[c] for d, c in fixed.DATASET_ENTITY_LANGUAGE.items()}
    return lookup(text_or_empty(dataset), names, F.lit(fixed.DEFAULT_ENTITY_LANGUAGE_NAME))


def kind_for_dataset(dataset: Column) -> Column:
    return lookup(dataset, fixed.KIND_BY_DATASET, F.lit(fixed.DEFAULT_KIND))


def endpoint(url: Column, default: str) -> Column:
    """Completion endpoint in its full form; ``default`` for a missing one."""
    base = F.regexp_replace(strip(text_or_empty(url)), "/+$", "")
    return first_rule(
        (base == "", F.lit(default)),
        (F.endswith(base, F.lit(fixed.COMPLETIONS_SUFFIX)), base),
        otherwise=F.concat(base, F.lit(fixed.COMPLETIONS_SUFFIX)),
    )


def judge_name(requested: Column, actual: Column) -> Column:
    return F.coalesce(null_if_empty(requested), text_or_empty(actual))


def annotation_by_judge(
    requested: Column, actual: Column, url: Column | None, judge: str, current: str
) -> Column:
    """Predicate: the annotation was made by ``judge`` at the ``current`` endpoint."""
    by_model = judge_name(requested, actual) == judge
    if url is None:
        return by_model
    at = F.when(text_or_empty(url) == "", F.lit(current)).otherwise(endpoint(url, current))
    return by_model & (at == current)
