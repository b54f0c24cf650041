"""Judge verdicts: loose JSON, scores, comments, legacy shapes, response fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import find, first_rule, let, lookup, null_if_empty, strip, text_or_empty

# --- access to loosely typed fields ----------------------------------------


def field(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant")


_KINDS = {
    "BIGINT": "int", "DECIMAL": "real", "DOUBLE": "real", "STRING": "text",
    "ARRAY": "list", "OBJECT": "object", "BOOLEAN": "bool",
}


def kind(value: Column) -> Column:
    """JSON type of a variant: int, real, text, list, object, bool, or '' for none.

    ``value`` occurs once, so that a test of the type never reads it twice.
    """
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)
    return lookup(name, _KINDS, F.lit(""))


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def number_of(value: Column) -> Column:
    return let(value, lambda v: F.when(kind(v).isin("int", "real"), F.try_variant_get(v, "$", "double")))


# --- scores ----------------------------------------------------------------


def _whole(value: Column) -> Column:
    return let(number_of(value), lambda n: F.when(n == F.floor(n), n.cast("int")))


def score_in_range(parsed: Column, key: str) -> Column:
    """Whole number 1..5 (4.0 counts, text does not)."""
    score = _whole(field(parsed, f"$.{key}"))
    return let(score, lambda s: F.when(s.isin(*fixed.SCORE_VALUES), s))


def score_below_max(parsed: Column, key: str) -> Column:
    """Any number below the best score, truncated."""
    number = number_of(field(parsed, f"$.{key}"))
    return let(number, lambda n: F.when(n < fixed.MAX_SCORE, n.cast("int")))


def score_integer(parsed: Column, key: str) -> Column:
    value = field(parsed, f"$.{key}")
    return F.when(kind(value) == "int", F.try_variant_get(value, "$", "int"))


def score_cascade(record: Column) -> Column:
    """First usable value of parsed.faithfulness_score, parsed.score and the same on the record."""

    def usable(value: Column) -> Column:
        digits = find(text_of(value), r"\b([1-5])\b", 1, flags="(?U)")
        from_text = F.when(kind(value) == "text", null_if_empty(digits).cast("int"))
        return F.coalesce(_whole(value), from_text)

    paths = ("$.parsed.faithfulness_score", "$.parsed.score", "$.faithfulness_score", "$.score")
    return F.coalesce(*[usable(field(record, p)) for p in paths])


# --- verdict text ----------------------------------------------------------


def json_object(text: Column) -> Column:
    """Text from the first opening to the last closing brace, or null."""
    return let(F.regexp_extract(text, r"(?s)\{.*\}", 0), null_if_empty)


def extract_verdict(raw: Column) -> Column:
    """Parsed verdict of a judge response, null when it holds no valid JSON object."""
    return let(F.try_parse_json(json_object(raw)), lambda v: F.when(kind(v) == "object", v))


def comment_text(value: Column) -> Column:
    """Null, list, object or scalar as comment text; list items joined with '; '."""

    def scalar(v: Column) -> Column:
        whole = F.when(kind(v) == "object", F.to_json(v)).otherwise(text_of(v))
        return null_if_empty(strip(text_or_empty(whole)))

    def text(v: Column) -> Column:
        listed = F.try_variant_get(v, "$", "array<variant>")
        joined = F.array_join(F.array_compact(F.transform(listed, scalar)), "; ")
        return text_or_empty(F.when(kind(v) == "list", joined).otherwise(scalar(v)))

    return let(value, text)


def joined_text(values: Sequence[Column]) -> Column:
    return F.concat_ws("; ", *[null_if_empty(comment_text(v)) for v in values])


def incorrect_information(record: Column) -> Column:
    names = ("incorrect_information", "unsupported_facts", "rationale")
    return joined_text(
        [field(record, f"$.parsed.{n}") for n in names] + [field(record, f"$.{n}") for n in names]
    )


def style_comment(record: Column) -> Column:
    return joined_text([field(record, "$.parsed.style_comment"), field(record, "$.style_comment")])


def items(record: Column) -> Column:
    """Incorrect-information items as structs; lists, single objects and bare text."""

    def as_list(value: Column) -> Column:
        return first_rule(
            (kind(value) == "list", F.try_variant_get(value, "$", "array<variant>")),
            (kind(value) == "", F.array().cast("array<variant>")),
            otherwise=F.array(value),
        )

    def item(v: Column) -> Column:
        def part(name: str) -> Column:
            return F.when(
                kind(v) == "object", text_or_empty(F.try_variant_get(v, f"$.{name}", "string"))
            )

        comment = F.coalesce(part("comment"), text_or_empty(text_of(v)))
        return F.struct(
            text_or_empty(part("info_used")).alias("info_used"),
            text_or_empty(part("correct_info")).alias("correct_info"),
            comment.alias("comment"),
        )

    return F.transform(let(field(record, "$.parsed.incorrect_information"), as_list), item)


def item_field(item_array: Column, record: Column, name: str) -> Column:
    """One item field over all items plus the verdict's own field, joined with '; '."""
    parts = F.filter(F.transform(item_array, lambda i: strip(i[name])), lambda x: x != "")
    own = null_if_empty(comment_text(field(record, f"$.parsed.{name}")))
    return F.concat_ws("; ", null_if_empty(F.array_join(parts, "; ")), own)


def annotation_fields(record: Column) -> dict[str, Column]:
    """Uniform annotation columns of current and legacy verdict shapes."""

    def raw(path: str) -> Column:
        return F.try_variant_get(record, path, "string")

    cost = F.coalesce(number_of(field(record, "$.request_cost")), F.lit(0.0))
    score = F.coalesce(
        number_of(field(record, "$.parsed.faithfulness_score")),
        number_of(field(record, "$.parsed.score")),
    )
    facts = F.try_variant_get(record, "$.parsed.unsupported_facts", "array<string>")
    legacy = F.transform(
        facts,
        lambda f: F.struct(
            f.alias("info_used"), F.lit("").alias("correct_info"), F.lit("").alias("comment")
        ),
    )
    has_items = kind(field(record, "$.parsed.incorrect_information")) != ""
    return {
        "eid": text_or_empty(raw("$.eid")),
        "source_label": raw("$.source_label"),
        "source_id": raw("$.source_id"),
        "judge_model": raw("$.judge_model"),
        "requested_judge_model": raw("$.requested_judge_model"),
        "request_cost": cost,
        "timestamp": raw("$.timestamp"),
        "sentence": raw("$.sentence"),
        "faithfulness_score": score,
        "label": raw("$.parsed.label"),
        "incorrect_information": F.when(has_items, items(record)).when(F.size(facts) > 0, legacy),
        "style_comment": F.coalesce(
            null_if_empty(raw("$.parsed.style_comment")), raw("$.parsed.rationale")
        ),
    }


# --- model responses -------------------------------------------------------


def response_fields(payload: Column) -> dict[str, Column]:
    """Content, reasoning and usage of one completion response."""
    message = "$.choices[0].message"

    def text(path: str) -> Column:
        value = field(payload, path)
        return F.when(kind(value) == "text", null_if_empty(strip(text_of(value))))

    def detail(v: Column) -> Column:
        first = F.try_variant_get(v, "$.text", "string")
        body = F.coalesce(null_if_empty(first), F.try_variant_get(v, "$.content", "string"))
        return F.when(kind(v) == "text", text_of(v)).when(
            kind(v) == "object", null_if_empty(strip(body))
        )

    details = F.try_variant_get(payload, f"{message}.reasoning_details", "array<variant>")
    listed = F.array_join(F.array_compact(F.transform(details, detail)), "\n")
    names = ("reasoning", "reasoning_content", "reasoning_text")
    out = {
        "raw_content": F.try_variant_get(payload, f"{message}.content", "string"),
        "reasoning": F.coalesce(*[text(f"{message}.{n}") for n in names], null_if_empty(listed)),
        "finish_reason": F.try_variant_get(payload, "$.choices[0].finish_reason", "string"),
        "response_model": F.try_variant_get(payload, "$.model", "string"),
    }
    for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
        out[name] = F.try_variant_get(payload, f"$.usage.{name}", "long")
    out["cost"] = F.try_variant_get(payload, "$.usage.cost", "double")
    return out
