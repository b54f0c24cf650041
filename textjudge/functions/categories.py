"""Issue categories from comment labels, explanations and fluency comments."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import (
    find,
    first_rule,
    let,
    literal_array,
    lookup,
    matches,
    null_if_empty,
    strip,
    text_or_empty,
)

EXPLICIT_LABEL = (
    r"^\s*(?:[-*]\s*)?(" + "|".join(re.escape(x) for x in fixed.REPORT_ISSUE_LABELS) + r")\b"
)


def comment_label(comment: Column) -> Column:
    """First word before the colon, lower case, without closing punctuation."""
    head = F.split_part(strip(text_or_empty(comment)), F.lit(":"), F.lit(1))
    word = F.regexp_extract(head, r"(?U)^\s*(\S+)", 1)
    return F.regexp_replace(F.lower(word), "[,.;]+$", "")


def comment_detail(comment: Column, label: Column) -> Column:
    text = strip(text_or_empty(comment))
    rest = F.substring(text, F.length(label) + 1, F.length(text))
    labelled = (label != "") & F.startswith(F.lower(text), label)
    return F.when(labelled, strip(F.regexp_replace(rest, "^:+", ""))).otherwise(text)


def triple_predicate(correct_info: Column) -> Column:
    """Predicate of an ``a | p | b`` reference."""
    return strip(F.regexp_extract(text_or_empty(correct_info), r"\|([^|]*)\|", 1))


def deep_category(label: Column) -> Column:
    return lookup(label, fixed.DEEP_ISSUE_LABELS, F.lit(""))


def is_other_label(label: Column) -> Column:
    return F.array_contains(literal_array(fixed.DEEP_OTHER_LABELS), label)


def report_category(comment: Column) -> Column:
    """Category of an explicit comment label in the report taxonomy, or null."""
    label = F.lower(find(text_or_empty(comment), EXPLICIT_LABEL, 1))
    return lookup(label, fixed.REPORT_ISSUE_LABELS)


def report_categories(comments: Column, score: Column) -> Column:
    """Distinct categories of one record in order of appearance."""
    listed = F.array_distinct(F.array_compact(F.transform(comments, report_category)))
    found = F.coalesce(listed, F.array().cast("array<string>"))
    missing = (F.size(found) == 0) & score.between(1, fixed.MAX_SCORE - 1)
    return F.when(missing, F.array(F.lit(fixed.ISSUE_NOT_GIVEN))).otherwise(found)


def classify_issue(sentence: Column, explanation: Column) -> Column:
    """First matching issue; a refusal may show in the sentence or the explanation."""
    both = F.concat(text_or_empty(sentence), F.lit(" "), text_or_empty(explanation))
    text = text_or_empty(explanation)
    return first_rule(
        (matches(both, fixed.REFUSAL_PATTERN), F.lit("refusal")),
        *[(matches(text, pattern), F.lit(name)) for name, pattern in fixed.ISSUE_PATTERNS],
        otherwise=F.lit(""),
    )


def fluency_categories(comment: Column) -> Column:
    """All categories whose pattern occurs in a fluency comment."""

    def found(text: Column) -> Column:
        return F.array(*[F.when(matches(text, p), F.lit(name)) for name, p in fixed.FLUENCY_PATTERNS])

    # bound once: the comment may be an expression itself
    return F.array_compact(let(text_or_empty(comment), found))


def label_text(labels: Column) -> Column:
    kept = F.array_compact(F.transform(labels, null_if_empty))
    return F.array_join(F.array_sort(F.array_distinct(kept)), "; ")
