"""Recognition of FA / CFA / FI in free-form classification answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import (
    collapse,
    find,
    find_all,
    first_rule,
    let,
    literal_array,
    lookup,
    matches,
    strip,
    text_or_empty,
)


def _known(text: Column) -> Column:
    return text.isin(*fixed.LABELS)


def _word_labels(text: Column) -> list[tuple[Column, str]]:
    return [(matches(text, pattern), label) for label, pattern in fixed.LABEL_WORD_PATTERNS]


def _compact(text: Column) -> Column:
    return F.upper(F.btrim(text, F.lit(fixed.DECORATION_CHARS)))


def parse_label(answer: Column) -> Column:
    """Conservative reading: one label token wins, several give '', then label words."""

    def label(text: Column) -> Column:
        words = [(hit, F.lit(label)) for hit, label in _word_labels(text)]

        def named(tokens: Column) -> Column:
            return first_rule(
                (F.size(tokens) == 1, F.upper(F.get(tokens, F.lit(0)))),
                (F.size(tokens) > 1, F.lit("")),
                *words,
                otherwise=F.lit(""),
            )

        return first_rule(
            (text == "", F.lit("")),
            (_known(_compact(text)), _compact(text)),
            otherwise=let(find_all(text, fixed.LABEL_TOKEN_PATTERN, 1), named),
        )

    # bound once: an answer is stripped and searched for tokens a single time
    return let(strip(text_or_empty(answer)), label)


def parse_answer(answer: Column) -> Column:
    """Strict reading with its status: exact, recovered, multiple, unparsed or empty."""
    text = strip(text_or_empty(answer))
    tokens = find_all(text, fixed.LABEL_TOKEN_PATTERN, 1)
    leading = find(text, fixed.LEADING_LABEL_PATTERN, 1)
    named = find(text, fixed.NAMED_LABEL_PATTERN, 1)
    # labels named in any way: the single token, if there is one, then label words
    spoken = F.transform(tokens, F.upper)
    hits = [F.array_contains(spoken, label) | hit for hit, label in _word_labels(text)]
    n_hits = reduce(lambda a, b: a + b, [h.cast("int") for h in hits])
    only = first_rule(
        *[(h, F.lit(label)) for h, (_, label) in zip(hits, _word_labels(text))],
        otherwise=F.lit(""),
    )

    def outcome(label, status: str) -> Column:
        value = F.lit(label) if isinstance(label, str) else label
        return F.struct(value.alias("label"), F.lit(status).alias("status"))

    return first_rule(
        (text == "", outcome("", "empty")),
        (_known(text), outcome(text, "exact")),
        (_known(_compact(text)), outcome(_compact(text), "recovered")),
        (F.size(tokens) > 1, outcome("", "multiple")),
        (leading != "", outcome(F.upper(leading), "recovered")),
        (named != "", outcome(F.upper(named), "recovered")),
        (n_hits == 1, outcome(only, "recovered")),
        (n_hits > 1, outcome("", "multiple")),
        otherwise=outcome("", "unparsed"),
    )


def sanitize_answer(content: Column) -> Column:
    """One label, INVALID when labels conflict, else the answer on a single line."""
    words = F.regexp_extract_all(content, F.lit("[A-Za-z]+"), F.lit(0))
    first = lookup(F.lower(F.get(words, F.lit(0))), fixed.LABEL_ALIASES)
    last = lookup(F.lower(F.try_element_at(words, F.lit(-1))), fixed.LABEL_ALIASES)
    edge = F.array_distinct(F.array_compact(F.array(first, last)))
    tokens = F.transform(
        find_all(content, fixed.SHORT_LABEL_TOKEN_PATTERN, 1),
        lambda t: lookup(F.lower(t), fixed.LABEL_ALIASES),
    )
    by_word = F.array_compact(
        F.array(*[F.when(hit, F.lit(label)) for hit, label in _word_labels(content)])
    )
    named = F.array_distinct(F.concat(tokens, by_word))
    return first_rule(
        (text_or_empty(content) == "", content),
        (F.size(edge) == 1, F.get(edge, F.lit(0))),
        (F.size(edge) > 1, F.lit(fixed.INVALID_LABEL)),
        (F.size(named) == 1, F.get(named, F.lit(0))),
        (F.size(named) > 1, F.lit(fixed.INVALID_LABEL)),
        otherwise=collapse(content),
    )


def is_label(label: Column) -> Column:
    return F.array_contains(literal_array(fixed.LABELS), label)
