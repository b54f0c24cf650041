"""Triples, terms and members: parsing, formatting, normalisation, leakage, keywords."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.cleaning import lines, words
from textjudge.functions.columns import collapse, let, null_if_empty, strip, text_or_empty

# --- triples ---------------------------------------------------------------


def parse_triple(text: Column) -> Column:
    """``subject | predicate | object``; null when there are fewer than three parts."""

    def build(parts: Column) -> Column:
        return F.when(
            F.size(parts) == 3,
            F.struct(
                strip(F.get(parts, F.lit(0))).alias("subject"),
                strip(F.get(parts, F.lit(1))).alias("predicate"),
                strip(F.get(parts, F.lit(2))).alias("object"),
            ),
        )

    return let(F.split(text, r"\|", 3), build)


def parse_formatted_triple(line: Column) -> Column:
    """The same for one line of a bulleted list."""
    return parse_triple(F.regexp_replace(strip(line), r"(?U)^-\s*", ""))


def display(text: Column) -> Column:
    # replace works on bytes; translate takes a text apart character by character
    return F.replace(text, F.lit("_"), F.lit(" "))


def format_triple(subject: Column, predicate: Column, obj: Column, prompt: bool = False) -> Column:
    parts = [display(p) if prompt else p for p in (subject, predicate, obj)]
    return F.concat_ws(" | ", *[text_or_empty(p) for p in parts])


def format_triples(triples: Column, prompt: bool = False) -> Column:
    """Bulleted list of an array of triples."""
    rows = F.transform(
        triples,
        lambda t: F.concat(
            F.lit("- "), format_triple(t["subject"], t["predicate"], t["object"], prompt)
        ),
    )
    return F.array_join(rows, "\n")


def response_lines(response: Column) -> Column:
    """Lines of a response that are not blank; a column of its own where several parts are read."""
    return F.filter(F.transform(lines(strip(response)), strip), lambda x: x != "")


def response_triples(response: Column) -> Column:
    """Entry rows of a tagged response: lines after the first that hold a triple."""
    return line_triples(response_lines(response))


def line_triples(listed: Column) -> Column:
    """The same for the lines of a response, see ``response_lines``."""
    bare = F.transform(
        F.filter(listed, lambda x, i: (i > 0) & F.contains(x, F.lit("|"))),
        lambda x: F.regexp_replace(x, "^<mtriple>|</mtriple>$", ""),
    )
    split = F.filter(F.transform(bare, lambda x: F.split(x, r"\|")), lambda p: F.size(p) == 3)
    return F.transform(
        split,
        lambda p: F.struct(
            member_value(strip(F.get(p, F.lit(0)))).alias("subject"),
            strip(F.get(p, F.lit(1))).alias("predicate"),
            member_value(strip(F.get(p, F.lit(2)))).alias("object"),
        ),
    )


def response_phrase(response: Column) -> Column:
    return line_phrase(response_lines(response))


def line_phrase(listed: Column) -> Column:
    """Phrase of a response, from its lines."""
    return F.regexp_replace(F.get(listed, F.lit(1)), "^<phrase>|</phrase>$", "")


def lexical_terms(triples: Column) -> Column:
    """Distinct subjects and objects in order of first appearance."""
    both = F.flatten(
        F.transform(
            triples, lambda t: F.array(strip(display(t["subject"])), strip(display(t["object"])))
        )
    )
    return F.array_distinct(F.filter(both, lambda x: x != ""))


def _triple_item(item: Column) -> Column:
    parts = F.from_json(item, "array<string>")
    listed = F.struct(*[F.get(parts, i).alias(c) for i, c in enumerate(("subject", "predicate", "object"))])
    return F.when(F.startswith(F.ltrim(item), F.lit("[")) & (F.size(parts) == 3), listed).otherwise(parse_formatted_triple(item))


_TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"


def row_triples(triples_json: Column, formatted: Column) -> Column:
    """Triples of a record: its JSON list, else its formatted text.

    An item of the list is a formatted triple or itself a list of its three parts.
    """
    from_json = F.from_json(triples_json, "array<string>")
    parsed = F.array_compact(F.transform(from_json, _triple_item))
    from_text = F.array_compact(F.transform(lines(formatted), parse_formatted_triple))
    none = F.array().cast(_TRIPLES)
    return let(
        parsed, lambda p: F.when(F.size(p) > 0, p).otherwise(F.coalesce(from_text, none))
    )


def format_terms(terms: Column) -> Column:
    listed = lambda x: F.array_join(F.transform(x, lambda t: F.concat(F.lit("- "), t)), "\n")
    return let(terms, lambda x: F.when(F.size(x) > 0, listed(x)).otherwise(fixed.NO_TERMS_TEXT))


# --- members ---------------------------------------------------------------


@cache
def _accent_table() -> tuple[str, str]:
    """Every precomposed character whose decomposition is one base letter plus marks."""
    accented, plain = [], []
    for code in range(0x80, min(sys.maxunicode, 0x1FFFF)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def strip_accents(text: Column) -> Column:
    accented, plain = _accent_table()
    folded = F.regexp_replace(F.translate(text, accented, plain), r"\p{Mn}", "")
    # text with one byte per character has nothing to fold
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(folded)


def member_value(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def normalize_member(text: Column) -> Column:
    """Equality form of a member: without underscores and accents, case kept."""
    return strip_accents(F.replace(text, F.lit("_"), F.lit("")))


# --- leakage and keywords --------------------------------------------------


def leaked_predicates(sentence: Column, predicates: Column) -> Column:
    """Camel-case predicates that the sentence copies as whole tokens.

    The cheap substring test runs first; the per-row pattern is only compiled for
    predicates that do occur somewhere in the sentence.
    """

    def leaks(p: Column) -> Column:
        token = F.concat(
            F.lit(r"(?<![A-Za-z0-9_])\Q"), p, F.lit(r"\E(?![A-Za-z0-9_])")
        )
        return F.rlike(p, F.lit("[a-z][A-Z]")) & F.contains(sentence, p) & F.rlike(sentence, token)

    return F.filter(F.array_sort(F.array_distinct(predicates)), leaks)


def content_words(text: Column, stopwords) -> Column:
    # words are A-Z and a-z only, so the whole text can be lowered first, not word by word
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(words(lowered), lambda w: ~w.isin(*stopwords))


def bigrams(tokens: Column) -> Column:
    """Each token with the one after it, as structs (first, second); second is null at the end.

    Without a lambda per pair; meant for ``inline``.
    """
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(0)))
    return F.arrays_zip(tokens.alias("first"), following.alias("second"))


# --- assets and context ----------------------------------------------------


def valid_date(text: Column) -> Column:
    shaped = F.rlike(text, F.lit(r"^\d{1,2}-\d{1,2}-\d{4}$"))
    return shaped & F.try_to_date(text, "d-M-yyyy").isNotNull()


def valid_number(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^[+-]?\d+(_\d+)*$"))


def context_pair(line: Column) -> Column:
    """``keyword===text`` line as a struct with the keyword in display form."""
    parts = F.split(strip(line), fixed.CONTEXT_SEPARATOR, 2)
    return F.when(
        F.size(parts) == 2,
        F.struct(
            display(F.get(parts, F.lit(0))).alias("keyword"),
            F.get(parts, F.lit(1)).alias("context"),
        ),
    )


def tag_pairs(answer: Column) -> Column:
    """``word: tag`` lines as (norm, tag); lines with another shape are ignored."""
    split = F.filter(
        F.transform(F.split(answer, "\n"), lambda x: F.split(x, ":")), lambda p: F.size(p) == 2
    )
    return F.transform(
        split,
        lambda p: F.struct(
            normalize_member(strip(F.get(p, F.lit(0)))).alias("norm"),
            strip(F.get(p, F.lit(1))).alias("tag"),
        ),
    )
