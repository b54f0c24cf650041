"""Clean-up of model output: chatter lines, quotes, reasoning traces, JSON-ready text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textjudge import fixed
from textjudge.functions.columns import (
    IGNORE_CASE,
    collapse,
    find_all,
    let,
    matches,
    null_if_empty,
    strip,
    text_or_empty,
)

# vertical white space (\v) holds all other line ends, also those of Unicode, and is tested faster than their list
_LINE_BREAK = r"\r\n|[\x1c-\x1e\v]"
_META_LINE = fixed.META_LINE_PATTERN
_TRAILING_META = fixed.TRAILING_META_PATTERN
# every round of the fixpoints below removes at least one of these characters
_ROUND_CHARS = "[^\"'`“„(:：]"
_THINK = r"(?is)<think>(.*?)</think>"


def lines(text: Column) -> Column:
    return F.split(text, _LINE_BREAK)


_UNWRAP = (
    "(?s)^(?:" + "|".join(f"{left}(.*){right}" for left, right in fixed.QUOTE_PAIRS) + ")$"
)
_INNER = "".join(f"${i + 1}" for i in range(len(fixed.QUOTE_PAIRS)))


def _repeat_until_stable(text: Column, step) -> Column:
    """Apply ``step`` until nothing changes.

    The number of rounds is bounded by the characters that a round consumes; rounds
    after the fixpoint is reached do nothing.
    """

    def once(acc: Column, _i: Column) -> Column:
        after = F.when(acc["done"], acc["text"]).otherwise(step(acc["text"]))
        return let(after, lambda x: F.struct(x.alias("text"), (x == acc["text"]).alias("done")))

    def run(base: Column) -> Column:
        rounds = F.length(F.regexp_replace(base, _ROUND_CHARS, "")) + 1
        start = F.struct(base.alias("text"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), rounds), start, once, lambda acc: acc["text"])

    return let(text, run)


def _unwrap_once(text: Column) -> Column:
    """Trimmed text without its outer pair of quotes, if it has one."""
    return strip(F.regexp_replace(text, _UNWRAP, _INNER))


def strip_quotes(text: Column) -> Column:
    """Remove all nested pairs of wrapping quotes."""
    return _repeat_until_stable(strip(text), _unwrap_once)


def _trim_meta(text: Column) -> Column:
    return _unwrap_once(strip(F.regexp_replace(text, IGNORE_CASE + _TRAILING_META, "")))


def clean_generated(content: Column) -> Column:
    """Generated text on one line, without fences, list markers and length notes."""
    kept = F.filter(
        F.transform(lines(content), strip),
        lambda x: (x != "")
        & ~matches(x, fixed.CODE_FENCE_PATTERN)
        & ~matches(x, _META_LINE),
    )
    bare = F.transform(
        kept, lambda x: strip(F.regexp_replace(x, "(?U)" + fixed.LIST_MARKER_PATTERN, ""))
    )
    text = F.array_join(F.filter(bare, lambda x: x != ""), " ")
    return F.when(
        content != "", collapse(_repeat_until_stable(strip(text), lambda t: _trim_meta(t)))
    ).otherwise(content)


def split_reasoning(content: Column) -> Column:
    """Content without inline reasoning traces, and the traces joined."""
    traces = F.filter(
        F.transform(F.regexp_extract_all(content, F.lit(_THINK), F.lit(1)), strip),
        lambda x: x != "",
    )
    return F.struct(
        strip(F.regexp_replace(content, _THINK, "")).alias("content"),
        null_if_empty(F.array_join(traces, "\n\n")).alias("reasoning"),
    )


def merge_reasoning(*parts: Column) -> Column:
    stripped = [null_if_empty(strip(p)) for p in parts]
    return null_if_empty(F.concat_ws("\n\n", *stripped))


def raw_if_different(raw: Column, content: Column) -> Column:
    """Raw response on one line, '' when it says the same as the content."""
    text = collapse(raw)
    same = F.lower(text) == F.lower(strip(text_or_empty(content)))
    return F.when(same, F.lit("")).otherwise(text)


def truncate_sentence(text: Column, limit: int = fixed.SENTENCE_LIMIT) -> Column:
    cut = F.concat(F.left(text, F.lit(limit)), F.lit(fixed.TRUNCATION_MARKER))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def compact_payload(payload: Column, limit: int | None = None) -> Column:
    """Payload text, or its head and original length when it exceeds a given limit."""
    if limit is None:
        return payload
    cut = F.to_json(
        F.struct(
            F.left(payload, F.lit(limit)).alias("_truncated_json"),
            F.length(payload).alias("_original_length"),
        )
    )
    return F.when(F.length(payload) > limit, cut).otherwise(payload)


def first_paragraph(extract: Column) -> Column:
    """First line with text, or null."""
    trimmed = F.transform(F.split(extract, "\n"), strip)
    return F.try_element_at(F.filter(trimmed, lambda x: x != ""), F.lit(1))


def words(text: Column) -> Column:
    return find_all(text, fixed.WORD_PATTERN, flags="")
