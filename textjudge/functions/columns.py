"""Small Column helpers shared by all function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java needs the flags spelled out to match letters the way a Unicode-aware,
# case-insensitive pattern does: i = ignore case, U = Unicode classes and case.
IGNORE_CASE = "(?iU)"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def matches(text: Column, pattern: str, flags: str = IGNORE_CASE) -> Column:
    return F.rlike(text, F.lit(flags + pattern))


def find_all(text: Column, pattern: str, group: int = 0, flags: str = IGNORE_CASE) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def find(text: Column, pattern: str, group: int = 0, flags: str = IGNORE_CASE) -> Column:
    return F.regexp_extract(text, flags + pattern, group)


def first_rule(*rules: tuple[Column, Column], otherwise: Column) -> Column:
    """Ordered decision list: the value of the first rule that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of ``key`` in a small fixed table, as one literal map expression."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    value = F.try_element_at(F.create_map(*pairs), key)
    return value if default is None else F.coalesce(value, default)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def collapse(text: Column) -> Column:
    """Trim and reduce every run of white space to one blank."""
    return F.trim(F.regexp_replace(text_or_empty(text), r"(?U)\s+", " "))


# white space that trimming removes
SPACE = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for a ``body`` that refers to it several times.

    Inside higher-order functions repeated sub-expressions are evaluated repeatedly;
    a one-element array makes the value a lambda variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """Quotient as double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
