"""Secrets in text: fixed patterns, and windows of high Shannon entropy.

A candidate is a long run of key characters. Windows slide over it; the sum of c*log2(c)
over character counts is updated by the character that leaves and the one that enters, so
a run of any length costs constant work per character. Windows above the limit of their
own characters' class are joined to spans, so a name glued to a secret does not decide how
the secret is judged. An allow-list takes parts out that are known to be no secrets; what
the fixed patterns find is never suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame

from textjudge.llm.common import id_and_text, id_type, map_texts

DIGITS, LOWER, UPPER, HEX_DIGITS = string.digits, string.ascii_lowercase, string.ascii_uppercase, string.hexdigits
PART = re.compile(r"[A-Za-z0-9]+")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: '=' ends a candidate, and belongs to it only as padding at its end
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?|[A-Za-z0-9+/_-]{18,19}={1,2}(?![A-Za-z0-9+/_=-])")
#: words of a name, each in one case or with a capital first, and a number at the end; quantifiers
#: are possessive, so a long run is read once
NAME = r"(?:(?:[a-z]++|(?:[A-Z][a-z]++|[A-Z]{1,5}+(?![a-z])|[a-z]{2,}+)++)[0-9]{0,4}+|[0-9]{1,8}+)"


@dataclass(frozen=True)
class Windows:
    """Window length and least bits per character for each class of windows."""

    size: int = 20
    hex_bits: float = 3.0
    #: letters of one case with digits
    alnum_bits: float = 3.4
    #: letters of both cases with digits
    mixed_bits: float = 3.7
    #: letters of both cases without digits, with at least so many of either case: names in
    #: mixed case have few capitals
    letter_bits: float = 3.7
    each_case: int = 6
    #: candidates, or parts of them between joints, that are no secrets: identifiers,
    #: counted values, placeholders, slugs and paths of words, names in mixed case
    allow: tuple[str, ...] = (
        r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",
        r"[0-9._/=+-]+",
        r"(?i)[a-z0-9]*(example|placeholder|changeme|xxxx)[a-z0-9]*",
        rf"[-_/]*+{NAME}(?:[-_/]++{NAME})++[-_/]*+",
        r"(?:[a-z]++|[A-Z][a-z]{2,}+)(?:[A-Z][a-z]{2,}+){2,}+[0-9]{0,4}+",
    )


def window_limits(run: str, windows: Windows) -> list[float]:
    """Least bits of each window by the characters in it.

    Infinite for windows without letters, for letters of one case without digits, and for
    letters of both cases without digits where one case is rare.
    """

    def inside(chars: str) -> list[int]:
        sums = [0, *accumulate(c in chars for c in run)]
        return [b - a for a, b in zip(sums, sums[windows.size :])]

    limits = []
    for digit, lower, upper, hexa in zip(inside(DIGITS), inside(LOWER), inside(UPPER), inside(HEX_DIGITS)):
        if lower and upper:
            limit = windows.mixed_bits if digit else windows.letter_bits if min(lower, upper) >= windows.each_case else math.inf
        elif digit and (lower or upper):
            limit = windows.hex_bits if hexa == windows.size else windows.alnum_bits
        else:
            limit = math.inf
        limits.append(limit)
    return limits


def unlisted(run: str, allow: Sequence[re.Pattern]) -> list[tuple[int, int]]:
    """(start, end) of what is left of a candidate without what the allow-list matches.

    A pattern takes the whole candidate, or a part with letters that begins and ends at a
    joint; the rest is still scanned.
    """
    if any(p.fullmatch(run) for p in allow):
        return []
    gone = []
    starts = [m.start() for m in PART.finditer(run)]
    for p in allow:
        done = 0
        for start in starts:
            if start >= done and (m := p.match(run, start)) and m.end() > start:
                done = m.end()
                if not run[done : done + 1].isalnum() and any(c.isalpha() for c in m[0]):
                    gone.append((start, done))
    left, at = [], 0
    for start, end in [*sorted(gone), (len(run), len(run))]:
        if start > at:
            left.append((at, start))
        at = max(at, end)
    return left


def entropy_windows(run: str, size: int, least: float | Sequence[float]) -> list[tuple[int, int]]:
    """Joined (start, end) of the windows with at least ``least`` bits per character.

    ``least`` is one limit or one for each window.
    """
    if len(run) < size:
        return []
    limits = [least] * (len(run) - size + 1) if isinstance(least, float) else least
    log = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for k, char in enumerate(run):
        c = counts.get(char, 0)
        total += log[c + 1] - log[c] if c < size else 0.0
        counts[char] = c + 1
        if k >= size:
            gone = run[k - size]
            c = counts[gone]
            total += log[c - 1] - log[c] if c <= size else 0.0
            counts[gone] = c - 1
        start = k - size + 1
        if start >= 0 and math.log2(size) - total / size >= limits[start] - 1e-9:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((start, k + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy_spans(text: str, windows: Windows, allow: Sequence[re.Pattern]) -> list[tuple[int, int, str]]:
    found = []
    for m in CANDIDATE.finditer(text):
        for a, b in unlisted(m[0], allow):
            run, start = m[0][a:b], m.start() + a
            spans = entropy_windows(run, windows.size, window_limits(run, windows))
            found += [(start + first, start + last, "entropy") for first, last in spans]
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then by the order of the kinds."""
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan_secrets(docs: DataFrame, windows: Windows = Windows(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts by pattern, digest of the base spans, all spans.

    Positions are code points, ends exclusive. Null counts as empty text, which has no
    spans (the digest is that of the empty string). Repeated rows are scanned one by one;
    an empty table gives an empty result; other columns are not read. No shuffle.
    """
    allow = [re.compile(p) for p in windows.allow]

    def scan(text: str):
        base = base_spans(text)
        kinds = [s[2] for s in base]
        spans = joined(base + entropy_spans(text, windows, allow))
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        n_entropy = spans.count("entropy:")
        return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, spans, n_entropy

    schema = f"doc_id {id_type(docs, id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return map_texts(id_and_text(docs, id_col, text_col), scan, schema)
