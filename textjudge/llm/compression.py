"""Quality rules from compression: zstandard ratios of whole texts and fixed chunks.

Repetitive text compresses too well, random text hardly at all. How well clean prose
compresses depends on its length, so every band of lengths has its own limits.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from textjudge.llm.common import SPACES, id_and_text, id_type, map_texts, small_batches

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of bytes / compressed bytes. A text belongs to the first band it fits in.

    Low limits lie between random base64 words and clean text of that length. Below 112
    bytes the two have the same ratios, so nothing but the old floor is asked for there.
    """

    #: (bytes below, least whole ratio, most whole ratio); the last band is open
    whole: tuple[tuple[float, float, float], ...] = (
        (112, 0.70, 3.5),
        (160, 1.05, 3.5),
        (256, 1.15, 3.5),
        (512, 1.25, 4.0),
        (1024, 1.35, 4.0),
        (4096, 1.50, 4.5),
        (16384, 1.58, 5.5),
        (float("inf"), 1.58, 8.0),
    )
    #: (bytes below, least ratio) where three-byte characters make up more than dense_share
    #: of the bytes: such scripts leave fewer repeats to find
    dense: tuple[tuple[float, float], ...] = ((256, 0.70), (1024, 1.08), (4096, 1.25), (16384, 1.38), (float("inf"), 1.40))
    dense_share: float = 0.5
    chunk_bytes: int = 2048
    #: limits for one full chunk, and the share of bytes in bad chunks that rejects a text
    chunk_low: float = 1.50
    chunk_high: float = 5.0
    chunk_share: float = 0.25
    #: a shorter rest is part of the chunk before it
    rest_bytes: int = 112
    level: int = 3


def ratio(data: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(data) / len(packer.compress(data)) if data else 0.0


def least_ratio(data: bytes, bands: Bands) -> float:
    """Low limit for a text or chunk of this length and script."""
    dense = 3 * np.count_nonzero(np.frombuffer(data, np.uint8) >= 0xE0) > bands.dense_share * len(data)
    return next(b[1] for b in (bands.dense if dense else bands.whole) if len(data) < b[0])


def chunks(data: bytes, step: int, rest: int) -> list[bytes]:
    """Full chunks and the rest; a rest below ``rest`` bytes lengthens the last full one."""
    if len(data) < step:
        return []
    starts = list(range(0, len(data), step))
    if len(data) - starts[-1] < rest:
        starts.pop()
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]


def band_verdict(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, float, float, bool]:
    """Whole ratio, least and most chunk ratio, share of bytes in bad chunks, pass or not.

    A chunk is held against ``chunk_low`` or, if that is less, the low limit of its length;
    a text below one chunk is judged as a whole only.
    """
    whole = ratio(data, packer)
    high = next(hi for most, _, hi in bands.whole if len(data) < most)
    parts = chunks(data, bands.chunk_bytes, bands.rest_bytes)
    ratios = [ratio(p, packer) for p in parts]
    bad = sum(len(p) for p, r in zip(parts, ratios) if not min(bands.chunk_low, least_ratio(p, bands)) <= r <= bands.chunk_high)
    share = bad / len(data) if parts else 0.0
    good = bool(least_ratio(data, bands) <= whole <= high and share < bands.chunk_share)
    return whole, min(ratios, default=whole), max(ratios, default=whole), share, good


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    if len(words) < size + 1:
        return 0
    windows = list(zip(*(words[k:] for k in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + len(starts)] |= starts
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def compression_rules(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with counts, ratios and the verdict.

    Null counts as empty text. A text without words fails; repeated rows are judged one by
    one; an empty table gives an empty result; other columns are not read. Every text is
    compressed whole, in one task, row by row: no shuffle.
    """

    def judge(text: str):
        packer = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        data = text.encode()
        words = data.split()
        spaces = sum(map(text.count, SPACES))
        repeats = repeated_words(words)
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        whole, least, most, share, good = band_verdict(data, bands, packer)
        return (
            len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats,
            failed, good and not failed, whole, least, most, share,
        )

    schema = (
        f"doc_id {id_type(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, whole_ratio double, least_chunk_ratio double, most_chunk_ratio double, bad_chunk_share double"
    )
    return map_texts(id_and_text(docs, id_col, text_col), judge, schema)


def keep_good(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged and with all their columns.

    The verdict is added batch by batch to the row itself, so no join is needed and rows
    that share an id are judged one by one.
    """
    names = docs.columns
    number = names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        for batch in batches:
            for part in small_batches(batch):
                keep = []
                for text in part.column(number).to_pylist():
                    data = (text or "").encode()
                    words = data.split()
                    failed = len(words) < 10 or 100 * repeated_words(words) > 20 * len(words)
                    keep.append(not failed and band_verdict(data, bands, packer)[-1])
                yield part.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
