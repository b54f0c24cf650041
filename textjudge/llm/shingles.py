"""Hashed word shingles of many texts at once, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

# fixed values of 64-bit mixing steps (odd multipliers) and of the rolling sum over bytes
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: bytes handled at once; one longer text is a batch of its own
BATCH = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to 2**bits places."""
    size = 1 << bits
    base, inverse = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word in lower-case bytes."""
    blank = np.concatenate(([True], BLANK[data], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mixed(words + (ends - starts).astype(np.uint64) * PLACES[0])


def batches(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BATCH:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each UTF-8 text, as unsigned 64-bit hashes.

    A-Z count as lower case. A text with fewer words is one shingle, one without words has
    none.
    """
    out: list[np.ndarray] = []
    weights = PLACES[:words]
    for part in batches(texts):
        data = np.frombuffer(b"\n".join(part).lower(), np.uint8)
        starts, hashes = word_hashes(data)
        begin = np.cumsum([0, *(len(t) + 1 for t in part)])
        bounds = np.searchsorted(starts, begin)
        n = max(0, len(hashes) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += hashes[k : k + n] * weights[k]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                short = (hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mixed(np.array([short], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
