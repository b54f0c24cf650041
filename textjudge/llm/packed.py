"""Numbers as compact bytes, for rows that carry many keys or values at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Numbers in the least whole number of bytes that holds the largest."""
    values = np.asarray(values, np.uint64)
    size = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([size]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(data: bytes) -> np.ndarray:
    size = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :size] = raw
    return wide.view("<u8").reshape(-1).astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Non-decreasing numbers: the first one, then packed differences."""
    values = np.asarray(values, np.uint64)
    return values[:1].astype("<u8").tobytes() + pack(np.diff(values)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data[:8], "<u8"), unpack(data[8:]))), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, none rounded: all first bytes, all second ones, ..., compressed.

    Neighbours share most of their high bytes, if sorted or small or of one magnitude.
    """
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueeze(data: bytes, kind: str = "<u8") -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(kind).reshape(-1)
