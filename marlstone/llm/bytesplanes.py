"""Integers as byte planes: the high bytes of small numbers become runs of zeros, which the
shuffle's own compression removes, and reading back is a handful of vector operations."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers (any order) as a byte that counts planes and the planes."""
    values = values.astype(np.uint64, copy=False)
    most = int(values.max()) if len(values) else 0
    planes = (most.bit_length() + 7) // 8
    return bytes([planes]) + b"".join((values >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(planes))


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for i in range(data[0]):
        out |= np.frombuffer(data, np.uint8, n, 1 + i * n).astype(np.uint64) << np.uint64(8 * i)
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers as their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=np.uint64)
