"""Words of many texts at once, as flat numpy arrays.

Texts are laid end to end in one byte buffer with a separator after each, words are found by a
256-entry table, and each word gets a 64-bit hash that does not depend on where it stands: a
prefix sum of ``value[byte] * B**position``, differenced at the word's ends and multiplied by
``B**-start`` (``B`` is odd, so it has an inverse modulo 2**64), then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_POW: dict[int, np.ndarray] = {}
#: Bytes that are worked on together; a longer text is worked on alone.
SLICE_BYTES = 1 << 19


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is 1 for the bytes of the given inclusive spans."""
    table = np.zeros(256, np.uint8)
    for lo, hi in spans:
        table[lo : hi + 1] = 1
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = 1 - byte_table((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over text whose A-Z are lower-cased
ALNUM_LOWER = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES_LOWER = _VALUES.copy()
_VALUES_LOWER[0x41:0x5B] = _VALUES[0x61:0x7B]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[base] = have if size <= 2 * SLICE_BYTES else _POW.get(base, have[: 1 << 16])
    return have[:n]


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z alone


class Words:
    """The words of some texts: ``start``, ``end`` (in ``buf``), ``doc`` and ``hash`` of each;
    ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, texts: Sequence[bytes], table: np.ndarray = NOT_SPACE, lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        self.buf = buf = np.frombuffer(self.data, np.uint8)
        is_word = table[buf]
        edge = np.flatnonzero(np.diff(is_word, prepend=np.uint8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        with np.errstate(over="ignore"):
            total = np.empty(len(buf) + 1, np.uint64)
            total[0] = 0
            np.cumsum((_VALUES_LOWER if lower else _VALUES)[buf] * _powers(_ODD, len(buf)), out=total[1:])
            inverse = _powers(pow(_ODD, -1, 1 << 64), len(buf))
            h = (total[self.end] - total[self.start]) * inverse[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def slices(texts: Sequence[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive hashes, by doubling."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        base, got, have, done = 0xA24BAED4963EE407, None, h, 1
        at, rest = 0, width
        while rest:
            if rest & 1:
                piece = have[at:]
                if got is None:
                    got = piece
                else:
                    n = min(len(got), len(piece))
                    got = got[:n] * np.uint64(pow(base, done, 1 << 64)) + piece[:n]
                at += done
            rest >>= 1
            if rest:
                have = have[:-done] * np.uint64(pow(base, done, 1 << 64)) + have[done:] if len(have) > done else have[:0]
                done *= 2
        return mix(got[: len(h) - width + 1] + np.uint64(width))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` consecutive values, the leftmost on ties."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        size += step
    return best[:n]


def binary_texts(column) -> list[bytes]:
    """Bytes of an Arrow string column; a null is an empty text."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("") if not pa.types.is_null(column.type) else pa.array([""] * len(column))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
