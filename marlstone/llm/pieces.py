"""Token ids of many texts by their distinct pieces, as flat arrays and Arrow columns.

A batch of texts is one byte buffer; pieces are runs of it. Arrow's dictionary encoding finds the
distinct ones exactly, only those are encoded, and the ids of all texts are gathered from theirs.
Pieces met before are remembered up to a bound in bytes; results don't depend on it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose pieces are looked up together; a longer text is worked on alone.
SLICE_BYTES = 3 << 20
#: Bytes of pieces that a worker remembers, and of one piece: a text without spaces is one piece.
REMEMBERED_BYTES, PIECE_BYTES = 6 << 20, 64
#: Pieces that a worker finds by key, and slots for them: a power of two, twice as many at least.
KNOWN, SLOTS = 1 << 20, 1 << 21
#: By a piece's size in bytes: what of 16 bytes from its start is its own. Longer ones have no key.
_OWN_BITS = [0 if size > 15 else (1 << 8 * size) - 1 for size in range(17)]
_LOW, _HIGH = (np.array([m >> shift & (2**64 - 1) for m in _OWN_BITS], np.uint64) for shift in (0, 64))


def release() -> None:
    """Give back memory that this worker, which may have run other stages before, no longer uses."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, and then what it no longer uses is given back: workers live on into later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def text_column(column: pa.Array) -> pa.Array:
    """A plain string column; a null is an empty text."""
    if pa.types.is_null(column.type):
        return pa.array([""] * len(column), pa.string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts, with the end."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def cut_texts(data: np.ndarray, starts: np.ndarray, end: int) -> pa.Array:
    """Runs of ``data`` from each start to the next one."""
    at = np.append(starts, end)
    kind = (pa.large_binary(), np.int64) if end >= 2**31 else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind[0], len(starts), [None, pa.py_buffer(at.astype(kind[1])), pa.py_buffer(np.ascontiguousarray(data))])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes together."""
    at = buffers(column)[1]
    lo = 0
    while lo < len(column):
        hi = max(int(np.searchsorted(at, at[lo] + limit, "right")) - 1, lo + 1)
        yield lo, hi
        lo = hi


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, one after another."""
    total = int(count.sum())
    return flat[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)]


def with_ends(flat: np.ndarray, count: np.ndarray, end_id: int) -> np.ndarray:
    """The runs of ``flat`` with an end id after each."""
    out = np.full(len(flat) + len(count), end_id, flat.dtype)
    own = np.ones(len(out), bool)
    own[np.cumsum(count + 1) - 1] = False
    out[own] = flat
    return out


class Memo:
    """Ids of distinct pieces; ``encode`` gives those of new ones as ``(flat ids, counts)``."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.words = pa.array([], pa.binary())
        self.flat, self.count = np.empty(0, np.int32), np.empty(0, np.int64)

    def ids(self, pieces: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and how many each text has; ``per_text`` counts pieces."""
        if not len(pieces):
            return np.empty(0, np.int32), np.zeros(len(per_text), np.int64)
        codes = pieces.dictionary_encode()
        found = codes.dictionary.cast(pa.binary())
        at = pc.index_in(found, value_set=self.words)
        row = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = row < 0
        row[fresh] = len(self.words) + np.arange(int(fresh.sum()))
        new = found.filter(pa.array(fresh))
        new_flat, new_count = self.encode(new)
        flat, count = np.concatenate((self.flat, new_flat.astype(np.int32))), np.concatenate((self.count, new_count))
        first = np.cumsum(count) - count
        each = row[codes.indices.to_numpy()]
        n = count[each]
        ids = gather(flat, first[each], n)
        total = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_text)))]
        self._remember(new, found, row, flat, first, count)
        return ids, np.diff(total)

    def _remember(self, new: pa.Array, found: pa.Array, row: np.ndarray, flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        words = pa.concat_arrays([self.words, new])
        size = np.diff(buffers(words)[1])
        keep = size <= PIECE_BYTES
        if size[keep].sum() > REMEMBERED_BYTES:  # then those of this batch alone, as far as they go
            mine = np.zeros(len(words), bool)
            mine[row] = True
            keep &= mine
            keep &= np.cumsum(np.where(keep, size, 0)) <= REMEMBERED_BYTES
        at = np.flatnonzero(keep)
        self.words = words.take(pa.array(at)) if len(at) < len(words) else words
        self.flat, self.count = gather(flat, first[at], count[at]), count[at]


def keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each piece, its bytes and its size, that no other piece has; 0 if it is
    longer than 15 bytes."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 9, "<u8", padded, 0, 1)  # from each byte on
    size = np.minimum(np.diff(at), 16)
    high = eight[at[:-1] + 8] & _HIGH[size] | np.where(size < 16, size, 0).astype(np.uint64) << np.uint64(56)
    return eight[at[:-1]] & _LOW[size], high


class Known:
    """As ``Memo``, by a table with open addressing that grows in place: a key lies at its slot or
    one of the next. Pieces of more than 15 bytes are left to a ``Memo``."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], known: int = KNOWN, slots: int = SLOTS):
        self.encode, self.known, self.long = encode, known, Memo(encode)
        self.low, self.high, self.row = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.empty(slots, np.int32)
        self.first, self.count = np.empty(known, np.int64), np.empty(known, np.int64)
        self.clear()

    def clear(self) -> None:
        self.rows = self.used = 0
        self.row[:] = -1
        self.flat = np.empty(1 << 16, np.int32)

    def ids(self, pieces: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and how many each text has; ``per_text`` counts pieces."""
        if not len(pieces):
            return np.empty(0, np.int32), np.zeros(len(per_text), np.int64)
        codes = pieces.dictionary_encode()
        found = codes.dictionary.cast(pa.binary())
        low, high = keys(*buffers(found))
        row = self._find(low, high)
        old, long = np.flatnonzero(row >= 0), np.flatnonzero(high == 0)
        new = np.flatnonzero((row < 0) & (high != 0))
        had = self.count[row[old]]
        parts = [(gather(self.flat, self.first[row[old]], had), had), self.encode(found.take(pa.array(new))), self.long.ids(found.take(pa.array(long)), np.ones(len(long), np.int64))]
        flat, count = np.concatenate([p[0] for p in parts]).astype(np.int32, copy=False), np.concatenate([p[1] for p in parts])
        if self.rows + len(new) > self.known:  # then those of this batch alone, as far as they go
            self.clear()
            kept = np.concatenate((old, new))[: self.known]
            self._add(low[kept], high[kept], flat, count[: len(kept)])
        else:
            self._add(low[new], high[new], *parts[1])
        place = np.empty(len(row), np.int64)
        place[np.concatenate((old, new, long))] = np.arange(len(row))
        each = place[codes.indices.to_numpy()]
        runs = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(4 * count)))), pa.py_buffer(flat)])
        ids = buffers(runs.take(pa.array(each)))[0].view(np.int32)
        total = np.concatenate(([0], np.cumsum(count[each])))[np.concatenate(([0], np.cumsum(per_text)))]
        return ids, np.diff(total)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low * np.uint64(0x9E3779B97F4A7C15) ^ high) * np.uint64(0xFF51AFD7ED558CCD)
        return ((h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(65 - len(self.row).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        out, rest, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(rest):
            row = self.row[slot]
            same = (row >= 0) & (self.low[slot] == low[rest]) & (self.high[slot] == high[rest])
            out[rest[same]] = row[same]
            on = ~same & (row >= 0)
            rest, slot = rest[on], slot[on] + 1 & len(self.row) - 1
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """Remember keys that have no row yet, and their ids, the first of ``flat``."""
        rows, ids = self.rows + len(low), self.used + int(count.sum())
        if ids > len(self.flat):
            more = np.empty(max(ids, 2 * len(self.flat)), np.int32)
            more[: self.used] = self.flat[: self.used]
            self.flat = more
        self.flat[self.used : ids] = flat[: ids - self.used]
        self.first[self.rows : rows], self.count[self.rows : rows] = self.used + np.cumsum(count) - count, count
        mine, slot = np.arange(self.rows, rows, dtype=np.int32), self._slot(low, high)
        self.rows, self.used = rows, ids
        while len(mine):
            free = self.row[slot] < 0
            self.row[slot[free]] = mine[free]
            won = self.row[slot] == mine  # of the keys at one free slot one gets it, the others go on
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            low, high, mine, slot = low[~won], high[~won], mine[~won], slot[~won] + 1 & len(self.row) - 1
