"""Benchmark decontamination by the q-gram lemma.

Texts are folded to lower-case letters and digits. Each benchmark item is cut into overlapping
segments; a region within ``e`` edits of a segment of L characters shares at least L + 1 - q - q*e
of its q-grams, all on diagonals that differ by no more than ``e``. Shared q-grams of a document
and a segment are counted in overlapping bands of 2e diagonals, one starting every e; bands that
meet the bound are verified by a banded alignment with free ends in the document. Nothing within
the budget is missed. A short segment's budget is lowered until its bound is one q-gram at least;
an item with fewer than ``Q`` letters and digits is only found as a whole document.

The index of the items' q-grams goes to every task. It is bounded: items are taken in blocks of
at most ``INDEX_CHARS`` characters, and a larger benchmark takes a pass for each block.

Defined results: null texts and items, and those without letters and digits, match nothing;
repeated rows of documents are each judged, null ids included, repeated items count once for each
id; items with a null id are left out; an empty benchmark rejects nothing, and an empty table gives
no row. Of equally good places of an item the first counts. A very long text is worked on alone.
All columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flatwords as fw
from . import pieces as px

Q = 8
SEGMENT = 100
#: Edits for each character of a segment.
BUDGET = 0.1
INDEX_CHARS = 4 << 20
_GAP = 40  # between documents, more than any budget
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """Code point to folded code point, 0 for what is left out."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x30000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[0x30000:0x40000] = np.arange(0x30000, 0x40000)  # further ideographs
    return table


_FOLD: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    codes = _FOLD[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    return codes[codes > 0]


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of Q codes."""
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64)
        for step in (1, 2, 4):
            if len(h) <= step:
                return np.empty(0, np.uint64)
            h = h[:-step] * np.uint64(pow(int(_BASE), step, 1 << 64)) + h[step:]
        return fw.mix(h)


class BenchmarkIndex:
    """Segments of the items and where their q-grams are."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item: list[int] = []
        self.codes: list[np.ndarray] = []
        self.whole: dict[bytes, set[int]] = {}
        for i, text in items:
            codes = fold(text or "")
            if len(codes) < Q:
                if len(codes):
                    self.whole.setdefault(codes.tobytes(), set()).add(i)
                continue
            starts = range(0, max(len(codes) - SEGMENT, 0) + 1, SEGMENT // 2)
            for s in {*starts, max(len(codes) - SEGMENT, 0)}:
                self.item.append(i)
                self.codes.append(codes[s : s + SEGMENT])
        grams = [_grams(c) for c in self.codes]
        n = [len(g) for g in grams]
        h = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.segment = np.repeat(np.arange(len(n)), n)[order]
        self.at = np.concatenate([np.empty(0, np.int64), *map(np.arange, n)]).astype(np.int64)[order]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum(np.floor(self.length * BUDGET).astype(np.int64), (self.length - Q) // Q)
        self.need = np.maximum(self.length + 1 - Q - Q * self.edits, 1)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.hash & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, folded position) of every text that holds an item's segment; the best for each item."""
        parts = [fold(t) for t in texts]
        short = [(d, i, 0, 0) for d, p in enumerate(parts) if 0 < len(p) < Q for i in self.whole.get(p.tobytes(), ())]
        return sorted(short + self._regions(parts)) if len(self.hash) else short

    def _regions(self, parts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        gap = np.zeros(_GAP, np.uint32)
        flat = np.concatenate([gap, *[x for p in parts for x in (p, gap)]])
        begin = _GAP + np.cumsum([0, *[len(p) + _GAP for p in parts]])[:-1]
        h = _grams(flat)
        p = np.flatnonzero(self.maybe[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.hash, h[p], "left")
        n = np.searchsorted(self.hash, h[p], "right") - lo
        p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
        if not len(p):
            return []
        k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seg, diagonal = self.segment[k], np.repeat(p, n) - self.at[k] + SEGMENT
        width = np.maximum(self.edits[seg], 1)
        band = diagonal // width
        found = []
        for shift in (0, 1):  # a diagonal is in two bands
            key = (band - shift) * len(self.item) + seg
            keys, count = np.unique(key, return_counts=True)
            s, b = keys % len(self.item), keys // len(self.item)
            good = count >= self.need[s]
            found.append(np.stack([s[good], b[good] * np.maximum(self.edits[s[good]], 1) - SEGMENT], 1))
        got = np.unique(np.concatenate(found), axis=0)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for s in np.unique(got[:, 0]).tolist():
            at = got[got[:, 0] == s, 1]
            edits, end = self._align(flat, s, at)
            for d, e, start in zip(np.searchsorted(begin, np.maximum(at + len(self.codes[s]) // 2, 0), "right").tolist(), edits.tolist(), at.tolist(), strict=True):
                if e <= self.edits[s] and d > 0:
                    key = (d - 1, self.item[s])
                    best[key] = min(best.get(key, (e, 1 << 60)), (e, max(start - int(begin[d - 1]), 0)))
        return [(d, i, *best[d, i]) for d, i in sorted(best)]

    def _align(self, flat: np.ndarray, s: int, at: np.ndarray) -> tuple[np.ndarray, None]:
        """Fewest edits between the segment and any stretch of the text on the band's diagonals."""
        codes, e = self.codes[s], int(self.edits[s])
        lanes = np.arange(2 * e + 1)
        cost = np.zeros((len(at), len(lanes)), np.int32)
        for i, c in enumerate(codes.tolist()):
            where = at[:, None] + i + lanes
            same = flat[np.clip(where, 0, len(flat) - 1)] == c
            step = cost + ~same
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the segment is left out
            cost = np.minimum.accumulate(step - lanes, axis=1) + lanes  # characters of the text are skipped
        return cost.min(axis=1), None


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[BenchmarkIndex]:
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = items.select(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // INDEX_CHARS))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else items
        yield BenchmarkIndex([(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, edits, position)`` for each document and item whose passage it holds."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), px.text_column(batch.column(1))
                for lo, hi in px.slices(texts, fw.SLICE_BYTES):
                    got = shared.value.leaks(texts.slice(lo, hi - lo).to_pylist())
                    if got:
                        d, i, e, at = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[lo + x] for x in d], pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(at, pa.int64())], ["doc_id", "item_id", "edits", "position"])

        found = docs.mapInArrow(px.releasing(scan), "doc_id long, item_id long, edits int, position long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = px.text_column(batch.column(at))
                stay = np.ones(len(texts), bool)
                for lo, hi in px.slices(texts, fw.SLICE_BYTES):
                    stay[[lo + d for d, *_ in shared.value.leaks(texts.slice(lo, hi - lo).to_pylist())]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(px.releasing(keep), docs.schema)
    return docs
