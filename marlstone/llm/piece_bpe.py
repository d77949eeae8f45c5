"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The text is escaped as the model's normaliser does (a leading mark, spaces as marks) and cut
before each run of marks that follows another character; no piece has a mark after another
character, so no merge crosses such a cut. Distinct words are encoded together: one flat array of
symbols, the best-ranked adjacent pair of each word by a segmented minimum, its leftmost
occurrences merged at once, the array compacted, until no word has a pair left.

The library merges one pair at a time. A round does the same: the occurrences of the pair are
taken from the left up to the first one whose new neighbours form a pair at least as good, which
the library would take next; what lies to its right waits for a later round.

The vocabulary file is a parameter; nothing is learned here.

Defined results: a null text counts as empty, and an empty text has the end id alone. Repeated
rows are each encoded. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as px

MARK = "▁"
#: The rank of no pair.
_NONE = np.int32(2**31 - 1)
#: Bytes of distinct words that are merged together; a longer word is merged alone.
ROUND_BYTES = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A SentencePiece BPE model with byte fallback and the identity normaliser."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        norm = {}
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(got[1].decode())
                self.scores.append(float(np.frombuffer(got[2], "<f4")[0]) if 2 in got else 0.0)
                self.kinds.append(got.get(3, self.NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind != 2:
                    raise ValueError("not a BPE model")
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("only the identity normaliser with a leading mark is known")
        if self.USER in self.kinds or self.UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not known")
        self.size = len(self.pieces)
        self.end_id = self.pieces.index("</s>")
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == self.BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("pieces hold a mark after another character: words can't be cut")
        #: a character's symbol: its piece, or else a number beyond the pieces
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[0x20] = self.of_char[ord(MARK)]  # texts keep their spaces here
        order = sorted(set(-self.scores[i] for i in ids.values()))
        place = {s: r for r, s in enumerate(order)}
        self.rank = np.array([place.get(-s, 0) for s in self.scores], np.int32)
        symbol = lambda s: ids.get(s, int(self.of_char[ord(s)]) if len(s) == 1 else -1)
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a >= 0 and b >= 0:
                    pairs[a * (self.size + 0x110000) + b] = i
        self._table(np.array(sorted(pairs), np.int64), np.array([pairs[k] for k in sorted(pairs)], np.int32))
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if k == self.BYTE else p.replace(MARK, " ").encode() if k == self.NORMAL else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _table(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """A hash table of pairs with open addressing: a key lies at its slot or one of the next."""
        bits = max(len(keys), 1).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.slot_keys, self.slot_ids = np.full((1 << bits) + len(keys), -1, np.int64), np.full((1 << bits) + len(keys), -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            # of the keys at one free slot the first gets it, the others go on
            free = self.slot_keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.slot_keys[slot[won]], self.slot_ids[slot[won]] = keys[won], ids[won]
            keys, ids, slot = keys[~won], ids[~won], slot[~won] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 where there is none."""
        key = left.astype(np.int64) * (self.size + 0x110000) + right
        slot = self._slot(key)
        have = self.slot_keys[slot]
        out = np.where(have == key, self.slot_ids[slot], np.int32(-1))
        rest = np.flatnonzero((have != key) & (have >= 0))
        slot = slot[rest]
        while len(rest):
            slot = slot + 1
            have = self.slot_keys[slot]
            same = have == key[rest]
            out[rest[same]] = self.slot_ids[slot[same]]
            on = ~same & (have >= 0)
            rest, slot = rest[on], slot[on]
        return out

    def _ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[merged], _NONE)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word on its own."""
        flat, count = self.encode(pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary()))
        return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] if words else []

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word on its own, one after another, and how many each has."""
        parts = [self._encode(words.slice(lo, hi - lo)) for lo, hi in px.slices(words, ROUND_BYTES)]
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = px.buffers(words)
        chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        length = np.diff(heads[at])  # in characters
        home = np.cumsum(length) - length
        flat, count = np.empty(len(chars), np.int32), length.copy()
        alive = np.flatnonzero(length)  # words with a symbol yet, and the size of each
        size = length[alive]
        sym, word = self.of_char[chars].astype(np.int32), np.repeat(np.arange(len(words), dtype=np.int32), length)
        rank = np.full(len(sym), _NONE, np.int32)
        rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(self._merged(sym[:-1], sym[1:])), _NONE)
        while len(alive):
            cut = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, cut)
            ended = best == _NONE
            keep = np.ones(len(sym), bool)
            if ended.any():
                gone = np.repeat(ended, size)
                w, k = alive[ended], size[ended]
                flat[np.repeat(home[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())], count[w] = sym[gone], k
                keep = ~gone
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[rank[at] != _NONE]
            if len(at):
                at = self._turn(sym, word, at)
                sym[at] = self._merged(sym[at], sym[at + 1])
                keep[at + 1] = False
                size = size - np.bincount(np.searchsorted(cut, at, "right") - 1, minlength=len(size))
            place = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            alive, size = alive[~ended], size[~ended]
            new = place[at]
            for i in (new, new[new > 0] - 1):
                j = np.minimum(i + 1, len(sym) - 1)
                rank[i] = np.where((i + 1 < len(sym)) & (word[j] == word[i]), self._ranks(self._merged(sym[i], sym[j])), _NONE)
        flat = px.gather(flat, home, count)
        return self._bytes(flat, count)

    def _turn(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those places of the best rank of their words that are merged in this round."""
        # a row of overlapping places: every second one, from the left
        head = np.concatenate(([True], np.diff(at) != 1))
        at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]
        made = self._merged(sym[at], sym[at + 1])
        # new neighbours as they stand when this place's turn has come
        beside = np.concatenate(([False], (at[1:] - at[:-1] == 2) & (word[at[1:]] == word[at[:-1]])))
        before = np.maximum(at - 1, 0)
        left = np.where(beside, np.concatenate(([-1], made[:-1])), sym[before])
        after = np.minimum(at + 2, len(sym) - 1)
        own = self.rank[made]
        better = (at > 0) & (word[before] == word[at]) & (self._ranks(self._merged(left, made)) <= own)
        better |= (at + 2 < len(sym)) & (word[after] == word[at]) & (self._ranks(self._merged(made, sym[after])) <= own)
        if not better.any():
            return at
        seen = np.cumsum(better) - better
        first = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
        return at[seen == seen[first][np.cumsum(first) - 1]]  # nothing better arose further left

    def _bytes(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their bytes."""
        odd = flat >= self.size
        if not odd.any():
            return flat, count
        code = flat[odd] - self.size
        n = np.ones(len(flat), np.int64)
        n[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        raw = np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        out = np.repeat(flat, n)
        out[np.repeat(odd, n)] = self.byte_ids[raw]
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(count)))]
        return out, np.diff(ends)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first leading space goes, bytes that aren't UTF-8 are replaced."""
        return b"".join([self.bytes_of[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def cut_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each text, with the leading space that the model puts before a text, and how
    many each text has. A mark in a text is a space to the model."""
    if pc.any(pc.match_substring(column, MARK)).as_py():
        column = pc.replace_substring(column, MARK, " ")
    empty = pc.equal(pc.binary_length(column), 0)
    column = pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)))
    data, at = px.buffers(column)
    space = data == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(head)
    return px.cut_texts(data, starts, len(data)), np.diff(np.searchsorted(starts, at))


class Encoder:
    """Ids and decoded texts of string columns."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.memo = px.Memo(self.model.encode)
        self.decimal = pa.array([str(i) for i in range(self.model.size)])
        whole = self.model.bytes_of
        self.spelled = pa.array([*whole, *(b.removeprefix(b" ") for b in whole)], pa.binary())  # the second half: at a text's start

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text: the number of ids, the ids in decimal, and the text that they decode to."""
        flat, count = self.memo.ids(*cut_words(column))
        ids = px.with_ends(flat, count, self.model.end_id)
        count = count + 1
        ends = np.concatenate(([0], np.cumsum(count)))
        kind, offsets = (pa.LargeListArray, ends) if len(ids) >= 2**31 else (pa.ListArray, ends.astype(np.int32))
        listed = pc.binary_join(kind.from_arrays(pa.array(offsets), self.decimal.take(pa.array(ids))), " ")
        ids[ends[:-1]] += self.model.size
        text = pc.binary_join(kind.from_arrays(pa.array(offsets), self.spelled.take(pa.array(ids))), b"")
        try:
            text = text.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([b.decode("utf-8", "replace") for b in text.to_pylist()], pa.string())
        return count, listed, text


_ENCODERS: dict[str, Encoder] = {}


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        px.release()
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        for batch in batches:
            column = px.text_column(batch.column(1))
            for lo, hi in px.slices(column):
                n, ids, text = encoder(column.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), ids, text], ["doc_id", "n_tokens", "ids", "decoded"])

    return px.releasing(run)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: the ids of each whole text and an end id, in decimal
    and joined by spaces, and the text that they decode to."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(model_path), "doc_id long, n_tokens long, ids string, decoded string")
