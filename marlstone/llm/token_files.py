"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Blocks of 1024 ids subtract their minimum and pack
the rest at a width that 98 per cent of them fit; the others are listed with their places. An
index of block starts lets a reader decode any range alone.

    bytes 0-3 "PFR1", then little-endian: ids (u64), blocks (u32), start of each block (u64)
    block: ids (u16), width (u8), exceptions (u16), minimum (u32), packed bits in 32-bit words,
           places of exceptions (u16 each), their values less the minimum (u32 each)

Files lie as binary cells of a Parquet table in the shared folder, so Spark's own commit protects
them when executors are lost and any store that Spark writes to will do. Documents are dealt by
ranges of their id, so shards and the files in them ascend; a file is closed at about a million
ids, at a document's end. Offsets come from sums of shards and of the files within each shard.

Encoding uses the ``tokenizers`` library. Its pre-tokeniser splits text before any merge, so pieces
of plain text are found in flat arrays of character classes, encoded once and remembered; a text
with a character whose class Unicode has changed or added since version 3.2, or with an added
token's string, goes to the library whole.

Defined results: a null or empty text has only the end id; a null document id sorts first; rows
that repeat an id are ordered by a hash of the text, then by text, and each kept, so that they can
lie in several shards. An empty table gives no file and no row. Other columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pieces as px
from .workspace import fresh_path

BLOCK = 1024
FIT = 0.98
FILE_IDS = 1 << 20
MAGIC = b"PFR1"
_HEAD = struct.Struct("<HBHI")
#: A character that is in no plain text.
_JOIN = "\0"
#: Classes of characters to the pre-tokeniser: letter, digit, white space, any other; not known here.
LETTER, DIGIT, SPACE, OTHER, UNKNOWN = range(5)


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each character; those of the same general category in Unicode 3.2 and now are
    known. White space beyond blank, tab and line ends is left to the library."""
    kind = np.full(0x110000, UNKNOWN, np.uint8)
    for c in range(0x110000):
        now = unicodedata.category(char := chr(c))
        if now != unicodedata.ucd_3_2_0.category(char) or now[0] in "ZC":
            continue
        kind[c] = LETTER if now[0] == "L" else DIGIT if now[0] == "N" else OTHER
    kind[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    return kind


@functools.cache
def byte_chars() -> np.ndarray:
    """The character that spells each byte in a byte-level vocabulary: the byte's own if it prints,
    else one of those from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    out = np.empty(256, "<u4")
    out[own] = own
    out[np.setdiff1d(np.arange(256), own)] = 256 + np.arange(256 - len(own))
    return out


def pack_blocks(ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    ids = ids.astype(np.uint32, copy=False)
    blocks = -(-len(ids) // BLOCK)
    parts: list[bytes] = [b""] * blocks
    full = len(ids) // BLOCK
    if full:
        _pack_equal(ids[: full * BLOCK].reshape(full, BLOCK), parts, 0)
    if blocks > full:
        _pack_equal(ids[full * BLOCK :][None, :], parts, full)
    head = 16 + 8 * blocks
    starts = head + np.cumsum([0, *map(len, parts)])[:-1]
    return MAGIC + struct.pack("<QI", len(ids), blocks) + starts.astype("<u8").tobytes() + b"".join(parts)


def _pack_equal(rows: np.ndarray, parts: list[bytes], at: int) -> None:
    n = rows.shape[1]
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    fits = np.partition(rest, int(FIT * (n - 1)), axis=1)[:, int(FIT * (n - 1))]
    width = np.frexp(fits.astype(np.float64))[1]  # of 0: 0
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        for lo in range(0, len(mine), 128):
            i = mine[lo : lo + 128]
            kept = rest[i]
            over = kept > np.uint32((1 << w) - 1)
            row, place = np.nonzero(over)
            places, values = place.astype("<u2").tobytes(), kept[row, place].astype("<u4").tobytes()
            kept[row, place] = 0
            packed = _to_words(kept, w)
            size, packed = packed.shape[1] * 4, packed.tobytes()
            cut = np.searchsorted(row, np.arange(len(i) + 1)).tolist()
            for k, (b, least) in enumerate(zip(i.tolist(), low[i].tolist(), strict=True)):
                p, q = cut[k], cut[k + 1]
                parts[at + b] = b"".join((_HEAD.pack(n, w, q - p, least), packed[k * size : (k + 1) * size], places[2 * p : 2 * q], values[4 * p : 4 * q]))


def unpack_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (all, if left out)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    total, blocks = struct.unpack_from("<QI", data, 4)
    starts = np.frombuffer(data, "<u8", blocks, 16).tolist()[first:last]
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    out = [np.empty(h[0], np.uint32) for h in heads]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault(h[:2], []).append(i)
    for (n, w), mine in groups.items():
        size = -(-n // 32) * w * 4
        for lo in range(0, len(mine), 128):
            part = mine[lo : lo + 128]
            raw = np.stack([np.frombuffer(data, "<u4", size // 4, starts[i] + _HEAD.size) for i in part])
            values = _from_words(raw, n, w)
            for i, row in zip(part, values, strict=True):
                odd, low = heads[i][2:]
                if odd:
                    at = starts[i] + _HEAD.size + size
                    row[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
                out[i] = row + np.uint32(low)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _to_words(rows: np.ndarray, w: int) -> np.ndarray:
    """Each row's numbers, ``w`` bits of each, in 32-bit words; 32 numbers fill ``w`` words."""
    n = rows.shape[1]
    padded = np.zeros((len(rows), -(-n // 32) * 32), np.uint32)
    padded[:, :n] = rows
    lanes = padded.reshape(len(rows), -1, 32)
    out = np.zeros((*lanes.shape[:2], w), np.uint32)
    for j in range(32 if w else 0):
        word, shift = divmod(j * w, 32)
        out[:, :, word] |= lanes[:, :, j] << np.uint32(shift)
        if shift + w > 32:
            out[:, :, word + 1] |= lanes[:, :, j] >> np.uint32(32 - shift)
    return out.astype("<u4").reshape(len(rows), -1)


def _from_words(words: np.ndarray, n: int, w: int) -> np.ndarray:
    lanes = -(-n // 32)
    out = np.zeros((len(words), lanes, 32), np.uint32)
    words = words.reshape(len(words), lanes, w)
    mask = np.uint32((1 << w) - 1)
    for j in range(32 if w else 0):
        word, shift = divmod(j * w, 32)
        got = words[:, :, word] >> np.uint32(shift)
        if shift + w > 32:
            got |= words[:, :, word + 1] << np.uint32(32 - shift)
        out[:, :, j] = got & mask
    return out.reshape(len(words), -1)[:, :n].copy()


def cut_pieces(chars: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pieces start in plain text; ``heads`` are the places of each text's first character.

    A piece is a run of one class, with the blank before it. White space before another character
    goes up to its last one, which stands alone unless it is such a blank. An apostrophe that
    starts a piece takes the ending of a contraction along, and that is a piece.
    """
    n = len(chars)
    first = np.zeros(n + 1, bool)
    first[heads] = first[n] = True
    space, blank = kind == SPACE, chars == 0x20
    before = np.concatenate(([OTHER], kind[:-1]))
    changed = (kind != before) | first[:-1]
    glued = np.concatenate(([False], blank[:-1])) & ~first[:-1]  # a blank stands right before
    last_space = space & ~np.concatenate((space[1:], [True])) & ~first[1:]
    start = np.where(space, changed | last_space, changed & ~glued)
    at = np.flatnonzero(start[:-1] & (chars[:-1] == 0x27))
    room = np.minimum(at + 2, n - 1)
    one, two = chars[at + 1], chars[room]
    same = ~first[at + 1]
    short = same & np.isin(one, [ord(c) for c in "stmd"])
    long = same & (at + 2 < n) & ~first[room] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    start[at[short | long] + 1] = False
    end = np.concatenate((at[short] + 2, at[long] + 3))
    start[end[end < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of string columns: one after another, and how many each text has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        state = self.tokenizer.pre_tokenizer.__getstate__() if kind == "ByteLevel" else b""
        self.split = kind == "ByteLevel" and b'"add_prefix_space":false' in state and b'"use_regex":true' in state and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab, model = self.tokenizer.get_vocab(), self.tokenizer.model
        self.split &= isinstance(model, models.BPE) and not (model.continuing_subword_prefix or model.end_of_word_suffix) and all(map(vocab.__contains__, map(chr, byte_chars().tolist())))
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # in bytes: a token spells each as a character
        self.width[[*vocab.values()]] = [len(t) for t in vocab]
        self.memo = px.Known(self._pieces)
        if self.split:  # for pieces that are cut and spelled already, which a mark in no piece joins
            self.of_pieces = Tokenizer.from_file(path)
            self.of_pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_JOIN)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def _pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces. A hundred are encoded as one text, and the bytes that each id spells tell
        where the next piece begins."""
        data, at = px.buffers(new)
        spelled = np.full(len(data) + len(new), ord(_JOIN), "<u4")
        own = np.ones(len(spelled), bool)
        own[at[1:] + np.arange(len(new))] = False
        spelled[own] = byte_chars()[data]
        text = spelled.tobytes().decode("utf-32-le")
        edge = (at + np.arange(len(at)))[[*range(0, len(new), 100), len(new)]].tolist()
        flat = self._joined([np.array(e.ids, np.int32) for e in self.of_pieces.encode_batch_fast([text[a : b - 1] for a, b in zip(edge, edge[1:])], add_special_tokens=False)])
        ends = np.concatenate(([0], np.cumsum(self.width[flat])))
        last = np.searchsorted(ends, at)
        if ends[-1] != at[-1] or (ends[last] != at).any():
            raise ValueError("ids of a piece don't spell it")
        return flat, np.diff(last)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.split:
            return self._whole(column)
        other = np.zeros(len(column), bool)
        for a in self.added:
            other |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        data, at = px.buffers(column)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # of characters, in bytes
        heads = np.searchsorted(begins, at)  # of texts, in characters
        kind = char_classes()[chars]
        other[np.searchsorted(heads, np.flatnonzero(kind == UNKNOWN), "right") - 1] = True
        if other.any():
            return self._mixed(column, other)
        if not len(chars):
            return np.empty(0, np.int32), np.zeros(len(column), np.int64)
        starts = cut_pieces(chars, kind, heads[:-1][np.diff(heads) > 0])
        pieces = px.cut_texts(data, begins[starts], len(data))
        return self.memo.ids(pieces, np.diff(np.searchsorted(starts, heads)))

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = self._library(column.to_pylist())
        return self._joined(got), np.array([len(x) for x in got], np.int64)

    def _mixed(self, column: pa.Array, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain texts by their pieces, the others whole, in the order of the rows."""
        order = np.concatenate((np.flatnonzero(~other), np.flatnonzero(other)))
        plain, whole = self(column.filter(pa.array(~other))), self._whole(column.filter(pa.array(other)))
        count = np.empty(len(column), np.int64)
        count[order] = n = np.concatenate((plain[1], whole[1]))
        first = np.empty(len(column), np.int64)
        first[order] = np.cumsum(n) - n
        return px.gather(np.concatenate((plain[0], whole[0])), first, count), count


_ENCODERS: dict[str, Encoder] = {}


def _writer(path: str, end_id: int):
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        shard, number = TaskContext.get().partitionId(), 0
        ids, counts, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = [[shard], [number], pa.concat_arrays(ids), np.concatenate(counts), [size], [pack_blocks(np.concatenate(held))]]
            return pa.RecordBatch.from_arrays([pa.array([v] if 1 < i < 4 else v, f.type) for i, (v, f) in enumerate(zip(row, _FILE_SCHEMA, strict=True))], schema=_FILE_SCHEMA)

        for batch in batches:
            column, doc_ids = px.text_column(batch.column(1)), batch.column(0)
            for lo, hi in px.slices(column):
                flat, n = encoder(column.slice(lo, hi - lo))
                flat, n = px.with_ends(flat, n, end_id), n + 1
                total, at = np.cumsum(n), 0
                while at < len(n):  # up to the document that fills the file, or all
                    begun = total[at - 1] if at else 0
                    to = min(int(np.searchsorted(total, begun + FILE_IDS - size)) + 1, len(n))
                    ids.append(doc_ids.slice(lo + at, to - at))
                    counts.append(n[at:to])
                    held.append(flat[begun : total[to - 1]].astype(np.uint32))
                    size += int(total[to - 1] - begun)
                    at = to
                    if size >= FILE_IDS:
                        yield close()
                        ids, counts, held, size, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    return write


_FILES = "shard int, file int, doc_ids array<long>, counts array<long>, n_ids long, data binary"
_FILE_SCHEMA = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts, an end id after each, into files in ascending id order; returns their folder."""
    path = path or fresh_path(docs.sparkSession, "token-files")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    files = docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(_writer(tokenizer_path, end_id), _FILES)
    files.write.option("compression", "uncompressed").parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, counts, start, data = (batch.column(i)[row].as_py() for i in range(4))
            tokens = unpack_blocks(data)
            ends = np.cumsum(counts)
            if len(tokens) != ends[-1]:
                raise ValueError("a token file is damaged: its ids don't add up")
            raw = tokens.astype("<u4").tobytes()
            begins = ends - counts
            parts = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(counts, pa.int64()), pa.array(parts, pa.binary()), pa.array([zlib.crc32(p) for p in parts], pa.int64())], ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids, ids_crc32)`` for each document of the files; ``ids`` are
    little-endian unsigned 32-bit integers, ``start`` counts the ids of all documents before."""
    files = spark.read.schema(_FILES).parquet(path)
    sizes = files.select("shard", "file", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_start"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("file")) - F.col("n_ids")
    starts = sizes.select("shard", "file", within.alias("file_start")).join(shards, "shard").select("shard", "file", (F.col("file_start") + F.col("shard_start")).alias("start"))
    return files.join(F.broadcast(starts) if starts_are_small(sizes) else starts, ["shard", "file"]).select("doc_ids", "counts", "start", "data").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


#: Files whose offsets may be broadcast (about 20 bytes each); beyond it they are shuffled.
BROADCAST_FILES = 100_000


def starts_are_small(sizes: DataFrame) -> bool:
    return sizes.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
