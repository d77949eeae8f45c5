"""Substring dedup over a log-structured fingerprint index.

A *window* is ``window`` consecutive words of one document. Every word covered by a window whose
word sequence starts earlier too is removed: in a document with a smaller id, or further up in the
same one.

The index keeps, for each bucket of the hash space, sorted immutable runs of the fingerprints of
all windows seen so far. A batch of documents is ingested in these steps:

1. Every task computes the windows of its documents. Windows are routed by an *anchor*, the
   ``gram``-word run of the window whose hash comes first in a scrambled order: equal windows have the same anchor at the
   same offset, and neighbouring windows mostly share one, so one record (anchor hash, document,
   position, 32 more bits for each window) carries about seven windows. Records that repeat within
   the task's slice of documents are settled there, so a passage that a third of all documents hold reaches a
   bucket once for each slice, not once for each document.
2. Each bucket merges the batch's windows, finds the earliest place of each, and merge-joins the
   distinct ones with the historical runs. Matches are verified on the whole fingerprint
   (64 + 32 bits and the offset; 72 bits against history), not word by word: among n windows a
   wrong match within a batch has a chance of about n * n / 2**97, one against history n * n / 2**73.
3. The batch's fingerprints and the bucket's old runs are compacted into one new run, written to
   the shared folder beside the positions that are covered.
4. Documents are joined with their covered positions by id and rewritten.

The number of buckets follows the size of the input, so a bucket's memory does not grow.

Defined results: a null or empty text has no words; a null id stands for one document smaller than
all others; texts with fewer than ``window`` words stay as they are but for their white space; rows
that repeat an id are each judged, and a place is never its own earlier copy, so exact repeats of a
row with the same id both stay. Columns other than the id and the text are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesplanes as planes
from . import flatwords as fw
from .workspace import fresh_path

WINDOW = 20
#: Words of an anchor.
GRAM = 8
#: Bytes of text whose windows are sent on together.
SLICE_BYTES = 4 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 32
NULL_ID = -(2**63)

_RECORDS = "bucket int, kind int, base long, n int, gram binary, doc binary, pos binary, off binary, cnt binary, ctx binary"
_FOUND = "kind int, bucket int, doc_id long, n int, blob binary"
_PLACE = np.dtype([("pos", "<i4"), ("gram", "<u4"), ("off", "u1"), ("mask", "<u2")])
_BATCH, _SETTLED, _HISTORY = 0, 1, 2
_COVERED, _RUN = 0, 1


def _anchors(words: fw.Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor in order: flat position, offset of its first window, number of its windows,
    its hash; then the low bits of the windows' hashes."""
    h = words.hash
    if len(h) < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.uint32))
    grams, whole = fw.window_hash(h, gram), fw.window_hash(h, window)
    with np.errstate(over="ignore"):
        order = fw.mix(grams + np.uint64(0x51ED270B9F1C3E55))  # the smallest hashes themselves would crowd into the first buckets
    at = fw.sliding_argmin(order, window - gram + 1)[: len(whole)]
    valid = np.flatnonzero(words.doc[: len(whole)] == words.doc[window - 1 :])
    if not len(valid):
        return _anchors(_NOTHING, window, gram)
    at = at[valid]
    lead = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(valid) != 1))))
    count = np.diff(np.append(lead, len(at)))
    p = at[lead]
    return p, p - valid[lead], count, grams[p], whole[valid].astype(np.uint32)


class _Nothing:
    hash = np.empty(0, np.uint64)


_NOTHING = _Nothing()


def _slice_rows(ids: np.ndarray, texts: list[bytes], window: int, gram: int, buckets: int) -> Iterator[dict]:
    """The records of one slice of documents, a row for each bucket, and what the slice settles itself."""
    got = []
    for lo, hi in fw.slices(texts):
        w = fw.Words(texts[lo:hi])
        p, off, cnt, g, ctx = _anchors(w, window, gram)
        if len(p):
            got.append((ids[lo:hi][w.doc[p]], p - w.first[w.doc[p]], off, cnt, g, ctx))
    if not got:
        return
    doc, pos, off, cnt, g, ctx = (np.concatenate(x) for x in zip(*got, strict=True))
    ends = np.cumsum(cnt)
    with np.errstate(over="ignore"):
        # records that agree in everything but their place
        within = np.arange(len(ctx)) - np.repeat(ends - cnt, cnt)
        spread = fw.mix(ctx.astype(np.uint64) + (within.astype(np.uint64) << np.uint64(40)))
        same = np.add.reduceat(spread, ends - cnt) + fw.mix(g ^ fw.mix((off * 64 + cnt).astype(np.uint64)))
    order = np.lexsort((pos, doc, same))
    head = np.concatenate(([True], same[order][1:] != same[order][:-1]))
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    again = (same[order] == same[leader]) & (g[order] == g[leader]) & ~head
    later = again & ((doc[order] != doc[leader]) | (pos[order] != pos[leader]))
    settled, rest = order[later], np.sort(order[~again])
    bucket = (g >> np.uint64(32)).astype(np.int64) * buckets >> 32
    if len(settled):
        yield from _place_rows(doc[settled], pos[settled], g[settled], off[settled], (1 << cnt[settled]) - 1, doc[settled] % buckets)
    by = rest[np.argsort(g[rest], kind="stable")]
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    start = ends - cnt
    base = int(doc.min())
    for b in np.flatnonzero(np.diff(cut)):
        i = by[cut[b] : cut[b + 1]]
        take = np.repeat(start[i], cnt[i]) + np.arange(cnt[i].sum()) - np.repeat(np.cumsum(cnt[i]) - cnt[i], cnt[i])
        yield {
            "bucket": int(b), "kind": _BATCH, "base": base, "n": len(i), "gram": planes.pack_sorted(g[i]), "doc": planes.pack((doc[i] - base).astype(np.uint64)), "pos": planes.pack(pos[i]),
            "off": planes.pack(off[i]), "cnt": planes.pack(cnt[i]), "ctx": ctx[take].tobytes(),
        }


def _place_rows(doc, pos, g, off, mask, bucket) -> Iterator[dict]:
    order = np.lexsort((pos, doc))
    place = np.empty(len(order), _PLACE)
    place["pos"], place["gram"], place["off"], place["mask"] = pos[order], g[order].astype(np.uint32), off[order], mask[order]
    doc, bucket = doc[order], bucket[order]
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    for lo, hi in zip(head, np.append(head[1:], len(doc)), strict=True):
        yield {"bucket": int(bucket[lo]), "kind": _SETTLED, "base": int(doc[lo]), "n": int(hi - lo), "gram": place[lo:hi].tobytes(), "doc": b"", "pos": b"", "off": b"", "cnt": b"", "ctx": b""}


def _rows_to_batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes)) + 64
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _emitter(window: int, gram: int, buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            ids, texts, size = [], [], 0
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), fw.binary_texts(batch.column(1)), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= SLICE_BYTES:
                        yield from _slice_rows(np.array(ids, np.int64), texts, window, gram, buckets)
                        ids, texts, size = [], [], 0
            if ids:
                yield from _slice_rows(np.array(ids, np.int64), texts, window, gram, buckets)

        yield from _rows_to_batches(rows(), _schema(_RECORDS))

    return emit


def _window_keys(g: np.ndarray, off: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return fw.mix(g ^ fw.mix(ctx.astype(np.uint64) | (off.astype(np.uint64) << np.uint64(32))))


def _merge_bucket(table: pa.Table, keep_run: bool) -> pa.Table:
    """Join one bucket's new records with its history; the covered places and the compacted run."""
    rows = table.to_pylist()
    out: list[dict] = []
    bucket = rows[0]["bucket"]
    out += [{"kind": _COVERED, "bucket": bucket, "doc_id": r["base"], "n": r["n"], "blob": r["gram"]} for r in rows if r["kind"] == _SETTLED]
    history = [np.empty(0, np.uint64)]
    checks = [np.empty(0, np.uint8)]
    for r in rows:
        if r["kind"] == _HISTORY:
            history.append(planes.unpack_sorted(r["gram"], r["n"]))
            checks.append(np.frombuffer(r["ctx"], np.uint8))
    old, old_check = np.concatenate(history), np.concatenate(checks)
    if len(history) > 2:
        by = np.argsort(old, kind="stable")
        old, old_check = old[by], old_check[by]
    new = [r for r in rows if r["kind"] == _BATCH]
    keys, check = np.empty(0, np.uint64), np.empty(0, np.uint8)
    if new:
        g = np.concatenate([planes.unpack_sorted(r["gram"], r["n"]) for r in new])
        doc = np.concatenate([planes.unpack(r["doc"], r["n"]).astype(np.int64) + r["base"] for r in new])
        pos, off, cnt = (np.concatenate([planes.unpack(r[k], r["n"]).astype(np.int64) for r in new]) for k in ("pos", "off", "cnt"))
        ctx = np.concatenate([np.frombuffer(r["ctx"], np.uint32) for r in new])
        del rows, new
        at = np.cumsum(cnt) - cnt
        by = np.lexsort((pos, doc))
        take = np.repeat(at[by], cnt[by]) + np.arange(len(ctx)) - np.repeat(np.cumsum(cnt[by]) - cnt[by], cnt[by])
        g, doc, pos, off, cnt, ctx = g[by], doc[by], pos[by], off[by], cnt[by], ctx[take]
        at = np.cumsum(cnt) - cnt
        owner = np.repeat(np.arange(len(g), dtype=np.int32), cnt)
        within = (np.arange(len(ctx)) - at[owner]).astype(np.int32)
        offs = off.astype(np.int32)[owner] - within
        key = _window_keys(g[owner], offs, ctx)
        order = np.argsort(key, kind="stable")  # by place within a key, as the records are
        head = _heads(order, key, g, owner, offs, ctx)
        if head is None:  # two windows share 64 bits: sort by all of them
            order = np.lexsort((ctx, offs, g[owner], key))
            head = _heads(order, key, g, owner, offs, ctx, exact=True)
        first = order[head]
        group = np.cumsum(head, dtype=np.int32) - 1
        lead = first[group]
        start = pos[owner] - offs
        covered = (doc[owner][order] != doc[owner][lead]) | (start[order] != start[lead])
        keys, check = key[first], (g[owner[first]] >> np.uint64(56)).astype(np.uint8)
        if len(old):
            j = np.minimum(np.searchsorted(old, keys), len(old) - 1)
            known = (old[j] == keys) & (old_check[j] == check)
            covered |= known[group]
        bits = np.zeros(len(ctx), np.int64)
        bits[order] = covered
        mask = np.add.reduceat(bits << within, at)
        hit = np.flatnonzero(mask)
        if len(hit):
            for r in _place_rows(doc[hit], pos[hit], g[hit], off[hit], mask[hit], np.zeros(len(hit), np.int64)):
                out.append({"kind": _COVERED, "bucket": bucket, "doc_id": r["base"], "n": r["n"], "blob": r["gram"]})
    if keep_run and len(old) + len(keys):
        keys, check = np.concatenate((old, keys)), np.concatenate((old_check, check))
        by = np.argsort(keys, kind="stable")
        keys, check = keys[by], check[by]
        keep = np.concatenate(([True], (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])))
        keys, check = keys[keep], check[keep]
        out.append({"kind": _RUN, "bucket": bucket, "doc_id": 0, "n": len(keys), "blob": planes.pack_sorted(keys) + check.tobytes()})
    return pa.Table.from_pylist(out, _schema(_FOUND))


def _heads(order, key, g, owner, offs, ctx, exact: bool = False) -> np.ndarray | None:
    """Marks the first of each run of equal windows; None if equal keys hide different windows."""
    new_key = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    differs = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    differs[1:] = (ctx[a] != ctx[b]) | (offs[a] != offs[b]) | (g[owner[a]] != g[owner[b]])
    if not exact and (differs & ~new_key).any():
        return None
    return new_key | differs


def _rewriter(window: int, gram: int):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = fw.binary_texts(batch.column(1))
            places = batch.column(2)
            n_words, n_removed, kept = [], [], []
            for t, blobs in zip(texts, places, strict=True):
                words = t.split()  # the six white-space bytes of the contract
                if blobs.is_valid:
                    keep = _kept(t, words, np.frombuffer(b"".join(blobs.as_py()), _PLACE), window, gram)
                    left = [w for w, k in zip(words, keep, strict=True) if k]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return rewrite


def _kept(text: bytes, words: list[bytes], place: np.ndarray, window: int, gram: int) -> list[bool]:
    """Which words stay; places whose anchor is not in this text (another row with the same id) don't count."""
    w = fw.Words([text])
    grams = fw.window_hash(w.hash, gram).astype(np.uint32)
    fits = place["pos"] < len(grams)
    place = place[fits]
    place = place[grams[place["pos"]] == place["gram"]]
    edge = np.zeros(len(words) + 1, np.int64)
    for k in range(window - gram + 1):
        start = (place["pos"] - place["off"] + k)[(place["mask"] >> k) & 1 == 1]
        start = start[(start >= 0) & (start + window <= len(words))]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)
    return (np.cumsum(edge[:-1]) == 0).tolist()


class FingerprintIndex:
    """Sorted runs of window fingerprints in the shared folder, one set for each bucket."""

    def __init__(self, spark: SparkSession, buckets: int, window: int = WINDOW, gram: int = GRAM, path: str | None = None):
        if not 1 <= gram <= window or window - gram > 15:
            raise ValueError("an anchor has 1 to 16 places in a window")
        self.spark, self.buckets, self.window, self.gram = spark, buckets, window, gram
        self.path = path or fresh_path(spark, "fingerprints")
        self.batches = 0

    def ingest(self, docs: DataFrame, keep_run: bool = True) -> DataFrame:
        """Add documents ``(doc_id, text)`` that all come after those before; returns
        ``(doc_id, blob)``, the covered places."""
        rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(_emitter(self.window, self.gram, self.buckets), _RECORDS)
        if self.batches:
            run = self.spark.read.parquet(f"{self.path}/batch={self.batches - 1}/kind={_RUN}")
            none = F.lit(b"")
            rows = rows.unionByName(
                run.select(
                    "bucket", F.lit(_HISTORY).alias("kind"), F.lit(0).cast("long").alias("base"), "n", F.expr("substring(blob, 1, length(blob) - n)").alias("gram"),
                    none.alias("doc"), none.alias("pos"), none.alias("off"), none.alias("cnt"), F.expr("substring(blob, length(blob) - n + 1, n)").alias("ctx"),
                )
            )
        found = rows.groupBy("bucket").applyInArrow(lambda table: _merge_bucket(table, keep_run), _FOUND)
        at = f"{self.path}/batch={self.batches}"
        found.write.option("compression", "zstd").partitionBy("kind").parquet(at)
        self.batches += 1
        read = self.spark.read.schema(_FOUND.replace("kind int, ", "") + ", kind int").parquet(at)
        return read.filter(F.col("kind") == _COVERED).select("doc_id", "blob")


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets for all of these documents."""
    total = docs.select(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = 1) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)`` for each row, the text's kept words joined by one space.

    The documents go into the index in ``batches`` steps of about equal size, by id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = FingerprintIndex(docs.sparkSession, bucket_count(docs), window, gram)
    cuts: list[int] = []
    if batches > 1:
        found = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("c")).first()["c"]
        cuts = sorted(set(found or []))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    covered = None
    for k in range(len(cuts) + 1):
        part = docs
        if k:
            part = part.filter(F.col("doc_id") > cuts[k - 1])
        if k < len(cuts):
            part = part.filter((F.col("doc_id") <= cuts[k]) | F.col("doc_id").isNull() if not k else F.col("doc_id") <= cuts[k])
        found = index.ingest(part, keep_run=k < len(cuts))
        covered = found if covered is None else covered.unionByName(found)
    places = covered.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("blob").alias("places"))
    joined = docs.withColumn("key", key).join(places, "key", "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_rewriter(window, gram), "doc_id long, n_words long, n_removed long, text string")


ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}) AS u),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) AS v WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, {WINDOW}) AS t(j)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
y AS (SELECT x.doc_id, x.p, word, gone.p IS NOT NULL AS g FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p),
z AS (SELECT doc_id, count(*) FILTER (WHERE g) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT g) AS kept FROM y GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN z ON z.doc_id = w.doc_id
"""
