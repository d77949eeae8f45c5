"""Exact Jaccard join of word n-gram sets by prefix trees, and the groups that its links form.

Every set is a sorted list under one global order: shingles that many documents share come last,
the rest by hash. Two sets with Jaccard >= t have a shingle in common among the first
``n - ceil(t * n) + 1`` of either, so only such prefixes are indexed.

1. Sets that are equal become one class; everything below works on classes.
2. Prefix shingles are dealt to buckets. Where several classes meet at a shingle, each names a few
   that its size allows: the smallest, the least edited, its neighbour. It then keeps the
   ``PARTNERS`` it named most often, so these pairs grow with the classes only.
3. Each class has a bitmap of its whole set, one or two bits a shingle. What one bitmap has and the
   other lacks bounds the overlap from above; pairs that it rules out (a shared passage and little
   else) go before their sets are read.
4. Pairs are verified by prefix tree: the lists to compare with one class form a tree in which equal
   beginnings share their partial overlap, and a branch is left as soon as what remains of the
   lists can't reach the overlap needed. Links join classes into components.
5. The buckets are read again with the components, without classes that met no other. Every pair of classes in different
   components that meet often enough for a link (what a prefix doesn't show is bounded) is judged likewise. Pairs inside one
   component can't change it, so a group of thousands of copies never makes all its pairs; every
   pair across components is judged, and no link between different components is missed.

The order is only a matter of speed: the most frequent shingles are counted over all documents and
the ``HOT_MOST`` most frequent of them are put last; with any choice the result is the same.

Defined results: a text with fewer words than a shingle is one shingle; null texts and texts
without words have an empty set and are linked with nothing; rows that repeat an id count as one
document; rows with a null id are linked with nothing and have a null component. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesplanes as planes
from . import flatwords as fw
from . import pieces as px
from .workspace import discard, materialise

SHINGLE = 4
#: Similarity in hundredths.
PERCENT = 85
HOT_LEAST = 48
#: Partners that a class is first compared with, before all that are left.
PARTNERS = 3
HOT_MOST = 200_000
SLICE_BYTES = 2 << 20
LEAST_BUCKETS = 32
#: Ids that may be broadcast to pick their texts; beyond it they are shuffled.
BROADCAST_IDS = 500_000
#: Lists that one tree holds.
TREE = 256

_TOP = np.uint64(1 << 63)
#: Bits that the index leaves out of a shingle: some others then look alike, which only adds pairs to verify.
_CUT = np.uint64(24)


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, 63-bit hashes, ascending."""
    out = []
    for lo, hi in fw.slices(texts):
        w = fw.Words(texts[lo:hi], fw.NOT_SPACE, lower=True)
        grams = fw.window_hash(w.hash, width) >> np.uint64(1)
        for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(grams[a : a + n - width + 1]))
            elif n:
                out.append(fw.mix(fw.window_hash(w.hash[a : a + n], n) + np.uint64(n)) >> np.uint64(1))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _ordered(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The set under the global order: frequent shingles get the top bit."""
    if not len(hot) or not len(s):
        return s
    j = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[j] == s
    return np.concatenate((s[~is_hot], s[is_hot] | _TOP))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), fw.binary_texts(batch.column(1))
        for lo, hi in fw.slices(texts, SLICE_BYTES):
            yield ids[lo:hi], texts[lo:hi]


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _bitmap(s: np.ndarray) -> bytes:
    """A bit for the low bits of each shingle, in a power of two of at least as many bits as shingles."""
    size = 1 << max(6, (len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[s & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _may_link(nx: int, ny: int, bx: bytes, by: bytes, percent: int) -> bool:
    """Whether the bitmaps leave room for a link; the larger one is folded to the smaller's size."""
    x, y = np.frombuffer(bx, np.uint8), np.frombuffer(by, np.uint8)
    least = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(b.reshape(-1, least)) for b in (x, y))
    only_x, only_y = (int(np.bitwise_count(b).sum()) for b in (x & ~y, y & ~x))
    return min(nx - only_x, ny - only_y) * (100 + percent) >= percent * (nx + ny)


def _bitmap_filter(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("nx", "ny", "bx", "by")], strict=True)
            fit = pa.array([_may_link(*row, percent) for row in rows], pa.bool_())
            yield batch.select(["x", "y"]).filter(fit)

    return keep


def _hot_counter(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches):
            got = _sets(texts, width)
            s, n = np.unique(np.concatenate([np.empty(0, np.uint64), *got]), return_counts=True)
            often = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(s[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["s", "n"])

    return count


def _signer(width: int, percent: int, hot):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            n, rare, a, b, bits, prefix = [], [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in _sets(texts, width):
                    n.append(len(s))
                    a.append(int(fw.mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    b.append(int(fw.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)))
                    bits.append(_bitmap(s))
                    s = _ordered(s, hot.value)
                    rare.append(int(np.searchsorted(s, _TOP)))
                    prefix.append(planes.pack_sorted(s[: _prefix(len(s), percent)] >> _CUT))
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (ids, n, rare, a, b)), pa.array(bits, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "n", "rare", "a", "b", "bits", "prefix"])

    return sign


_POSTINGS = "bucket int, m int, token binary, id binary, n binary, comp binary, meets binary"
_POSTING_SCHEMA = pa.schema([("bucket", pa.int32()), ("m", pa.int32()), *[(k, pa.binary()) for k in ("token", "id", "n", "comp", "meets")]])


def _poster(buckets: int, percent: int):
    """Prefix shingles of many classes, a row for each bucket."""

    def flush(ids, ns, comps, meets, prefixes) -> pa.RecordBatch:
        tokens = [planes.unpack_sorted(p, _prefix(n, percent)) for p, n in zip(prefixes, ns, strict=True)]
        size = np.array([len(t) for t in tokens])
        token = np.concatenate(tokens)
        who = np.repeat(np.arange(len(ids)), size)
        # the hash itself is skewed here (prefixes are the small ones)
        bucket = (fw.mix(token + np.uint64(1)) >> np.uint64(32)).astype(np.int64) * buckets >> 32
        order = np.lexsort((token, bucket))
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        ids, ns, comps, meets = (np.array(v, np.int64) for v in (ids, ns, comps, meets))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            i = order[cut[b] : cut[b + 1]]
            w = who[i]
            rows.append({"bucket": b, "m": len(i), "token": planes.pack_sorted(token[i]), "id": planes.pack(ids[w].view(np.uint64)), "n": planes.pack(ns[w]), "comp": planes.pack(comps[w].view(np.uint64)), "meets": planes.pack(meets[w])})
        return pa.RecordBatch.from_pylist(rows, _POSTING_SCHEMA)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                for h, v in zip(held, row, strict=True):
                    h.append(v)
                size += len(row[4])
                if size > 2 << 20:
                    yield flush(*held)
                    held, size = [[], [], [], [], []], 0
        if size:
            yield flush(*held)

    return post


def _meetings(table: pa.Table) -> tuple[np.ndarray, ...]:
    """One bucket's postings at shingles where several classes meet, by shingle, size and id; and
    the number of each posting's shingle."""
    rows = table.to_pylist()
    token = np.concatenate([planes.unpack_sorted(r["token"], r["m"]) for r in rows])
    get = lambda k: np.concatenate([planes.unpack(r[k], r["m"]).view(np.int64) for r in rows])
    ids, n, comp, meets = get("id"), get("n"), get("comp"), get("meets")
    order = np.argsort(token, kind="stable")
    t = token[order]
    new = np.concatenate(([True], t[1:] != t[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(t)))
    order = order[np.repeat(size > 1, size)]
    order = order[np.lexsort((ids[order], n[order], token[order]))]
    t = token[order]
    group = np.cumsum(np.concatenate((np.zeros(min(len(t), 1), np.int64), (t[1:] != t[:-1]).astype(np.int64))))
    return ids[order], n[order], comp[order], meets[order], group


_PAIRS = "x long, y long, nx long, ny long, k long"


def _counted(rows: list[np.ndarray]) -> pa.Table:
    """Pairs (x, y, nx, ny) and how often each is there."""
    both, count = np.unique(np.concatenate([np.empty((0, 4), np.int64), *rows]), axis=0, return_counts=True)
    return pa.table({**{c: pa.array(both[:, i], pa.int64()) for i, c in enumerate(("x", "y", "nx", "ny"))}, "k": pa.array(count, pa.int64())})


#: In place of a partner, in rows that count a class's shingles at which it meets any other.
_ANY = -(1 << 63)


def _needed(percent: int, nx, ny):
    """Shingles that two linked sets must share in their prefixes: what those don't show of either
    set adds ``ceil(t * n) - 1`` at most."""
    part = [-(-percent * n // 100) for n in (nx, ny)]
    return -(-percent * (nx + ny) // (100 + percent)) - np.maximum(*part) + 1


def _first_pairs(percent: int):
    """Each class that meets others, with a few of them that its size allows: the smallest, those
    with the fewest rare shingles (in a group of near copies the least edited ones, which most
    others link with) and its neighbour in that order."""

    def pairs(table: pa.Table) -> pa.Table:
        ids, n, rare, _, group = _meetings(table)
        if not len(ids):
            return _counted([])
        key = (group << 32) + n
        found = [(np.arange(len(ids)), np.searchsorted(key, (group << 32) + -(-percent * n // 100)))]
        order = np.lexsort((ids, n, rare, group))
        start = np.searchsorted(group, group)
        at = np.arange(len(ids))
        for k in range(PARTNERS):
            there = np.flatnonzero(group[np.minimum(start + k, len(ids) - 1)] == group)
            there = there[start[there] + k < len(ids)]
            found.append((order[there], order[start[there] + k]))
        later = at[at > start]
        found.append((order[later], order[later - 1]))
        x, y = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
        fit = (ids[x] != ids[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[fit], y[fit]
        both = np.unique(np.stack([x, y], 1), axis=0)  # one shingle proposes a pair once
        x, y = both[:, 0], both[:, 1]
        zero = np.zeros_like(n)
        return _counted([np.stack([ids[x], ids[y], n[x], n[y]], 1), np.stack([ids, zero + _ANY, n, zero], 1)])

    return pairs


def _rest_pairs(percent: int):
    """Pairs of classes in different components that meet, fit in size, and each meet others at as
    many shingles as a link between the two needs."""

    def pairs(table: pa.Table) -> pa.Table:
        ids, n, comp, meets, group = _meetings(table)
        found = []
        if len(ids):
            cut = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(ids))
            lowest, highest = np.minimum.reduceat(comp, cut[:-1]), np.maximum.reduceat(comp, cut[:-1])
            for g in np.flatnonzero(lowest != highest).tolist():
                at = np.arange(cut[g], cut[g + 1])
                names, own, count = np.unique(comp[at], return_inverse=True, return_counts=True)
                few = own != np.argmax(count)  # members of the largest component are only met by others
                for i in np.flatnonzero(few).tolist():
                    j = (own != own[i]) & (~few | (np.arange(len(at)) > i))
                    a, b = at[i], at[j]
                    b = b[(100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (np.minimum(meets[a], meets[b]) >= _needed(percent, n[a], n[b]))]
                    if len(b):
                        swap = ids[a] > ids[b]
                        found.append(np.stack([np.where(swap, ids[b], ids[a]), np.where(swap, ids[a], ids[b]), np.where(swap, n[b], n[a]), np.where(swap, n[a], n[b])], 1))
        return _counted(found)

    return pairs


def _enough(percent: int) -> Column:
    """Whether a pair met at as many shingles as ``_needed`` says."""
    part = lambda n: F.ceil(F.col(n) * percent / F.lit(100))
    return F.col("k") + F.greatest(part("nx"), part("ny")) - 1 >= F.ceil((F.col("nx") + F.col("ny")) * percent / F.lit(100 + percent))


class PrefixTree:
    """Sorted lists in the order of a trie's leaves: with each list, how much of it is shared with
    the one before, so that a walk from leaf to leaf passes every branch once."""

    def __init__(self, lists: list[np.ndarray]):
        self.order = sorted(range(len(lists)), key=lambda i: lists[i].astype(">u8").tobytes())
        self.lists = [lists[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.lists, self.lists[1:], strict=False):
            n = min(len(a), len(b))
            differs = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differs[0]) if len(differs) else n)

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """Which lists have at least ``percent`` hundredths of the union in common with the query."""
        found = []
        path = np.zeros(1, np.int64)  # overlap of the current branch's first k shingles
        known = 0  # shingles of the branch that have been looked up
        for leaf, (items, shared) in enumerate(zip(self.lists, self.shared, strict=True)):
            need = -(-percent * (len(query) + len(items)) // (100 + percent))
            depth = min(known, shared)
            if len(path) < len(items) + 1:
                path = np.concatenate((path, np.zeros(len(items) + 1 - len(path), np.int64)))
            step = 64
            while depth < len(items):
                after = len(query) - int(np.searchsorted(query, items[depth]))
                if path[depth] + min(len(items) - depth, after) < need:
                    break  # what remains can't do
                block = items[depth : depth + step]
                j = np.minimum(np.searchsorted(query, block), len(query) - 1)
                path[depth + 1 : depth + 1 + len(block)] = path[depth] + np.cumsum(query[j] == block)
                depth += len(block)
                step *= 2
            known = depth
            if depth == len(items) and path[depth] >= need:
                found.append(self.order[leaf])
        return found


def _verifier(percent: int):
    def verify(key, members: pa.Table, owner: pa.Table) -> pa.Table:
        ids = members.column("x").to_pylist()
        lists = [planes.unpack_sorted(s, n) for s, n in zip(members.column("s").to_pylist(), members.column("n").to_pylist(), strict=True)]
        links: list[tuple[int, int]] = []
        for y, s, n in zip(owner.column("o").to_pylist(), owner.column("u").to_pylist(), owner.column("m").to_pylist(), strict=True):
            links += [(ids[i], y) for i in PrefixTree(lists).search(planes.unpack_sorted(s, n), percent)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return verify


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(x, y)`` that are links; trees of ``TREE`` lists at most are compared with one."""
    per = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / TREE).alias("trees"))
    dealt = pairs.select("x", "y").join(per, "y").withColumn("tree", F.pmod(F.xxhash64("x"), F.col("trees")))
    members = dealt.join(sets.withColumnRenamed("id", "x"), "x").select("y", "tree", "x", "n", "s")
    owners = dealt.select(F.col("y").alias("o"), F.col("tree").alias("t")).distinct().join(sets.select(F.col("id").alias("o"), F.col("n").alias("m"), F.col("s").alias("u")), "o")
    return members.groupBy("y", "tree").cogroup(owners.select("o", "t", "m", "u").groupBy("o", "t")).applyInArrow(_verifier(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(id, comp)`` for every id in a link ``(a, b)``; comp is the smallest id it reaches."""
    both = links.filter("a <> b").select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = before = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = materialise(low.join(jump, "low").select("id", "old", F.least("low", "far").alias("comp")), "labels")
        labels = new.select("id", "comp")
        discard(before)
        before = new
        if not new.filter("comp <> old").limit(1).count():
            discard(both)
            return labels


def _set_writer(width: int, hot):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            got = [_ordered(s, hot.value) for s in _sets(texts, width)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in got], pa.int32()), pa.array([planes.pack_sorted(s) for s in got], pa.binary())], ["id", "n", "s"])

    return write


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id)`` for each row: the set's size, the smallest id
    reachable by links, and the smallest id with an equal set."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    often = docs.mapInArrow(px.releasing(_hot_counter(width)), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST)
    hot = np.sort(np.array([r["s"] for r in often.orderBy(F.col("n").desc(), "s").limit(HOT_MOST).select("s").collect()], np.int64).view(np.uint64))
    hot = spark.sparkContext.broadcast(hot)
    signed = materialise(docs.mapInArrow(px.releasing(_signer(width, percent, hot)), "doc_id long, n long, rare long, a long, b long, bits binary, prefix binary"), "signed")
    some = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(some.groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.first("rare").alias("rare"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "classes")
    total = classes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // (8 << 20)))

    def met(rows: DataFrame, pairs) -> DataFrame:
        found = rows.mapInArrow(px.releasing(_poster(buckets, percent)), _POSTINGS).groupBy("bucket").applyInArrow(pairs(percent), _PAIRS)
        return found.groupBy("x", "y", "nx", "ny").agg(F.sum("k").alias("k"))

    def verified(pairs: DataFrame) -> DataFrame:
        for c in ("x", "y"):
            pairs = pairs.join(classes.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("b" + c)).hint("merge"), c)
        pairs = materialise(pairs.mapInArrow(px.releasing(_bitmap_filter(percent)), "x long, y long"), "pairs")
        need = materialise(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "need")
        wanted = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
        sets = materialise(docs.join(wanted, "doc_id", "left_semi").mapInArrow(px.releasing(_set_writer(width, hot)), "id long, n int, s binary"), "sets")
        links = materialise(_verify(pairs, sets, percent), "links")
        discard(pairs, need, sets)
        return links

    # a shingle names few partners, so k may fall short of the meetings; what this leaves out the last step finds
    met_first = materialise(met(classes.select("id", "n", "rare", F.lit(0).alias("meets"), "prefix"), _first_pairs), "met")
    meets = met_first.filter(F.col("y") == _ANY).select(F.col("x").alias("id"), F.col("k").alias("meets"))
    first = met_first.filter(F.col("y") != _ANY).filter(_enough(percent))
    best = first.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", -F.col("y"))), False), 1, PARTNERS).alias("best"))
    best = best.select("x", F.explode("best").alias("b")).select("x", (-F.col("b.col2")).alias("y"))
    links = verified(best.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    found = components(links)
    rows = classes.join(meets, "id").join(found, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"), "meets", "prefix")
    more = verified(met(rows, _rest_pairs).filter(_enough(percent)).select("x", "y"))
    if more.limit(1).count():
        links = materialise(links.unionByName(more), "links")
        found = components(links)
    named = classes.select("a", "b", "n", F.col("id").alias("class_id")).join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    named = named.select("a", "b", "n", "class_id", F.coalesce("comp", "class_id").alias("comp"))
    out = signed.select("doc_id", "n", "a", "b").join(named, ["a", "b", "n"], "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.coalesce("comp", "doc_id")).alias("component_id"), F.when(own, F.coalesce("class_id", "doc_id")).alias("class_id"))


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(g) AS g FROM (
  SELECT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM w WHERE len(ws) >= {SHINGLE}) AS u
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {SHINGLE - 1}) AS v),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
