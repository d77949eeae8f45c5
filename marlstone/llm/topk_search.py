"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers, ``floor(scale * x)``. Their non-zero components are postings: dimension,
row, weight. Rows are dealt into blocks by a hash of the id; for each pair of a query block and a
candidate block, one dimension at a time adds (query weight x posting weight) into a dense array
of scores, for all queries that have the dimension; each query's best are then selected by
partition and merged over the blocks.

A block's size is a parameter, so a task holds one query block and one candidate block, whatever
the input; a partial result has k rows for each query and candidate block.

Defined results: an id is one vector: repeated rows count once (the smallest of them, if they
differ); rows with a null id, and vectors null, or with a null or non-finite component, take no
part; vectors of different lengths are compared as if the shorter one ended in zeros; ties go to
the smaller id; a score beyond 64 bits counts as the limit
of a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialise

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
#: Scores that are accumulated together.
_TILE = 512

_PACKED = "block int, n int, ids binary, width int, kind string, data binary"


def _pack(table: pa.Table, scale: float) -> pa.Table:
    """One block as one row, in order of the ids."""
    block = table.column("block")[0].as_py()
    best: dict[int, list[float]] = {}
    for i, v in zip(table.column("id").to_pylist(), table.column("vector").to_pylist(), strict=True):
        if i not in best or v < best[i]:
            best[i] = v
    ids = np.array(sorted(best), np.int64)
    width = max(map(len, best.values()), default=0)
    x = np.zeros((len(ids), width))
    for row, i in enumerate(ids.tolist()):
        x[row, : len(best[i])] = best[i]
    x = np.floor(scale * x)
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"  # a large double is an integer as it stands
    return pa.table({"block": pa.array([block], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "width": pa.array([width], pa.int32()), "kind": [kind], "data": [x.astype(kind).tobytes()]})


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["data"], r["kind"]).reshape(r["n"], r["width"])


def _accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all queries (columns) and rows, one dimension at a time."""
    width = min(queries.shape[1], rows.shape[1])
    bound = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * max(width, 1)
    if bound < 2**62:
        kind = np.int32 if bound < 2**30 else np.int64
        queries, rows = queries.astype(kind), rows.astype(kind)
    else:
        kind = object
        queries, rows = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (queries, rows))
    scores = np.zeros((len(rows), len(queries)), kind)
    for d in range(width):
        q = queries[:, d]
        posted = np.flatnonzero(rows[:, d])
        wanted = np.flatnonzero(q)
        if not len(posted) or not len(wanted):
            continue
        weight = rows[posted, d][:, None]
        if 2 * len(wanted) > len(q):  # most queries have the dimension: whole rows of scores
            if 2 * len(posted) > len(rows):
                scores += rows[:, d][:, None] * q
            else:
                scores[posted] += weight * q
        else:
            scores[np.ix_(posted, wanted)] += weight * q[wanted]
    return scores


def _best(query_ids: np.ndarray, row_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best rows (row ids ascend): query, row and score."""
    n = len(row_ids)
    own = np.searchsorted(row_ids, query_ids)
    own = np.where((own < n) & (row_ids[np.minimum(own, n - 1)] == query_ids), own, -1)
    out = []
    if scores.dtype == object:
        scores = np.array([[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in scores.tolist()], np.int64).reshape(scores.shape)
    small = not scores.size or max(int(scores.max()), -int(scores.min())) < 2**46
    for j in range(len(query_ids)):
        s = scores[:, j]
        if small and n > k + 1:  # score, then the earlier row, in one number
            key = (s.astype(np.int64) << 16) - np.arange(n)
            if own[j] >= 0:
                key[own[j]] = -(2**63)
            top = np.argpartition(key, n - k)[n - k :]
            top = top[np.argsort(-key[top])]
        else:
            top = np.array(sorted((i for i in range(n) if i != own[j]), key=lambda i: (-int(s[i]), i))[:k], np.int64)
        out.append(top)
    count = np.array([len(t) for t in out], np.int64)
    rows = np.concatenate(out) if out else np.empty(0, np.int64)
    return np.repeat(query_ids, count), row_ids[rows.astype(np.int64)], scores[rows.astype(np.int64), np.repeat(np.arange(len(query_ids)), count)]


def _search(k: int):
    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for q in left.to_pylist():
            query_ids, queries = _unpack(q)
            for c in right.to_pylist():
                row_ids, rows = _unpack(c)
                for lo in range(0, len(query_ids), _TILE):
                    mine = slice(lo, lo + _TILE)
                    parts.append(_best(query_ids[mine], row_ids, _accumulate(queries[mine], rows), k))
        got = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2].astype(np.int64), pa.int64())})

    return search


def _blocks(rows: DataFrame, size: int, scale: float) -> tuple[DataFrame, int]:
    count = -(-rows.count() // size) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return materialise(dealt.groupBy("block").applyInArrow(lambda t: _pack(t, scale), _PACKED), "vectors"), count


def topk_search(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each row for
    which ``queries`` (over the column ``id``) holds, among all other rows."""
    if candidate_block > 1 << 15:
        raise ValueError("a candidate block holds 32,768 rows at most")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)
    asked, n_queries = _blocks(rows.filter(queries), query_block, scale)
    held, n_rows = _blocks(rows, candidate_block, scale)
    left = asked.select("*", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("c"))
    right = held.select("*", F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
