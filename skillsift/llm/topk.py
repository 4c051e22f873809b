"""Exact top-k inner-product search by sequential access to sorted lists (no random access).

Vectors are turned into integer vectors floor(scale * x). Per block of candidates there is one sorted list
per dimension. A query reads every list from the end its weight prefers (a positive weight from the
largest value down, a negative one from the smallest up), all lists to the same depth. For every candidate
two bounds follow from what has been read: in a list where it was not met its value lies between the list's
far end (lower bound) and the value read last (upper bound). Reading goes on, four times deeper each
time, until no more than ``resolve`` candidates of the block can still reach the query's k-th largest
lower bound; their scores are then resolved and the k best kept. At full depth all bounds are the scores,
so the result is exact. Blocks of queries meet blocks of candidates; per query the best k of all blocks win.

Cases: a null id, a null vector and a vector with a null, NaN or infinite component take no part; rows that
share an id are rows of their own, as queries and as candidates of each other (a query leaves out its own row
only); vectors meet only vectors of their own
length; equal scores go to the smaller id; fewer than k candidates are all returned; an empty table gives
no rows; other columns are not read.

Plan: one shuffle deals the candidates to (candidate block, query block) pairs, in which a task holds one
block of each side, whatever ids and vectors are: blocks come from the row's hash, so equal ones spread.
Each pair returns at most k rows a query; the last top-k is a partial, then a final rank filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HITS = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(row, vec_id, v): floor(scale * component) as long; unusable rows are left out.

    ``row`` tells rows apart and is stable once the frame is written."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
              .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
              .select(F.monotonically_increasing_id().alias("row"), "vec_id",
                      F.transform("v", lambda c: F.floor(F.lit(scale) * c)).alias("v")))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows: by doubles where every partial sum is below 2^53, else by integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0 ** 53:
        return a @ b.T
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)


class SortedLists:
    """A block of candidates as one sorted list per dimension."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.n = len(vectors)
        self.x = vectors.astype(np.float64)
        order = np.argsort(self.x, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(self.n)[:, None].repeat(self.x.shape[1], 1), 0)
        self.values = np.take_along_axis(self.x, order, 0)

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper score bounds (queries x candidates) after reading ``depth`` entries per list."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        met_up, met_down = self.rank >= self.n - depth, self.rank < depth
        known = up @ (self.x * met_up).T + down @ (self.x * met_down).T
        not_up, not_down = (~met_up).astype(np.float64).T, (~met_down).astype(np.float64).T
        first, last = self.values[0], self.values[-1]
        lower = known + (up * first) @ not_up + (down * last) @ not_down
        upper = known + (up * self.values[self.n - depth]) @ not_up + (down * self.values[depth - 1]) @ not_down
        return lower, upper


def block_top_k(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                resolve: int = 256, batch: int = 64, rows: np.ndarray | None = None,
                query_rows: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query: (query row repeated, candidate ids, scores) of the block's k best.

    ``rows`` and ``query_rows`` tell a query's own row among the candidates; without them the ids do."""
    rows = ids if rows is None else rows
    query_rows = query_ids if query_rows is None else query_rows
    out = []
    if not len(ids):
        return out
    lists = SortedLists(vectors)
    slack = 1e-9 * max(1.0, float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
                       * max(1, vectors.shape[1]))
    for s in range(0, len(query_ids), batch):
        open_, depth = np.arange(s, min(s + batch, len(query_ids))), max(1, lists.n // 16)
        while len(open_):
            depth = min(depth, lists.n)
            lower, upper = lists.bounds(queries[open_].astype(np.float64), depth)
            own = query_rows[open_][:, None] == rows[None, :]
            lower[own], upper[own] = -np.inf, -np.inf
            kth = min(k, lists.n) - 1
            floor = -np.partition(-lower, kth, axis=1)[:, kth]
            alive = (upper >= floor[:, None] - slack) & ~own
            ready = (alive.sum(1) <= resolve) | (depth == lists.n)
            for r in np.flatnonzero(ready):
                q, c = open_[r], np.flatnonzero(alive[r])
                score = _exact(queries[q:q + 1], vectors[c])[0]
                best = np.lexsort((ids[c], -score))[:k]
                out.append((np.full(len(best), query_rows[q]), ids[c][best], score[best]))
            open_, depth = open_[~ready], depth * 4
    return out


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    rows, ids = t.column("row").to_numpy(), t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(
        [c.flatten() for c in flat.chunks] or [pa.array([], pa.int64())])
    return rows, ids, np.asarray(flat, np.int64).reshape(len(ids), -1)


def _searcher(k: int):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in HITS.split(", ")])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        rows, ids, x = _matrix(left)
        query_rows, query_ids, q = _matrix(right)
        hits = block_top_k(ids, x, query_ids, q, k, rows=rows, query_rows=query_rows)
        if not hits:
            return schema.empty_table()
        row, vec_id, score = (np.concatenate(c) for c in zip(*hits))
        order = np.argsort(query_rows)
        return pa.table([row, query_ids[order][np.searchsorted(query_rows[order], row)], vec_id, score], schema=schema)
    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 1024, block: int = 8192, query_block: int = 8192) -> DataFrame:
    """The k best other vectors of every query: query_id, rank (from 1), vec_id, score.

    ``is_query``: a condition on ``vec_id`` that marks the queries among the rows."""
    spark = vectors.sparkSession
    whole = materialize(integer_vectors(vectors, id_col, vec_col, scale), spark, "integer-vectors")
    asked = F.coalesce(is_query, F.lit(False))
    n = whole.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("q")).first()
    cbs, qbs = max(1, -(-n["n"] // block)), max(1, -(-n["q"] // query_block))
    dim = F.size("v").alias("dim")

    def deal(blocks: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(blocks)).cast("int")

    cand = whole.select("row", "vec_id", "v", dim, deal(cbs, 1).alias("cb"),
                        F.explode(F.sequence(F.lit(0), F.lit(qbs - 1))).alias("qb"))
    query = whole.where(asked).select("row", "vec_id", "v", dim, deal(qbs, 2).alias("qb"),
                                      F.explode(F.sequence(F.lit(0), F.lit(cbs - 1))).alias("cb"))
    key = ["dim", "cb", "qb"]
    found = cand.groupBy(*key).cogroup(query.groupBy(*key)).applyInArrow(_searcher(k), HITS)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
