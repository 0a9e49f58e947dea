"""Operator 2: exact top-k inner products by the threshold algorithm.

Rows are dealt into shards. A shard keeps a list of its rows per dimension, sorted by
that component, built once and met by all queries, which stream past it. For a query
the lists are read from their best end (highest values for a positive weight, lowest
for a negative one) and the rows seen are scored in full. Reading may stop at the depth
where the best score that an unseen row could have falls below a score that k rows are
known to reach. That bound comes from the first entries of the lists of the query's own
shard; what the own shard finds goes with the query to all other shards. As the bound
on unseen rows falls with depth, the depth is found by bisection.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, stage

#: Most rows of a shard, and queries that a task lets stream past one.
SHARD_ROWS, BLOCK_QUERIES = 1 << 15, 1 << 20
#: Rows of a shard where there are few, so that all cores have some.
LEAST_ROWS = 1 << 11
#: Integers up to this are exact in a double.
EXACT = float(1 << 53)
#: A score below all others.
NO_BOUND = -(1 << 63)


class SortedLists:
    """The rows of a shard, with one list of row numbers per dimension, by ascending component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # among equal scores the smaller row number is the smaller id
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.largest = float(np.abs(self.rows).max(initial=0))
        if self.largest < EXACT:
            self.rows = self.rows.astype(np.float64)
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order, axis=0)

    def search(self, own: int, query: np.ndarray, k: int, first: int = 16):
        """Up to ``k`` pairs (score, id), best first, without rows whose id is ``own``.

        Reading goes on while an unseen row could equal the k-th score, so ties
        are settled by id over all rows. Also returns the number of rows scored.
        """
        n, dims = self.rows.shape
        used = np.flatnonzero(query)
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(dims, 1) < EXACT
        kind = np.float64 if exact else object  # object: Python integers, for huge components
        weights = query.astype(kind)
        seen = np.zeros(n, bool)
        scores = np.zeros(0, kind)
        found = np.zeros(0, np.int64)
        up = query[used] > 0
        depth, step = 0, first
        while depth < n:
            end = min(n, depth + step)
            at = np.where(up, n - 1 - np.arange(depth, end)[:, None], np.arange(depth, end)[:, None])
            fresh = np.zeros(n, bool)
            if len(used):
                fresh[self.order[at, used]] = True
            else:
                fresh[:], end = True, n  # a query of zeros scores every row the same
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            new = new[self.ids[new] != own]
            scores = np.concatenate([scores, self.rows[new].astype(kind) @ weights])
            found = np.concatenate([found, new])
            if len(found) > k:
                best = np.lexsort((found, -scores))[:k] if exact else sorted(range(len(found)), key=lambda i: (-scores[i], found[i]))[:k]
                scores, found = scores[best], found[best]
            depth, step = end, step * 2
            if len(found) == k and depth < n:
                edge = np.where(up, n - 1 - depth, depth)
                bound = self.values[edge, used].astype(kind) @ weights[used]
                if bound < scores.min():
                    break
        best = sorted(range(len(found)), key=lambda i: (-scores[i], found[i]))
        return [(int(scores[i]), int(self.ids[found[i]])) for i in best], int(seen.sum())

    def exact(self, queries: np.ndarray) -> bool:
        """Whether all scores are whole numbers that a double holds."""
        return self.largest * float(np.abs(queries).max(initial=0)) * max(self.rows.shape[1], 1) < EXACT

    def depths(self, queries: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Per query the least depth from which on no unseen row can reach its bound ``low``."""
        n = len(self.rows)
        columns, up = np.arange(self.rows.shape[1]), queries > 0
        least, most = np.full(len(queries), min(1, n)), np.full(len(queries), n)
        while (open_ := np.flatnonzero(least < most)).size:
            middle = (least[open_] + most[open_]) // 2
            edge = np.where(up[open_], n - 1 - middle[:, None], middle[:, None])
            below = (self.values[edge, columns] * queries[open_]).sum(axis=1) < low[open_]
            most[open_[below]] = middle[below]
            least[open_[~below]] = middle[~below] + 1
        return most

    def seen(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Rows among the first ``depth`` of the lists of the dimensions that count, ascending."""
        used = np.flatnonzero(query)
        at = np.arange(depth)[:, None]
        mask = np.zeros(len(self.rows), bool)
        mask[self.order[np.where(query[used] > 0, len(self.rows) - 1 - at, at), used]] = True
        return np.flatnonzero(mask)

    def search_all(self, own: np.ndarray, queries: np.ndarray, k: int, low: np.ndarray, first: int = 16):
        """(query number, row number, score) of all rows that may be among the ``k`` best of a query.

        ``low``: scores that k other rows of the query are known to reach, ``NO_BOUND`` for none;
        rows below it are left out.
        """
        n, queries = len(self.rows), queries.astype(np.float64)
        low = np.where(low == NO_BOUND, -np.inf, low.astype(np.float64))
        for q in np.flatnonzero(np.isinf(low)):
            some = self.seen(queries[q], min(first, n))
            scores = self.rows[some[self.ids[some] != own[q]]] @ queries[q]
            if len(scores) >= k:
                low[q] = np.partition(scores, len(scores) - k)[len(scores) - k]
        depth = self.depths(queries, low)
        # Where the lists would be read to a depth at which they name most rows, all rows are scored at once.
        wide = depth * (queries != 0).sum(axis=1) >= n / 2
        wide |= ~queries.any(axis=1)
        found = []

        def keep(q: np.ndarray, rows: np.ndarray, scores: np.ndarray):
            """The k best of each query; rows ascend inside a query, so ties go to the smaller id."""
            fine = self.ids[rows] != own[q]
            q, rows, scores = q[fine], rows[fine], scores[fine]
            order = np.lexsort((rows, -scores, q))
            q, rows, scores = q[order], rows[order], scores[order]
            begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
            rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
            found.append((q[rank < k], rows[rank < k], scores[rank < k]))

        for q in np.flatnonzero(~wide):
            some = self.seen(queries[q], int(depth[q]))
            scores = self.rows[some] @ queries[q]
            high = scores >= low[q]
            keep(np.full(high.sum(), q), some[high], scores[high])
        dense = np.flatnonzero(wide)
        for c in range(0, len(dense), 64):
            some = dense[c : c + 64]
            scores = queries[some] @ self.rows.T
            q, rows = np.nonzero(scores >= low[some, None])
            keep(some[q], rows, scores[q, rows])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) as longs; vectors that are null, hold a null or a non-finite
    component, or have no id take no part. Raises where a component leaves the range of a long."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    return vectors.filter(fine).select(F.col("vec_id").cast("long"), whole.alias("v"))


MET = "shard int, kind int, q long, query_id long, v array<long>, low long"
FOUND = "q long, query_id long, vec_id long, score long"


def _matrices(numbers: list[np.ndarray], lists: list[pa.ListArray]) -> dict[int, tuple]:
    """Per length of vector: the numbers of its rows (several columns) and the rows."""
    out: dict[int, list] = {}
    for columns, vectors in zip(numbers, lists):
        offsets = np.asarray(vectors.offsets)
        sizes, values = np.diff(offsets), np.asarray(vectors.values)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            out.setdefault(int(d), []).append((columns[:, at], values[offsets[at][:, None] + np.arange(d)]))
    return {d: (np.concatenate([c for c, _ in x], axis=1), np.concatenate([r for _, r in x])) for d, x in out.items()}


def _meet(met: DataFrame, n_shards: int, k: int) -> DataFrame:
    """``FOUND`` of ``MET`` rows: candidates (kind 0) of a shard and after them the queries (kind 1) that it meets."""

    def results(lists: SortedLists, numbers: np.ndarray, queries: np.ndarray):
        q, query_id, low = numbers
        if lists.exact(queries):
            number, rows, scores = lists.search_all(query_id, queries, k, low)
            yield pa.record_batch([pa.array(x) for x in (q[number], query_id[number], lists.ids[rows], scores)], names=["q", "query_id", "vec_id", "score"])
            return
        for i in range(len(q)):
            best = lists.search(int(query_id[i]), queries[i], k)[0]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in ([int(q[i])] * len(best), [int(query_id[i])] * len(best), [x for _, x in best], [s for s, _ in best])], names=["q", "query_id", "vec_id", "score"])

    def run(batches):
        shard, ids, vectors, lists = None, [], [], None
        for whole in batches:
            shards, kinds = np.asarray(whole.column(0)), np.asarray(whole.column(1))
            cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])][: len(shards)])
            for a, b in zip(cuts, [*cuts[1:], len(shards)]):
                batch = whole.slice(a, b - a)
                if shards[a] != shard:
                    shard, ids, vectors, lists = shards[a], [], [], None
                if kinds[a] == 0:
                    ids.append(np.asarray(batch.column(2))[None])
                    vectors.append(batch.column(4))
                    continue
                if lists is None:
                    lists = {d: SortedLists(i[0], rows) for d, (i, rows) in _matrices(ids, vectors).items()}
                    ids, vectors = [], []
                numbers = np.stack([np.asarray(batch.column(i)) for i in (2, 3, 5)])
                for d, (own, queries) in _matrices([numbers], [batch.column(4)]).items():
                    if d in lists:
                        yield from results(lists[d], own, queries)

    return met.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "kind", "q").mapInArrow(frugal(run), FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best rows, ties to the smaller id.

    Both frames have ``vec_id, v`` with integer components. A row with the
    query's own id is no candidate; ids that repeat are candidates once each, and
    queries of one id are ranked together. Vectors are compared with vectors of their own
    length only. A query without candidates has no rows in the result; an empty table gives none.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_rows = rows.count()
    n_shards = max(1, math.ceil(n_rows / shard_rows), min(cores, math.ceil(n_rows / min(LEAST_ROWS, shard_rows))))
    n_blocks = max(1, math.ceil(queries.count() / block_queries))
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(n)).cast("int")
    numbered = queries.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "v", part(2, n_shards).alias("home"), part(3, n_blocks).alias("block"))
    numbered = stage(numbered, "queries")
    nothing = F.lit(0).cast("long")
    column = lambda kind, q, own, low: [F.lit(kind).alias("kind"), q.alias("q"), own.alias("query_id"), "v", low.alias("low")]

    def met(asked: DataFrame, blocks: int) -> DataFrame:
        """Shards of rows, one copy for each block of queries, and the queries that ask them."""
        copies = rows.select("v", "vec_id", part(1, n_shards).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        number = lambda shard: (F.col("block") * n_shards + F.col(shard)).cast("int").alias("shard") if blocks > 1 else F.col(shard).alias("shard")
        left = copies.select(number("own"), *column(0, F.col("vec_id"), nothing, nothing))
        return _meet(left.unionByName(asked.select(number("shard"), *column(1, F.col("q"), F.col("query_id"), F.col("low")))), n_shards * blocks, k)

    at_home = stage(met(numbered.select("q", "query_id", "v", "block", F.col("home").alias("shard"), F.lit(NO_BOUND).alias("low")), 1), "top-k-home")
    near = at_home
    if n_shards > 1:
        low = at_home.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("low"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != F.col("home"))).alias("shard")
        asked = numbered.join(low, "q", "left").select("q", "query_id", "v", "block", others, F.coalesce("low", F.lit(NO_BOUND)).alias("low"))
        near = at_home.unionByName(stage(met(asked, n_blocks), "top-k-away"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k_of_table(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """Queries: rows whose id is divisible by ``every``; candidates: all rows. See ``top_k``."""
    rows = stage(quantized(vectors), "vectors")
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
