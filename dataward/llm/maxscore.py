"""Exact top-k by inner product: MaxScore over shards, merged.

The terms of a query are its components. In a shard of vectors each term has a score bound, its greatest
contribution there, and a posting: the component of every vector (vectors are dense, so a posting holds
the whole shard). Terms go by falling width of their contributions. The first ones, as many as hold all but
a small part of the query's norm, are essential: their postings are traversed in full. The vectors best so
far are then completed, which gives the k-th best score a close lower bound. The other terms are
non-essential: they are probed only for vectors that still compete, that is, whose score so far reaches
the k-th best one together with what is left of the bounds, and of the norms of query and vector.

Work is dealt out as (shard of vectors, block of queries) pairs, each of bounded size, and the pairs'
best k are merged by query.

Defined results: vectors that are null or hold null or non-finite components take no part; a vec_id
that repeats counts once, with its smallest vector; vectors of unlike lengths are compared as if the
shorter ended in zeros; with fewer than k other vectors, all are returned; ties go to the smaller
vec_id; rows with a null vec_id take no part; components are cut to 64 bits, and a score beyond 64 bits
is an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

K, EVERY = 20, 20
#: Most vectors and queries of a pair, and the fewest vectors that are worth one of their own.
SHARD, BLOCK, LEAST = 16384, 4096, 1024
#: The fewest essential terms, and how much of a query's norm the others hold at most.
ESSENTIAL, REST = 16, 0.25
#: Queries whose bounds are found together.
GROUP = 64
#: Below this, products and sums are exact in double precision; beyond it, Python's integers are used.
EXACT = 2**53


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, x: each component as floor(scale * component)."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding")).where(F.col("vec_id").isNotNull() & good)
    return rows.select("vec_id", x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(table: pa.Table, width: int) -> np.ndarray:
    """Rows of x, filled up with zeros."""
    x = table.column("x").combine_chunks()
    flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.asarray(x.value_lengths(), dtype=np.int64)
    out = np.zeros((len(ends), width), dtype=np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Shard:
    """A shard's postings, one row for each component, with bounds and squares."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.postings = ids, vectors, np.ascontiguousarray(vectors.T)
        self.low, self.high, self.squares = vectors.min(axis=0), vectors.max(axis=0), (self.postings**2).astype(np.float32)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        return next(self.tops(np.array([query_id]), query[None], k))

    def tops(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """The k best for each query, and how many products they took."""
        width = queries.shape[1]
        for start in range(0, len(queries), GROUP):
            group = queries[start : start + GROUP]
            order = np.argsort(-np.abs(group) * (self.high - self.low), axis=1, kind="stable")
            # Of the terms from each place on: the greatest contribution, and the query's squares.
            rest = lambda x: np.pad(np.cumsum(np.take_along_axis(x, order, 1)[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1)))  # noqa: B023, E731
            bounds, squares = rest(np.maximum(group * self.low, group * self.high)), rest(group * group)
            essential = np.maximum((squares > REST**2 * squares[:, :1]).sum(axis=1), min(ESSENTIAL, width))
            others = np.zeros(group.shape, np.float32)
            np.put_along_axis(others, order, (np.arange(width) >= essential[:, None]).astype(np.float32), 1)
            # By norms, what the other terms can add to each vector; single precision, with room for its errors.
            left = np.sqrt(others @ self.squares)
            left *= (np.sqrt(np.take_along_axis(squares, essential[:, None], 1)) * (1 + 1e-4)).astype(np.float32)
            for i, n in enumerate(essential.tolist()):
                yield self._best(query_ids[start + i], group[i], order[i], n, bounds[i, n], left[i], k)

    def _best(self, query_id: int, query: np.ndarray, order: np.ndarray, n: int, bound: float, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        part = query[order[:n]] @ self.postings[order[:n]]
        part[self.ids == query_id] = -np.inf
        done, more = n * len(part), len(order) - n
        if not more or k >= len(part):
            alive = np.flatnonzero(part > -np.inf)
        else:
            ahead = np.argpartition(part, max(len(part) - 2 * k, 0))[-2 * k :]
            ahead = ahead[part[ahead] > -np.inf]
            whole = self.vectors[ahead] @ query
            done += len(ahead) * more
            least = np.partition(whole, -k)[-k] - 0.5 if len(whole) >= k else -np.inf  # scores are whole numbers
            alive = np.flatnonzero((part + left >= least) & (part + bound >= least) & (part > -np.inf))
        scores = part[alive]
        if more:
            probe = order[n:]
            others = np.zeros_like(query)
            others[probe] = query[probe]
            scores = scores + self.vectors[alive] @ others
            done += len(alive) * more
        return *best(self.ids[alive], scores, k), done


class LargeShard:
    """A shard whose scores doubles can't hold: every product is made, in Python's integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(object)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        scores = self.vectors @ query.astype(object)
        found = sorted((-s, i) for s, i in zip(scores.tolist(), self.ids.tolist(), strict=True) if i != query_id)[:k]
        return np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64), scores.size * len(query)

    def tops(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        return (self.top(i, q, k) for i, q in zip(query_ids.tolist(), queries, strict=True))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; queries are the rows whose vec_id `every` divides."""
    vectors = written(integer_vectors(vectors, scale), "integer-vectors")
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"), F.max(F.size("x")).alias("width"), F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("top")).first()
    width, largest = shape["width"] or 0, int(shape["top"] or 0)
    blocks = max(1, -(-shape["q"] // BLOCK))
    # Shards as large as a task may hold, unless there are too few pairs to go round.
    pairs_wanted = 3 * shuffle_partitions(vectors.sparkSession)
    shards = max(1, -(-shape["n"] // SHARD), min(-(-shape["n"] // LEAST), -(-pairs_wanted // blocks)))
    exact = largest * largest * max(width, 1) * 4 < EXACT

    def pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, rows, queries_ = left.column("vec_id").to_numpy(), matrix(left, width), matrix(right, width)
            shard = Shard(ids, rows.astype(np.float64)) if exact else LargeShard(ids, rows)
            query_ids = right.column("vec_id").to_numpy()
            for query_id, (got, scores, _) in zip(query_ids.tolist(), shard.tops(query_ids, queries_.astype(np.float64) if exact else queries_, k), strict=True):
                found.append((np.full(len(got), query_id), got, scores.astype(np.int64)))
        columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = vectors.select(spread(shards).alias("shard"), each(blocks).alias("block"), "vec_id", "x")
    queries = vectors.where(F.col("vec_id") % every == 0).select(each(shards).alias("shard"), spread(blocks).alias("block"), "vec_id", "x")
    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(pairs, "query_id long, vec_id long, score long")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
