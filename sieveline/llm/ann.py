"""Nearest neighbours by largest inner product, by collision-counting hashing.

Inner products become distances by one more coordinate that brings all vectors of a block to its largest norm, and the
query to the same. Each hash function is one random projection, kept as a sorted array. A query uses the ``USED`` arrays
that it lies farthest out in, where rows apart from it are few and a collision tells most. Its windows, centred on its own
projections, widen together (virtual rehashing: the arrays stay, only the bounds move), from one width for all queries.
Only the rows between a window's old and new bounds are visited: each collides once more. Windows stop widening once
``BETA`` of the block's rows, and ``MORE`` times k more, have at least ``ALPHA`` of all collisions; the threshold is then
the highest that leaves so many. They are verified on the original vectors, in double precision.

Every row is indexed, in one block, whose sorted arrays are made once. Rows are dealt to blocks of bounded size by a hash
of their id, queries go to each block, and only each block's best k for a query are shuffled again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, USED, ALPHA, BETA, MORE, FIRST_WIDTH, WIDEN = 256, 48, 0.4, 0.08, 12, 0.6, 1.2
#: Rows and queries of a block, rows from which there is a block for each core, and queries that a task holds at once.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_ROWS, QUERIES = 32768, 32768, 4096, 1024


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    arrays = arrays.chunk(0) if isinstance(arrays, pa.ChunkedArray) else arrays
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Block:
    """The sorted projections of a block of rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, seed: int = 4) -> None:
        n, dim = rows.shape
        self.rows, self.ids, self.visits, self.verified = rows, ids, 0, 0
        self.turn = np.random.default_rng([seed, dim]).standard_normal((dim + 1, PROJECTIONS))
        norms = np.sqrt((rows * rows).sum(axis=1))
        self.top = norms.max()
        hashed = (rows @ self.turn[:dim] + np.sqrt(np.maximum(self.top**2 - norms * norms, 0))[:, None] * self.turn[dim]).T
        order = np.argsort(hashed, axis=1, kind="stable")
        self.order = order.ravel().astype(np.int32)
        # the sorted arrays end to end, each moved past the one before, so that one search finds all bounds of a query
        self.reach = np.abs(hashed).max()
        self.apart = 8 * (self.reach + 64 * self.top) * np.arange(PROJECTIONS)
        self.arrays = (np.take_along_axis(hashed, order, axis=1) + self.apart[:, None]).ravel()
        self.first = n * np.arange(PROJECTIONS)

    def _visit(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The rows in low:high of the sorted arrays, one after the other."""
        return np.concatenate([self.order[a:b] for a, b in zip(low.tolist(), high.tolist())])

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """The rows with the most collisions, at the first width at which enough rows have enough of them."""
        n = len(self.ids)
        need, enough = math.ceil(ALPHA * USED), min(n, MORE * k + 1 + math.ceil(BETA * n))
        centre = np.clip(query / np.sqrt(query @ query) * self.top @ self.turn[:-1], -32 * self.top, 32 * self.top)
        used = np.argsort(-np.abs(centre), kind="stable")[:USED]
        centre, first = centre[used] + self.apart[used], self.first[used]
        low = high = np.clip(np.searchsorted(self.arrays, centre) - first, 0, n) + first
        counts = np.zeros(n, np.int64)
        width = FIRST_WIDTH * self.top
        while True:
            lower = np.clip(np.searchsorted(self.arrays, centre - width) - first, 0, n) + first
            upper = np.clip(np.searchsorted(self.arrays, centre + width, "right") - first, 0, n) + first
            entered = self._visit(np.concatenate([lower, high]), np.concatenate([low, upper]))
            counts += np.bincount(entered, minlength=n)
            self.visits += len(entered)
            low, high = lower, upper
            if np.count_nonzero(counts >= need) >= enough or (high - low).min() == n:
                having = np.bincount(counts, minlength=USED + 1)[::-1].cumsum()[::-1]  # rows with so many collisions or more
                found = np.flatnonzero(counts >= np.flatnonzero(having >= enough)[-1])
                self.verified += len(found)
                return found
            width *= WIDEN

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k verified rows, without the query's own id."""
        found = self.candidates(query, k)
        found = found[self.ids[found] != own]
        near = np.einsum("ij,j->i", self.rows[found], query)  # one thread, as a task has one core
        if len(found) > k:
            found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9 * self.top * np.sqrt(query @ query)]
        scores = (self.rows[found] * query).sum(axis=1)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][best], scores[best]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return schema.empty_table()
        held = held.sort_by("vec_id")  # as equal candidates are summed in the same order then
        block, parts = Block(_matrix(held["vector"]), held["vec_id"].to_numpy()), []
        for i in range(0, len(asked), QUERIES):
            part = asked.slice(i, QUERIES)
            queries, owns = _matrix(part["vector"]), part["vec_id"].to_numpy()
            found = [block.search(q, own, k) for q, own in zip(queries, owns)]
            own = np.repeat(owns, [len(ids) for ids, _ in found])
            parts.append(pa.table([own, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])], schema=schema))
        return pa.concat_tables(parts)

    return run


def usable(vector: Column) -> Column:
    """True for vectors with finite components, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query among all other rows, ties to smaller ids.

    ``is_query`` is a condition on id_col. Rows with a null id, or with a vector that is null, zero or holds null or
    non-finite components, take no part; vectors are compared only to those of their own length. Of rows that repeat an
    id the smallest vector counts. Fewer candidates than k give fewer rows; an empty table gives an empty result.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).alias("vector"))
    rows = rows.groupBy(id_col).agg(F.min("vector").alias("vector"))
    counts = vectors.where(F.col(id_col).isNotNull()).agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(math.ceil(counts[0] / BLOCK_ROWS), min(math.ceil(counts[0] / LEAST_ROWS), vectors.sparkSession.sparkContext.defaultParallelism), 1)
    asks = max(1, math.ceil(counts[1] / BLOCK_QUERIES))
    home = lambda n: F.pmod(F.xxhash64(F.lit(n), id_col), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = rows.select(F.col(id_col).alias("vec_id"), "vector", F.size("vector").alias("dim"), home(blocks).alias("block"), every(asks).alias("ask"))
    asked = rows.where(is_query).select(F.col(id_col).alias("vec_id"), "vector", F.size("vector").alias("dim"), home(asks).alias("ask"), every(blocks).alias("block"))
    keys = ("dim", "block", "ask")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
