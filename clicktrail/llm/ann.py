"""Approximate nearest neighbours by collision counting over single random projections.

Vectors are dealt into shards of about ``shard_rows`` rows. A shard projects
its vectors on ``projections`` random directions and keeps each projection as
one sorted array. A query opens a window of half-width w around its own
projection in every array; the windows are found by binary search, and a
vector that lies in at least ``threshold`` (a share) of them collides often
enough to be verified, that is, its true distance is computed. Virtual
rehashing widens all windows by the factor ``growth`` and goes on from the
counts' own arrays, without another index, until the ``k``-th best verified
distance r is small enough for the window: half-widths are scaled by the
spread of a projected distance, and the search of a shard stops when
w >= ``reach`` * r / sqrt(dimension), or when every vector has been verified.

The queries, a stated share of the rows, meet the shards in blocks of at most
``block_rows`` vectors each; a shard answers with k rows per query, and the
answers are reduced with partial aggregation. Nothing grows with the square of
a group.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of another dimension than the query's are not
its candidates; with fewer than k candidates all are returned; ties go to the
smaller vec_id; repeated vec_ids other than the query's own are separate
candidates and repeated queries give one answer; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 10
OUT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Search:
    """Parameters of the search (see the module's text)."""

    k: int = K
    projections: int = 48
    threshold: float = 0.8
    growth: float = 1.5
    reach: float = 1.6
    shard_rows: int = 8192
    block_rows: int = 2048
    seed: int = 17


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that take part, as doubles."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


class Shard:
    """Sorted projections of one shard's vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, how: Search):
        self.how, self.ids, self.vectors = how, ids, vectors
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        directions = np.random.default_rng([how.seed, vectors.shape[1]]).standard_normal((vectors.shape[1], how.projections))
        self.directions = directions / np.linalg.norm(directions, axis=0)
        projected = np.ascontiguousarray((vectors @ self.directions).T)  # one row per projection
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.order = order.astype(np.int32)
        # the first half-width holds a few vectors around the middle of each array
        n = len(ids)
        lo, hi = int(n * 0.45), min(n - 1, int(n * 0.55))
        self.width = max(float(np.mean(self.sorted[:, hi] - self.sorted[:, lo])) / 2, 1e-12)

    def verify(self, rows: np.ndarray, q: np.ndarray) -> list[tuple[float, int, int]]:
        """(distance, id, row) of the k nearest of some rows: dot products choose, with room for their rounding, and
        the distances that count are computed from the differences."""
        square = q @ q
        near = self.squares[rows] - 2 * (self.vectors[rows] @ q) + square
        if len(rows) > self.how.k:
            edge = np.partition(near, self.how.k - 1)[self.how.k - 1] + 1e-9 * (square + self.squares[rows].max())
            rows = rows[near <= edge]
        distance = np.sqrt(((self.vectors[rows] - q) ** 2).sum(axis=1))
        return sorted(zip(distance.tolist(), self.ids[rows].tolist(), rows.tolist()))[: self.how.k]

    def search(self, query_id: int, q: np.ndarray) -> list[tuple[float, int]]:
        """The k nearest found, as (distance, row)."""
        how, n = self.how, len(self.ids)
        need = max(1, int(np.ceil(how.threshold * how.projections)))
        at = q @ self.directions
        counts = np.zeros(n, np.int32)
        checked = self.ids == query_id
        best: list[tuple[float, int, int]] = []
        lo = np.array([np.searchsorted(self.sorted[j], at[j]) for j in range(how.projections)])
        hi, width, scale = lo.copy(), self.width, np.sqrt(len(q))
        while True:
            for j in range(how.projections):  # windows grow on both sides of what they held before
                left = self.sorted[j].searchsorted(at[j] - width, "left")
                right = self.sorted[j].searchsorted(at[j] + width, "right")
                counts[self.order[j, left : lo[j]]] += 1
                counts[self.order[j, hi[j] : right]] += 1
                lo[j], hi[j] = min(left, lo[j]), max(right, hi[j])
            fresh = np.flatnonzero((counts >= need) & ~checked)
            if len(fresh):
                checked[fresh] = True
                best = sorted(best + self.verify(fresh, q))[: how.k]
            if checked.all() or len(best) == how.k and width >= how.reach * best[-1][0] / scale:
                return [(d, i) for d, i, _ in best]
            width *= how.growth


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def _search_shard(queries: pa.Table, shard: pa.Table, how: Search) -> pa.Table:
    out: list[tuple[int, int, float]] = []
    if queries.num_rows and shard.num_rows:
        size_q = pc.list_value_length(queries.column("v")).to_numpy()
        size_s = pc.list_value_length(shard.column("v")).to_numpy()
        for dim in np.unique(size_q):
            rows = shard.filter(pa.array(size_s == dim))
            if not rows.num_rows:
                continue
            index = Shard(rows.column("vec_id").to_numpy(), _matrix(rows.column("v")), how)
            asked = queries.filter(pa.array(size_q == dim))
            for qid, q in zip(asked.column("vec_id").to_pylist(), _matrix(asked.column("v"))):
                out += [(qid, i, d) for d, i in index.search(qid, q)]
    q, i, d = zip(*out) if out else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})


def nearest(vectors: DataFrame, is_query: Column, how: Search = Search()) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``usable`` vectors that ``is_query`` (a condition on vec_id) names."""
    queries = vectors.where(is_query).dropDuplicates(["vec_id"])
    rows, asked = vectors.count(), queries.count()
    shards, blocks = max(1, -(-rows // how.shard_rows)), max(1, -(-asked // how.block_rows))
    # every pair of a query block and a shard is one task's work; rows are copied once per block of the other side
    data = vectors.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v"
    )
    ask = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v"
    )
    found = ask.groupBy("shard", "block").cogroup(data.groupBy("shard", "block")).applyInArrow(lambda a, b: _search_shard(a, b, how), OUT)
    return top_k(found, how.k)


def top_k(found: DataFrame, k: int = K) -> DataFrame:
    """The k nearest per query of the shards' answers; the rank filter is applied in each task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
