"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors are packed in blocks. Within a block every dimension has its list of vectors sorted by component, and each vector's length is
known. For a query the lists are read in steps, from the high end where its component is positive, else from the low end. What was read
of a vector adds up; what wasn't can't be more than the lists' present ends allow, nor more than the unread parts' lengths do (Cauchy and
Schwarz); so much for its upper bound, and likewise for its lower. Reading for a query stops once few vectors outside its k best lower bounds
can still reach them; the lists are then read on for those inside alone, which resolves their scores. All queries of a block read in
step, so that the bounds of a step are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "dims int, n int, ids binary, vectors binary"
OUT = "query_id long, vec_id long, score long"


def scaled(vectors: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as doubles; null for vectors that are null or hold a null or non-finite component."""
    whole = F.transform(vectors, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    good = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, whole)


class Lists:
    """The sorted lists of a block: for each dimension the vectors' places by falling component, and the components."""

    def __init__(self, x: np.ndarray):
        self.n, self.dims = x.shape
        self.order = np.argsort(-x, 0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0)
        self.columns = np.broadcast_to(np.arange(self.dims), x.shape)
        self.squares = (x.astype(np.float64) ** 2).sum(1)

    def read(self, depth: int) -> list[tuple[np.ndarray, ...]]:
        """After `depth` entries of every list from its high end, then from its low end: what was read (0 elsewhere), where nothing was (1, else
        0), and the least and the most that components not read can be."""
        out = []
        for low in (False, True):
            part = slice(self.n - depth, self.n) if low else slice(0, depth)
            read, open_ = np.zeros((self.n, self.dims), self.values.dtype), np.ones((self.n, self.dims), self.values.dtype)
            read[self.order[part], self.columns[part]] = self.values[part]
            open_[self.order[part], self.columns[part]] = 0
            here = self.values[self.n - depth if low else depth - 1]  # where the lists are now
            out.append((read, open_, here, self.values[0]) if low else (read, open_, self.values[-1], here))
        return out

    def resolved(self, places: np.ndarray) -> np.ndarray:
        """The whole vectors at some places, by reading the lists through once more for these alone."""
        where = np.full(self.n, -1)
        where[places] = np.arange(len(places))
        row = where[self.order]
        out = np.zeros((len(places), self.dims), self.values.dtype)
        out[row[row >= 0], self.columns[row >= 0]] = self.values[row >= 0]
        return out


def bounds(q: np.ndarray, lists: Lists, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query and vector the least and the most that the score can be after `depth` entries of each list."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    (high, high_open, high_least, high_most), (low, low_open, low_least, low_most) = lists.read(depth)
    seen = plus @ high.T + minus @ low.T
    lower = seen + plus @ (high_open * high_least).T + minus @ (low_open * low_most).T
    upper = seen + plus @ (high_open * high_most).T + minus @ (low_open * low_least).T
    mine = (plus * plus) @ high_open.T + (minus * minus) @ low_open.T
    known = (q > 0).astype(q.dtype) @ (high * high).T + (q <= 0).astype(q.dtype) @ (low * low).T
    slack = lists.dims * 2.0**-22  # more than rounding to 32 bits may take from a sum of so many squares
    reach = (lists.squares * (1 + 2 * slack)).astype(q.dtype)
    rest = np.sqrt(mine * np.maximum(reach - known, 0)) * q.dtype.type(1 + slack) + q.dtype.type(1)
    return np.maximum(lower, seen - rest), np.minimum(upper, seen + rest)


def top_k(queries: np.ndarray, query_ids: np.ndarray, lists: Lists, ids: np.ndarray, k: int, steps: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and places and scores of the k best vectors of a block but its own; ties to smaller ids, all that tie at the end included by id."""
    own = query_ids[:, None] == ids[None]
    step = max(1, -(-lists.n // steps))
    depth, open_ = min(lists.n, 2 * step), np.arange(len(queries))  # nothing closes in the first steps
    inside: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    while len(open_):
        lower, upper = bounds(queries[open_], lists, depth)
        lower[own[open_]], upper[own[open_]] = -np.inf, -np.inf
        at = min(k, lists.n) - 1
        bar = -np.partition(-lower, at, 1)[:, at]
        may = (upper >= bar[:, None]) & ~own[open_]
        few = (may.sum(1) <= max(8 * k, lists.n // 16)) | (depth == lists.n)
        for row in np.flatnonzero(few):
            inside[open_[row]] = np.flatnonzero(may[row])
        open_ = open_[~few]
        depth = min(lists.n, depth + step)
    needed = np.unique(np.concatenate(inside)) if inside else np.zeros(0, np.int64)
    vectors = lists.resolved(needed)
    for i, places in enumerate(inside):
        scores = vectors[np.searchsorted(needed, places)] @ queries[i]
        best = np.lexsort((ids[places], -scores))[:k]
        yield i, places[best], scores[best]


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, v) as blocks of up to `most` vectors of one length, packed where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            got = waiting.pop(dims)
            ids, x = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            return pa.record_batch([pa.array([dims], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["dims", "n", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.float64)
            sizes = np.diff(ends)
            for dims in np.unique(sizes).tolist():
                rows_of = np.flatnonzero(sizes == dims)
                x = flat[ends[rows_of][:, None] + np.arange(dims)]
                for low in range(0, len(rows_of), most):
                    waiting.setdefault(dims, []).append((ids[rows_of[low : low + most]], x[low : low + most]))
                    if sum(len(w[0]) for w in waiting[dims]) >= most:
                        yield block(dims)
        for dims in list(waiting):
            yield block(dims)

    return rows.mapInArrow(run, BLOCK)


def search(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", id_column: str = "vec_id", block: int = 8192, queries_in_block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best of all other rows, by the inner product of floor(256 * x).

    Ties go to the smaller vec_id; a query with fewer than k others gets all. Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without an id; vectors meet those of their own length. Rows that repeat an id are other
    rows' candidates each, but never their own id's. Scores are exact below 2**53. Candidates are packed in blocks where they lie, queries
    in blocks too; blocks of both are dealt to a grid of tasks, and each two meet once, in the cell of their row and column.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), scaled(F.col(vector)).alias("v"), is_query.alias("q")).where("v is not null and id is not null")
    asked = rows.where("q").select("id", "v").distinct()
    per = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked")).first()
    wide, high = max(1, -(-per.asked // queries_in_block)), max(1, -(-per.n // block))
    side = max(1, min(8, int((wide * high / (2 * vectors.sparkSession.sparkContext.defaultParallelism)) ** 0.5)))
    across, down = -(-wide // side), -(-high // side)  # cells of about side * side pairs of blocks: a candidate block is sent to `across` tasks, not to every query block
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = packed(asked.repartition(wide, "id"), queries_in_block).withColumn("c", F.pmod(F.xxhash64("ids"), F.lit(across))).withColumn("r", every(down))
    there = packed(rows.select("id", "v"), block).withColumn("r", F.pmod(F.xxhash64("ids"), F.lit(down))).withColumn("c", every(across))

    def cell(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
        for row in (r for b in candidates.to_batches() for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
            lists = None
            for ask in (r for b in queries.to_batches() for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist() if r["dims"] == row["dims"]):
                asking, y = np.frombuffer(ask["ids"], np.int64), np.frombuffer(ask["vectors"], np.float64).reshape(ask["n"], ask["dims"])
                small = row["dims"] and row["dims"] * np.abs(x).max() * np.abs(y).max() < 1 << 24  # whole numbers that are exact as 32-bit floats too
                kind = np.float32 if small else np.float64
                if lists is None or lists.values.dtype != kind:
                    lists = Lists(x.astype(kind))
                for i, places, scores in top_k(y.astype(kind), asking, lists, ids, k):
                    found.append([np.full(len(places), asking[i]), ids[places], scores.astype(np.int64)])
        return pa.table([np.concatenate([f[c] for f in found]) for c in range(3)], names=["query_id", "vec_id", "score"])

    found = there.groupBy("r", "c").cogroup(asked.groupBy("r", "c")).applyInArrow(cell, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
