"""Delta Lloyd: clustering in rounds that look at what changed only, in whole numbers.

Vectors are packed in blocks and written once, bucketed by block. Beside them lie their owners and distances, in a table bucketed alike that is
written anew each round, so that a round joins both without a shuffle and writes some bytes a vector. In a round a vector is compared
with the centroids that changed, and with all of them only if its own owner is one of these. A vector that changes hands is a
transfer: minus its components for the old owner, plus them for the new one. Each task adds its transfers up; they are added to the global sums and counts,
from which the next centroids follow exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

BLOCK = 512  # vectors of a block
LARGEST = 1 << 27  # whole components below it have exact distances and sums in 64 bits
TRANSFERS = -1  # the block number of a task's row of transfers
STATE = "block long, owners array<int>, near array<long>, clusters array<int>, moved array<long>"


def usable(vectors: Column, size: int) -> Column:
    """Whether a vector has `size` components, none null or non-finite."""
    return F.coalesce((F.size(vectors) == size) & F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double."""
    out = np.floor(x.astype(np.float64) * scale)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST // scale} or more: distances would not fit into 64 bits")
    return out.astype(np.int64)


def packed(kept: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows (id, v) as blocks: their number, ids and whole components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0))
                yield pa.record_batch([pa.array([number], pa.int64()), ids, pa.array([x.astype(np.int32).tobytes()], pa.binary())], names=["block", "ids", "x"])
                number += 1

    return kept.mapInArrow(run, "block long, ids array<long>, x binary")


def reassigned(x: np.ndarray, owner: np.ndarray, near: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and squared distance. Vectors with an owner that did not change meet the changed centroids only;
    ties go to the smaller number."""
    lost = (owner < 0) | changed[owner]
    owner, near = np.where(lost, len(centroids), owner), np.where(lost, np.iinfo(np.int64).max, near)
    for c in range(len(centroids)):
        rows = slice(None) if changed[c] else np.flatnonzero(lost)
        apart = x[rows] - centroids[c]
        d = (apart * apart).sum(1)
        better = (d < near[rows]) | ((d == near[rows]) & (c < owner[rows]))
        owner[rows], near[rows] = np.where(better, c, owner[rows]), np.where(better, d, near[rows])
    return owner, near


def round_of(centroids: np.ndarray, changed: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round over blocks (block, x, owners, near); null owners before the first. A task's transfers come last, as one row."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            blocks, xs, owners, nears = (batch.column(c) for c in range(4))
            out: list[list] = [[], [], []]
            for i in range(batch.num_rows):
                x = np.frombuffer(xs[i].as_buffer(), np.int32).reshape(-1, size).astype(np.int64)
                if owners[i].is_valid:
                    owner, near = owners[i].values.to_numpy().astype(np.int64), nears[i].values.to_numpy()
                else:
                    owner, near = np.full(len(x), -1), np.zeros(len(x), np.int64)
                to, apart = reassigned(x, owner, near, centroids, changed)
                for c in range(k):
                    for sign, rows in ((1, (to == c) & (owner != c)), (-1, (owner == c) & (to != c))):
                        if rows.any():
                            moved[c, :size] += sign * x[rows].sum(0)
                            moved[c, size] += sign * np.count_nonzero(rows)
                out[0].append(blocks[i].as_py())
                out[1].append(to.astype(np.int32))
                out[2].append(apart)
            none = pa.nulls(batch.num_rows)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64())), none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.int64()))],
                names=["block", "owners", "near", "clusters", "moved"],
            )
        which = np.flatnonzero(moved.any(1))
        if len(which):
            yield pa.record_batch(
                [pa.array([TRANSFERS], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), pa.array([which.astype(np.int32)], pa.list_(pa.int32())), pa.array([moved[which].reshape(-1)], pa.list_(pa.int64()))],
                names=["block", "owners", "near", "clusters", "moved"],
            )

    return run


def spread(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (ids, owners, near) as a row a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(c).flatten() for c in range(3)], names=["vec_id", "cluster", "distance"])

    return run


class Bucketed:
    """Tables in the shared folder, all bucketed by block into equally many buckets, under names of this run."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets, self.names = scratch, buckets, []

    def keep(self, df: DataFrame, dealt: bool = False) -> DataFrame:
        name = f"lloyd_{uuid.uuid4().hex}"
        df = df.repartition(self.buckets, "block") if dealt else df
        df.write.bucketBy(self.buckets, "block").option("path", f"{self.scratch.root}/{name}").format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.scratch.spark.table(name)

    def drop(self) -> None:
        """Takes the names out of the catalog; the files go with the scratch folder."""
        for name in self.names:
            self.scratch.spark.sql(f"drop table if exists {name}")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:", vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector with `size` components, none null or non-finite.

    Components are floor(scale * x). The centroids begin as the `k` vectors of least sha256 of `salt` and id; a round assigns all vectors (squared Euclidean
    distance, ties to the smaller number) and replaces each centroid that has vectors by floor(sum / count); after the last round they are assigned once more.
    Vectors that repeat, or repeat an id, are vectors each; those without an id come last when centroids are chosen (by components, as do equal ids). Fewer
    vectors than `k` give so many centroids, none an empty table. Components of 2**27 / scale or more are a ValueError. Other columns aren't looked at.
    On the driver lie k * (size + 1) sums, whatever the number of vectors; so much is each task's row of transfers at most.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where(usable(F.col("v"), size))
    drawn = kept.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    first = drawn.orderBy(F.asc_nulls_last("h"), F.asc_nulls_last("id"), "v").limit(k).collect()
    n = kept.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = whole(np.array([r.v for r in first], np.float64).reshape(-1, size), scale)
    k = len(centroids)

    scratch = Scratch(spark)
    buckets = int(min(100_000, max(-(-n // 131_072), min(spark.sparkContext.defaultParallelism, -(-n // BLOCK)))))
    tables, rest = Bucketed(scratch, buckets), Scratch(spark)
    blocks = tables.keep(packed(kept, size, scale), dealt=True)
    state, changed, sums = None, np.ones(k, bool), [[0] * (size + 1) for _ in range(k)]
    for turn in range(rounds + 1):
        if state is None:
            joined = blocks.select("block", "x", F.lit(None).cast("array<int>").alias("owners"), F.lit(None).cast("array<long>").alias("near"))
        else:
            joined = blocks.select("block", "x").join(state.select("block", "owners", "near"), "block")
        state = tables.keep(joined.mapInArrow(round_of(centroids, changed), STATE))
        if turn == rounds:
            break
        each = state.where(F.col("block") == TRANSFERS).select("clusters", F.posexplode("moved").alias("at", "amount"))
        at = F.col("at").cast("int")
        for r in each.groupBy(F.element_at("clusters", (at / (size + 1)).cast("int") + 1).alias("c"), (at % (size + 1)).alias("j")).agg(F.sum(F.col("amount").cast("decimal(19,0)")).alias("s")).collect():
            sums[r.c][r.j] += int(r.s)
        after = np.array([[s // row[size] for s in row[:size]] if row[size] else old for row, old in zip(sums, centroids.tolist(), strict=True)], np.int64)
        changed, centroids = (after != centroids).any(1), after
        if not changed.any():
            break

    rows = blocks.select("block", "ids").join(state.select("block", "owners", "near"), "block").select("ids", "owners", "near")
    told = rest.keep(rows.mapInArrow(spread(size), "vec_id long, cluster int, distance long"), "told")
    tables.drop()
    scratch.clear()
    within = {r.cluster: int(r.s) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.col("cluster") + 1
    return told.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*(F.lit(within.get(c, 0)).cast("long") for c in range(k))), own).alias("cluster_inertia"),
        F.lit(sum(within.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), own).alias("centroid_sha256"),
    )
