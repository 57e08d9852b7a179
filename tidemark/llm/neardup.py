"""Near-duplicate documents by SuperMinHash: signatures, banding, verification on the full shingle sets, connected groups.

Documents of one shingle set form a class, and all later work is on classes, so a passage copied a million times is one row.
Two classes that share a band are a candidate pair, but pairs are not formed all against all: the least class of each bucket,
its hub, is checked against the others. Where that leaves a hub's buckets in several groups, their classes are packed in
blocks, and two blocks at a time are checked by a matrix product that tells all their intersections at once; of what it finds
only links between groups that are still apart are given out. So no candidate is left out, and rows stay as many as classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, id_marks, told_apart
from tidemark.llm.superminhash import signatures
from tidemark.llm.words import SPACED, mixed, slices

WORDS, ROWS, BANDS = 5, 4, 28  # of 1 / 40,000 of the pairs at 0.75 no band agrees, of fewer at more
SIGNED = "doc_id long, n_shingles long, cls long, bands array<long>"


def distinct_sets(sets: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elements of each set, and their sets."""
    at = np.searchsorted(of, np.arange(n + 1))
    parts = []
    for i in range(n):
        x = np.sort(sets[at[i] : at[i + 1]])
        parts.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return np.concatenate(parts) if parts else sets, np.repeat(np.arange(n), [len(p) for p in parts])


def digests(sets: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, whatever the order of its elements."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def signed(docs: DataFrame, words: int, rows: int, bands: int, text: str, id_column: str, hashed: bool = False) -> DataFrame:
    """doc_id, set size, class and band keys of every row; with `hashed`, its text_hash too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part, s in slices(batch, 1, SPACED):
                sets, of = distinct_sets(*s.shingles(s.hashes(), words), s.n)
                sizes = np.bincount(of, minlength=s.n)
                values = signatures(sets, of, s.n, rows * bands).reshape(s.n, bands, rows)
                keys = np.zeros((s.n, bands), np.uint64) + salt
                for r in range(rows):
                    keys = mixed(keys ^ values[:, :, r]) + salt
                some = sizes > 0
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                out = pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(digests(sets, of, sizes), mask=~some),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "cls", "bands"],
                )
                for c in part.schema.names[2:]:
                    out = out.append_column(c, part.column(c))
                yield out

    more = [F.xxhash64(F.col(text).cast("string")).alias("text_hash")] if hashed else []
    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string"), *more).mapInArrow(run, SIGNED + (", text_hash long" if hashed else ""))


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, text: str, id_column: str, scratch: Scratch) -> DataFrame:
    """cls and the sorted shingle hashes of the rows with a wanted id (and of a few more), so that no text need be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in slices(batch, 0, SPACED):
                sets, of = distinct_sets(*s.shingles(s.hashes(), words), s.n)
                sizes = np.bincount(of, minlength=s.n)
                some = sizes > 0
                ends = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(digests(sets, of, sizes)[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))],
                    names=["cls", "elements"],
                )

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    return told_apart(rows, F.col("i"), *id_marks(wanted, "rep", scratch))[0].select("t").mapInArrow(run, "cls long, elements array<long>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (the least node reachable) for the nodes of undirected edges (a, b); labels spread and jump until none changes."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("best"))
        step = labels.join(near, labels.node == near.a).select("node", "comp", F.least("comp", "best").alias("best"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        fresh = scratch.keep(step.join(jump, step.best == jump.via, "left").select("node", F.least("best", F.coalesce("far", "best")).alias("comp"), F.col("comp").alias("was")), "labels")
        if fresh.where("comp <> was").limit(1).count() == 0:
            scratch.drop(both)
            return fresh.drop("was")
        labels = fresh.drop("was")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = 75, rows: int = ROWS, bands: int = BANDS, block: int = 1024, block_bytes: int = 4 << 20, text: str = "text", id_column: str = "doc_id", scratch: Scratch | None = None, hashed: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; with `hashed`, text_hash (xxhash64) too, which tells rows that repeat an id apart.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A set holds the distinct `words`-word shingles, or the whole sequence
    where there are fewer words; documents link where 100 * intersection >= percent * union, checked on the full sets.
    Null and empty texts have empty sets and link with nothing. Rows that repeat an id are matched by their own text. A row
    without an id is its own group: component_id null, kept. component_id is the least id of the group; other columns are not
    looked at, so clashing names do no harm.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    table = scratch.keep(signed(docs, words, rows, bands, text, id_column, hashed), "signed")
    classes = scratch.keep(table.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("cls", "n", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min(F.struct("cls", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = scratch.keep(banded.join(hubs, "band").select("band", "cls", "n", "hub"), "crowd")

    apart = F.col("cls") != F.col("hub.cls")
    near = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent  # sizes alone rule other links out
    pairs = scratch.keep(crowd.where(apart & near).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    met = crowd.where(apart).select(F.col("hub.cls").alias("hub"), "cls", "n").distinct()
    sets = _sets_of(docs, classes, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), words, text, id_column, scratch)
    links = scratch.keep(_verified(pairs, sets, percent), "links")
    labels = components(links, scratch)
    placed = scratch.keep(met.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("hub", "cls", "n", F.coalesce("comp", "cls").alias("comp")), "placed")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") * 8 / block_bytes))  # of some classes each, and of some bytes each
    apart_ = placed.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), blocks.alias("blocks")).where("low < high")
    mixed_ = scratch.keep(spread(placed.drop("n"), apart_.select("hub", "blocks"), "hub", "cls"), "mixed")
    missing = mixed_.select("cls").distinct().join(sets, "cls", "left_anti")
    sets = sets.union(_sets_of(docs, classes, missing, words, text, id_column, scratch))
    found = scratch.keep(_between_blocks(mixed_, sets, percent, scratch), "links")
    if found.limit(1).count():
        links = links.union(found)
        labels = components(links, scratch)
    members = classes.select("cls", "rep").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    least = members.groupBy("comp").agg(F.min("rep").alias("component_id"))
    grouped = members.join(least, "comp").select("cls", "component_id")
    grouped = grouped.withColumnRenamed("cls", "its")
    more = ["text_hash"] if hashed else []
    out = table.select("doc_id", "n_shingles", "cls", *more).join(grouped, (F.col("cls") == F.col("its")) & F.col("doc_id").isNotNull(), "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), *more)


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, text: str, id_column: str, scratch: Scratch) -> DataFrame:
    """cls and elements of the wanted classes, made from one text of each."""
    wanted = scratch.keep(wanted.join(classes.select("cls", "rep"), "cls").select("cls", "rep"), "wanted")
    made = full_sets(docs, wanted, words, text, id_column, scratch).join(wanted.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("elements").alias("elements"))
    return scratch.keep(made, "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, share: int = 256) -> DataFrame:
    """The pairs whose full sets are alike enough. A hub of many pairs is dealt to several tasks, `share` pairs each."""
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).alias("deals"))
    left = load.join(sets, load.a == sets.cls).select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("elements").alias("x"))
    dealt = spread(pairs, load, "a", "b").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).alias("deal"))
    right = dealt.join(sets, dealt.b == sets.cls).select("a", "b", "deal", F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return right.join(left, ["a", "deal"]).select("a", "b", both.alias("both"), (F.size("x") + F.size("y") - both).alias("all")).where(F.col("both") * 100 >= F.col("all") * percent).select("a", "b")


def spread(rows: DataFrame, one: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """rows joined with the one row of each key: a key of many rows is dealt to `salts` tasks by a hash of `by`."""
    salted = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b: frequent elements by a matrix product, rare ones pair by pair."""
    flat = np.concatenate([*a, *b])
    names, code = np.unique(flat, return_inverse=True)
    at = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    left = at < len(a)
    k = [np.bincount(code[left], minlength=len(names)), np.bincount(code[~left], minlength=len(names))]
    product = k[0] * k[1]
    out = np.zeros((len(a), len(b)), np.int64)
    frequent = np.flatnonzero(product >= 4096)
    for low in range(0, len(frequent), 4096):
        column = np.full(len(names), -1)
        part = frequent[low : low + 4096]
        column[part] = np.arange(len(part))
        x, y = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        c = column[code]
        x[at[left & (c >= 0)], c[left & (c >= 0)]] = 1
        y[at[~left & (c >= 0)] - len(a), c[~left & (c >= 0)]] = 1
        out += (x @ y.T).astype(np.int64)  # at most 4,096 each, which 32 bits hold
    rare = (product > 0) & (product < 4096)
    order = np.flatnonzero(~left & rare[code])
    order = order[np.argsort(code[order], kind="stable")]  # b's entries by element
    ends = np.searchsorted(code[order], np.arange(len(names) + 1))
    mine = np.flatnonzero(left & rare[code])
    for low in range(0, len(mine), 8192):
        e = mine[low : low + 8192]
        count = k[1][code[e]]
        first = np.repeat(ends[code[e]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        other = at[order[first + np.arange(count.sum())]] - len(a)
        out += np.bincount(np.repeat(at[e], count) * len(b) + other, minlength=out.size).reshape(out.shape)
    return out


def joining(a: list[tuple], b: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between members (cls, comp, elements) of two blocks, only as many as it takes to join the groups that are linked."""
    x, y = [np.asarray(m[2], np.int64) for m in a], [np.asarray(m[2], np.int64) for m in b]
    both = intersections(x, y)
    size = np.add.outer([len(s) for s in x], [len(s) for s in y])
    linked = both * (100 + percent) >= percent * size
    linked &= np.not_equal.outer([m[1] for m in a], [m[1] for m in b])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    out = []
    for i, j in zip(*(z.tolist() for z in np.nonzero(linked)), strict=True):
        p, q = root(a[i][1]), root(b[j][1])
        if p != q:
            parent[p] = q
            out.append((a[i][0], b[j][0]))
    return out


def _between_blocks(mixed_: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different groups of the same hub: each block of classes is one row, each two blocks of a hub meet once, in the
    task that their three numbers (hub, i, j) are dealt to."""
    blocks = mixed_.join(sets, "cls").groupBy("hub", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), "blocks").agg(F.collect_list(F.struct("cls", "comp", "elements")).alias("members"))
    blocks = scratch.keep(blocks, "blocks")
    left = blocks.select("hub", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "members")
    right = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), "members")

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        found = joining(_members(x), _members(y), percent) if x.num_rows and y.num_rows else []
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub", "i", "j")).applyInArrow(met, "a long, b long")


def _members(block: pa.Table) -> list[tuple]:
    rows = block.column("members").combine_chunks().flatten()
    lists = rows.field("elements")
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [(c, g, flat[s:e]) for c, g, s, e in zip(rows.field("cls").to_pylist(), rows.field("comp").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
