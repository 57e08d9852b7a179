"""Ranked lexical search over dual-sorted wavelet trees.

Documents lie in shards of bounded size, in the order of their ids. A shard's postings of a term are ordered by impact, the highest first, and all lists
stand one behind the other as one sequence of document numbers, over which a wavelet tree is kept (level by level: a level's bits are the next bit of each
number, and the next level has all zeros first, then all ones, each in their order). So a node of the tree is a range of documents, and a list's part in it
is a range of places, still by impact: its first posting bounds all of them. A query starts with its terms' lists at the root; the nodes of the highest bounds
(over all terms) are opened first, a document's node has its exact score, and nodes that can't reach the k best so far are never opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import Scratch

MOST_DOCS, MOST_POSTINGS = 4096, 1 << 20  # of a shard, but one document is never divided
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
WORDS = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_ID = np.iinfo(np.int64).max  # stands for a null id: last of equal scores
SHARD = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms string, starts array<int>, docs binary, counts binary"
TREE = "ids array<long>, sizes array<long>, terms string, starts array<int>, counts binary, bits binary"


def term_counts(text: bytes) -> Counter:
    """How often each term occurs; a long text is read in parts, cut at separators."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        part = text[at : at + (4 << 20)].translate(WORDS)
        if at + len(part) < len(text):
            cut = part.rfind(b" ")
            if cut < 0:  # one term of some MB
                part = text[at:].translate(WORDS)
                cut = part.find(b" ")
            part = part[: cut + 1] if cut >= 0 else part
        found.update(part.split())
        at += len(part)
    return found


class Gathered:
    """The documents of a shard to be."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.which: list[np.ndarray] = []
        self.often: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, found: Counter) -> None:
        terms = self.terms
        self.which.append(np.array([terms.setdefault(t, len(terms)) for t in found], np.int32))
        self.often.append(np.fromiter(found.values(), np.uint32, len(found)))
        self.ids.append(doc_id)
        self.sizes.append(int(self.often[-1].sum(dtype=np.int64)))
        self.n += len(found)

    def shard(self) -> pa.RecordBatch:
        """Documents by id (null last), postings by term and document."""
        key = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((np.array([i is None for i in self.ids]), key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = np.concatenate(self.which)
        doc = np.repeat(place, [len(w) for w in self.which])
        by = np.lexsort((doc, term))
        starts = np.searchsorted(term[by], np.arange(len(self.terms) + 1)).astype(np.int32)
        values = [
            pa.array([len(order)], pa.int64()),
            pa.array([sum(self.sizes)], pa.int64()),
            pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())),
            pa.array([[self.sizes[i] for i in order]], pa.list_(pa.int64())),
            pa.array([b"\n".join(self.terms).decode("utf-8", "replace")], pa.string()),
            pa.array([starts], pa.list_(pa.int32())),
            pa.array([doc[by].astype(np.uint32).tobytes()], pa.binary()),
            pa.array([np.concatenate(self.often)[by].tobytes()], pa.binary()),
        ]
        return pa.record_batch(values, names=[f.split()[0] for f in SHARD.split(", ")])


def shards(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The postings of documents with a term or more, in shards packed where the documents lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Gathered()
        for batch in batches:
            for k in range(batch.num_rows):
                found = term_counts(batch.column(1)[k].as_py() or b"")
                if found:
                    now.add(batch.column(0)[k].as_py(), found)
                if now.n >= MOST_POSTINGS or len(now.ids) >= MOST_DOCS:
                    yield now.shard()
                    now = Gathered()
        if now.ids:
            yield now.shard()

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(run, SHARD)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth in documents of relative length m, before a term's weight."""
    tf = counts.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def lengths(sizes: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document: 10, and 90 for a document of average length."""
    return np.array([10 + (90 * n * n_docs) // n_terms for n in sizes], np.int64)


def depth(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def trees(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Each shard's lists by falling impact, and the bits of the wavelet tree over their document numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, terms, starts, docs, counts = (batch.column(c)[k] for c in range(6))
                doc, count, start = np.frombuffer(docs.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint32), starts.values.to_numpy()
                worth = impacts(count, lengths(sizes.as_py(), n_docs, n_terms)[doc])
                order = np.lexsort((doc, -worth, np.repeat(np.arange(len(start) - 1), np.diff(start))))
                doc, count = doc[order], count[order]
                levels, bits = depth(len(ids.values)), []
                for level in range(levels - 1, -1, -1):
                    bit = (doc >> level) & 1
                    bits.append(np.packbits(bit.astype(bool)))
                    doc = np.concatenate([doc[bit == 0], doc[bit == 1]])
                values = [batch.column(c).slice(k, 1) for c in range(4)]
                yield pa.record_batch([*values, pa.array([count.tobytes()], pa.binary()), pa.array([np.concatenate(bits).tobytes()], pa.binary())], names=[f.split()[0] for f in TREE.split(", ")])

    return postings.select("ids", "sizes", "terms", "starts", "docs", "counts").mapInArrow(run, TREE)


class Tree:
    """A shard's wavelet tree made ready: ones before each place of each level, and the impacts at each level's places."""

    def __init__(self, ids: list[int | None], sizes: list[int], starts: np.ndarray, counts: np.ndarray, bits: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.starts, n = ids, starts, len(counts)
        self.keys = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.levels = depth(len(ids))
        bit = np.unpackbits(bits.reshape(self.levels, -1), axis=1)[:, :n].astype(bool)
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        np.cumsum(bit, axis=1, out=self.ones[:, 1:])
        self.zeros = (n - self.ones[:, -1]).astype(np.int32)
        place = np.arange(n, dtype=np.int32)  # of the root, at each place of a level
        places, doc = [place], np.zeros(n, np.uint32)
        for level in range(self.levels):
            place = np.concatenate([place[~bit[level]], place[bit[level]]])
            places.append(place)
        for level in range(self.levels):  # a root posting's document: its bits on the way down
            doc[places[level]] = (doc[places[level]] << 1) | bit[level]
        worth = impacts(counts, lengths(sizes, n_docs, n_terms)[doc]).astype(np.int32)
        self.worth = np.stack([worth[p] for p in places])

    def bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that a document of each node can score; a document's own node gives its score."""
        some = high > low
        first = self.worth[level[:, None], np.where(some, low, 0)].astype(np.int64)
        return (np.where(some, first, 0) * weights).sum(1)


class Best:
    """The k best documents of some queries so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.zeros((queries, k), np.int64)
        self.key = np.full((queries, k), NO_ID)
        self.known = np.zeros((queries, k), bool)  # whether the id is one (not null)

    def bar(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a document must reach: a score, and with just that score an id of this or less."""
        score, key = self.score[queries, -1], self.key[queries, -1]
        return np.maximum(score, 1), np.where(score > 0, key, NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray, known: np.ndarray) -> None:
        some = np.unique(query)
        q = np.concatenate([np.repeat(some, self.k), query])
        s, i, n = (np.concatenate([a[some].reshape(-1), b]) for a, b in ((self.score, score), (self.key, key), (self.known, known)))
        order = np.lexsort((i, -s, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[rank < self.k]
        self.score[some], self.key[some], self.known[some] = (a[order].reshape(-1, self.k) for a in (s, i, n))


def best_first(tree: Tree, queries: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best, each: int = 16) -> None:
    """Opens, for each of some queries in step, the `each` nodes of the highest bounds, until no node left can reach the k best. `terms` are list
    numbers of the shard, -1 where a query has fewer."""
    low = np.where(terms >= 0, tree.starts[terms], 0)
    high = np.where(terms >= 0, tree.starts[terms + 1], 0)
    row, level, node = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    bound = tree.bounds(level, low, high, weights)
    while len(row):
        score, key = best.bar(queries[row])
        least = tree.keys[node << (tree.levels - level)]  # the node's first id
        may = np.flatnonzero((bound > score) | ((bound == score) & (least <= key)))
        order = may[np.lexsort((-bound[may], row[may]))]
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        now, wait = order[rank < each], order[rank >= each]
        ones_low, ones_high = tree.ones[level[now][:, None], low[now]], tree.ones[level[now][:, None], high[now]]
        zeros = tree.zeros[level[now]][:, None]
        to_low, to_high = np.concatenate([low[now] - ones_low, zeros + ones_low]), np.concatenate([high[now] - ones_high, zeros + ones_high])
        to_row, to_level = np.concatenate([row[now]] * 2), np.concatenate([level[now] + 1] * 2)
        to_node = np.concatenate([node[now] * 2, node[now] * 2 + 1])
        to_bound = tree.bounds(to_level, to_low, to_high, weights[to_row])
        leaf = np.flatnonzero((to_level == tree.levels) & (to_bound > 0))
        if len(leaf):
            docs = to_node[leaf]
            best.add(queries[to_row[leaf]], to_bound[leaf], tree.keys[docs], np.array([tree.ids[d] is not None for d in docs.tolist()]))
        inner = np.flatnonzero((to_level < tree.levels) & (to_bound > 0))
        row, level, node, bound = (np.concatenate([a[wait], b[inner]]) for a, b in ((row, to_row), (level, to_level), (node, to_node), (bound, to_bound)))
        low, high = np.concatenate([low[wait], to_low[inner]]), np.concatenate([high[wait], to_high[inner]])


def words(text: Column) -> Column:
    """The terms of a text, with repeats."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({PATTERN})"), 1)


def weighted(items: DataFrame, index: DataFrame, n_docs: int, text: str, id_column: str) -> DataFrame:
    """Each item's terms that a document has, and their weights."""
    asked = items.select(F.col(id_column).alias("item_id"), F.explode(words(F.col(text).cast("string"))).alias("term")).distinct()
    lists = index.select("starts", F.posexplode(F.split("terms", "\n")).alias("at", "term")).select("term", (F.col("starts")[F.col("at") + 1] - F.col("starts")[F.col("at")]).cast("long").alias("n"))
    held = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(held, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("terms"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id", most_terms: int = 200_000) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k documents of the highest scores above 0, equal scores by doc_id.

    Null and empty texts, and texts without a term, are no documents; rows that repeat an id are documents each, those without an id come last of equal
    scores. Rows of one item_id are one item, with the terms of all; null is one item too. Terms count once an item. Other columns aren't looked at, an
    empty table on either side gives an empty one. A very long text is counted in parts and is a shard of its own at most.

    The index (postings, then trees) is written to the shared folder. Items are taken in blocks of about `most_terms` terms, so that what is sent to all tasks is
    bounded; a block is one pass over the trees, in which a task carries each item's k best from shard to shard and gives k rows an item at the end.
    """
    spark = docs.sparkSession
    scratch, out = Scratch(spark), Scratch(spark)
    postings = scratch.keep(shards(docs, text, id_column), "postings")
    total = postings.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    kind = items.schema[item_id].dataType
    n_docs, n_terms = total.docs or 0, total.terms or 0
    if not n_docs:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind)])).select("item_id", *(F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("doc_id", "long"), ("score", "long"))))
    index = scratch.keep(trees(postings, n_docs, n_terms), "trees")
    scratch.drop(postings)
    asked = scratch.keep(weighted(items, index, n_docs, item_text, item_id), "asked")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms))
    fields = to_arrow_schema(T.StructType([T.StructField("item_id", kind), *T.StructType.fromDDL("doc_id long, score long")]))
    found = []
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # bounded by the size of a block
        some.sort(key=lambda r: len(r.terms))  # so that items of like size go in step
        shared = spark.sparkContext.broadcast([(r.item_id, [(t.term, t.w) for t in r.terms]) for r in some])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asking = shared.value
            wanted = {t for _, terms in asking for t, _ in terms}
            best = Best(len(asking), k)
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, sizes, terms, starts, counts, bits = (batch.column(c)[row] for c in range(6))
                    place = {t: p for p, t in enumerate(terms.as_py().split("\n")) if t in wanted}
                    tree = Tree(ids.as_py(), sizes.as_py(), starts.values.to_numpy(), np.frombuffer(counts.as_buffer(), np.uint32), np.frombuffer(bits.as_buffer(), np.uint8), n_docs, n_terms)
                    mine = [(q, [(place[t], w) for t, w in said if t in place]) for q, (_, said) in enumerate(asking)]
                    mine = [(q, said) for q, said in mine if said]
                    while mine:
                        wide = max(len(said) for _, said in mine[-64:])
                        group = max(1, min(64, 2048 // wide))
                        part, mine = mine[-group:], mine[:-group]
                        at, weights = np.full((len(part), wide), -1, np.int64), np.zeros((len(part), wide), np.int64)
                        for r, (_, said) in enumerate(part):
                            at[r, : len(said)], weights[r, : len(said)] = zip(*said, strict=True)
                        best_first(tree, np.array([q for q, _ in part]), at, weights, best)
            query, rank = np.nonzero(best.score)
            keys = pa.array(best.key[query, rank], mask=~best.known[query, rank])
            yield pa.record_batch([pa.array([asking[q][0] for q in query.tolist()], fields[0].type), keys, pa.array(best.score[query, rank])], schema=fields)

        found.append(out.keep(index.mapInArrow(run, f"item_id {kind.simpleString()}, doc_id long, score long"), f"found{block}"))
        shared.unpersist()
    scratch.clear()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
