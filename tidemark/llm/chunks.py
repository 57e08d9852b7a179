"""Passages that repeat, across documents or within one, by content-defined chunks.

A gear hash rolls over a text's words (h = 2**16 h + word, so that its 64 bits see the last 4 words, of whatever length; a text begins
with none). A chunk ends after a word whose hash is the least of some `span` neighbouring words: cuts depend on nearby content alone,
an insertion shifts none beyond its neighbourhood, and two cuts are never more than `span` words apart. Each two neighbouring chunks have a digest; where
it also stands in a document with a smaller id, or earlier in the same text, they are a repeat, and overlapping repeats make a passage. (Single chunks would
also join short lines that are common for themselves.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, free_name, id_marks, told_apart
from tidemark.llm.decontaminate import without
from tidemark.llm.words import BASE, SPACED, Slice, mixed, slices

PAIRS = "doc_id long, text_hash long, digest long, begin int, middle int, end int, words int, next_words int, again boolean"


def gear_hashes(s: Slice, hashes: np.ndarray) -> np.ndarray:
    """The rolling hash after each word: the sum of hashes[i - k] << 16 k for k < 4 words of the same text, by doubling."""
    h, place = hashes.copy(), np.arange(len(hashes)) - s.word_at[s.text_of]
    for step in (1, 2):
        h[step:] = h[step:] + np.where(place[step:] >= step, h[:-step] << np.uint64(16 * step), np.uint64(0))
    return mixed(h)  # the low bits must see all words too


def cuts(s: Slice, span: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Whether each word ends a chunk: its hash is the least (the last of equals) in some `span` neighbouring words of its text. A text's last word does."""
    n = len(s.end)
    ends = np.zeros(n, bool)
    if not n:
        return ends
    ends[s.word_at[1:][s.n_words > 0] - 1] = True
    h = gear_hashes(s, s.hashes() if hashes is None else hashes)
    if n >= span:
        windows = np.lib.stride_tricks.sliding_window_view(h, span)[:, ::-1]
        inside = s.text_of[: n - span + 1] == s.text_of[span - 1 :]
        least = np.arange(span - 1, n) - windows.argmin(1)
        ends[least[inside]] = True
    return ends


def chunk_pairs(docs: DataFrame, span: int = 10, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, text_hash (xxhash64), digest (of the words, A-Z lower-cased, whatever the blanks between), byte places and words of each two
    neighbouring chunks, and whether the same two stand earlier in the text.

    A chunk's bytes run up to the next chunk's first word, a text's last chunk's to the end of its last word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch, 2, SPACED):
                h = s.hashes()
                last = np.flatnonzero(cuts(s, span, h))
                first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)]
                words, of = last - first + 1, s.text_of[last]
                place = (np.arange(len(h)) - np.repeat(first, words)).astype(np.int64)
                power = np.array([pow(int(BASE), k, 1 << 64) for k in range(int(place.max(initial=0)) + 1)], np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[place], dtype=np.uint64)])
                digest = mixed(total[last + 1] - total[first] + words.astype(np.uint64))
                two = np.flatnonzero(of[1:] == of[:-1])  # a chunk with one after it
                both = mixed(digest[two] * BASE + digest[two + 1])
                order = np.lexsort((two, both, of[two]))
                again = np.zeros(len(two), bool)
                again[order[1:]] = (both[order[1:]] == both[order[:-1]]) & (of[two][order[1:]] == of[two][order[:-1]])
                origin, begin = s.at[of], s.begin[first]
                ends = np.where(np.concatenate([of[1:] != of[:-1], [True]])[: len(last)], s.end[last], np.concatenate([begin[1:], [0]])[: len(last)])
                whole = lambda x: pa.array(x.astype(np.int32))
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()).take(pa.array(of[two])),
                        part.column(1).take(pa.array(of[two])),
                        pa.array(both.view(np.int64)),
                        *(whole(x[two] - origin[two]) for x in (begin, ends)),
                        whole(ends[two + 1] - origin[two]),
                        whole(words[two]),
                        whole(words[two + 1]),
                        pa.array(again),
                    ],
                    names=["doc_id", "text_hash", "digest", "begin", "middle", "end", "words", "next_words", "again"],
                )

    return docs.select(F.col(id_column).cast("long"), F.xxhash64(F.col(text).cast("string")), F.col(text).cast("string")).where(F.col(id_column).isNotNull()).mapInArrow(run, PAIRS)


def repeated_passages(docs: DataFrame, least_words: int = 28, span: int = 10, text: str = "text", id_column: str = "doc_id", scratch: Scratch | None = None, hashed: bool = False) -> DataFrame:
    """doc_id, begin and end (bytes of the UTF-8 text), words and first_doc_id (the least id that any of its chunks is in) of every
    passage of at least `least_words` words whose pairs of chunks all stand in documents with smaller ids, or earlier in the same
    text, too; with `hashed`, text_hash (xxhash64) too. A word or line said over and over within one text is no passage: of a repeat
    within a text more than half of the pairs of chunks must differ from each other.

    Any passage of 51 words or more that two documents share holds such a run: its hashes are the same from the 4th word on, a cut that
    both have is among the `span` words from there and among its last `span`, so 51 - 3 - 2 (span - 1) - 1 = 29 words lie between. Rows
    without an id, without text or with a blank text have none. A chunk that only repeats between rows of one id is no repeat, and
    places are those of each row's own text. Digests are counted before any join, so a passage in a third of all rows is one row for
    each task; only chunks whose digest may be repeated (a bitmap tells) are joined, and Spark can split that join wherever one digest is frequent.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    pack = lambda high, low: F.shiftleft(F.col(high).cast("long"), 32) + F.col(low)  # noqa: E731  rows come by the million: three numbers beside the digest
    pairs = chunk_pairs(docs, span, text, id_column)
    pairs = scratch.keep(pairs.select("digest", "doc_id", "text_hash", pack("begin", "middle").alias("b"), (pack("end", "next_words") + F.col("words") * 65536).alias("e"), "again"), "pairs")
    seen = pairs.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id")).where("first_doc_id < last_doc_id").select("digest", "first_doc_id")
    seen = scratch.keep(seen, "digests")
    maybe, others = told_apart(pairs, F.col("digest"), *id_marks(seen, "digest", scratch))
    met = maybe.join(seen, "digest", "left").where("again or doc_id > first_doc_id").select("doc_id", "text_hash", F.coalesce("first_doc_id", "doc_id").alias("first_doc_id"), "b", "e", "digest")
    found = met.union(others.where("again").select("doc_id", "text_hash", "doc_id", "b", "e", "digest")).distinct()
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF))
    rows = found.select("doc_id", "text_hash", "first_doc_id", "digest", high("b").alias("begin"), low("b").alias("middle"), high("e").alias("end"), F.shiftright(low("e"), 16).alias("words"), low("e").bitwiseAND(0xFFFF).alias("next_words"))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("begin")
    fresh = F.when(F.lag("middle").over(order) == F.col("begin"), 0).otherwise(1)
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    words = F.sum("words") + F.max_by("next_words", "begin")
    passages = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), words.alias("words"), F.min("first_doc_id").alias("first_doc_id"), (2 * F.count_distinct("digest") > F.count(F.lit(1))).alias("varied"))
    return passages.where((F.col("words") >= least_words) & (F.col("varied") | (F.col("first_doc_id") < F.col("doc_id")))).select("doc_id", "begin", "end", "words", "first_doc_id", *(["text_hash"] if hashed else []))


def deduplicated(docs: DataFrame, least_words: int = 28, span: int = 10, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents without their repeated passages (each leaves a blank; rows that repeat an id are cut by their own text); all others keep their text as it is, null too."""
    scratch, own = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    passages = repeated_passages(docs, least_words, span, text, id_column, scratch, hashed=True)
    spans = passages.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.struct(F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end")))).alias("_spans"))
    spans = own.keep(spans, "spans")
    scratch.clear()
    touched, others = told_apart(docs, F.col(id_column).cast("long"), *id_marks(spans, "_id", own))  # texts without a passage are not shuffled
    rows = touched.select(F.struct("*").alias("_row"), F.col(id_column).cast("long").alias("_own"), F.xxhash64(F.col(text).cast("string")).alias("_text"))
    cut = free_name(docs, "spans")
    rows = rows.join(spans, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left").select("_row.*", F.col("_spans").alias(cut))
    return rows.withColumn(text, F.when(F.col(cut).isNotNull(), without(F.col(text), F.col(cut))).otherwise(F.col(text))).select(*docs.columns).union(others)
