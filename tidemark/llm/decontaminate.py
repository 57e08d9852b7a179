"""Benchmark leaks by a generalised suffix automaton over the words of all items.

A document's words are streamed through the automaton, which keeps the longest suffix read so far that occurs in an item.
Where that suffix is `window` words long or more, the last `window` words are an item's window and are hit; an item of fewer
words counts where it occurs as a whole. Most words never reach the automaton: numpy hashes all pairs of neighbouring words, and
only stretches whose every pair may occur in an item, as long as the shortest window, are streamed.

A benchmark of up to some MB is one automaton, broadcast to a single narrow pass. Of a larger one, Spark joins the hashes of the
documents' windows with those of the items' first; a text then goes only through automata of the items it may hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import Scratch, free_name, id_marks, told_apart
from tidemark.llm.words import ALNUM, BASE, Slice, mixed, slices


class Automaton:
    """States are numbered from 0; `next` maps words to states, `link` is the suffix link, `size` the longest string's words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.items = window, items
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.holders: list[set[int]] = [set()]
        self.whole: dict[int, list[int]] = {}
        short = []
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
            if 0 < len(words) < window:
                short.append(k)
        for k, (_, words) in enumerate(items):  # who holds a state: all prefixes of an item, then all their suffixes
            state = 0
            for w in words:
                state = self.next[state][w]
                up = state
                while up > 0 and k not in self.holders[up]:
                    self.holders[up].add(k)
                    up = self.link[up]
        for k in short:
            state = 0
            for w in items[k][1]:
                state = self.next[state][w]
            self.whole.setdefault(state, []).append(k)
        self.short_sizes = sorted({len(items[k][1]) for k in short})

    def _new(self, size: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.holders.append(set())
        return len(self.size) - 1

    def _split(self, above: int, state: int, word: bytes) -> int:
        """The state of `above` + word where `state` also stands for longer strings."""
        twin = self._new(self.size[above] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = twin
        while above >= 0 and self.next[above].get(word) == state:
            self.next[above][word] = twin
            above = self.link[above]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, known, word)
        state = self._new(self.size[last] + 1, 0, {})
        above = last
        while above >= 0 and word not in self.next[above]:
            self.next[above][word] = state
            above = self.link[above]
        if above >= 0:
            other = self.next[above][word]
            self.link[state] = other if self.size[other] == self.size[above] + 1 else self._split(above, other, word)
        return state

    def read(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int] | list[int]]]:
        """(place of the last word, words, items) of every window found; the items are the automaton's own set, not a copy."""
        state = size = 0
        for at, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if w not in self.next[state]:
                continue
            state, size = self.next[state][w], size + 1
            if size >= self.window:
                up = state
                while self.size[self.link[up]] >= self.window:
                    up = self.link[up]
                yield at, self.window, self.holders[up]
            up = state
            while self.whole and up > 0:
                if up in self.whole and self.size[up] <= size:
                    yield at, self.size[up], self.whole[up]
                up = self.link[up]


class Detector:
    """The automaton of some items, and tables that tell which words and pairs of words may be theirs."""

    def __init__(self, items: list[tuple[str, str]], window: int, bits: int = 22):
        raw = np.frombuffer("".join(t or "" for _, t in items).encode(), np.uint8)
        at = np.cumsum([0, *(len((t or "").encode()) for _, t in items)])
        s = Slice(raw, at, ALNUM)
        h, low = s.hashes(), s.low.tobytes()
        spelt = [[low[b:e] for b, e in zip(s.begin[p:q].tolist(), s.end[p:q].tolist(), strict=True)] for p, q in zip(s.word_at[:-1], s.word_at[1:], strict=True)]
        self.automaton = Automaton([(i, w) for (i, _), w in zip(items, spelt, strict=True)], window)
        self.shift = np.uint64(64 - bits)
        self.one, self.two = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        self.one[h >> self.shift] = True
        inside = s.text_of[1:] == s.text_of[:-1]
        self.two[self._pairs(h)[inside]] = True
        self.least = min([len(w) for w in spelt if 0 < len(w) < window], default=window) if any(spelt) else 0

    def _pairs(self, h: np.ndarray) -> np.ndarray:
        return mixed(h[:-1] * BASE + h[1:]) >> self.shift

    def stretches(self, s: Slice) -> list[tuple[int, int]]:
        """Stretches [from, to) of words of one text, worth streaming."""
        h = s.hashes()
        if not len(h) or not self.least:
            return []
        joined = np.zeros(len(h) + 1, bool)  # joined[i]: words i - 1 and i may stand together in an item
        joined[1:-1] = self.two[self._pairs(h)] & (s.text_of[1:] == s.text_of[:-1])
        at = np.flatnonzero(joined)  # a pair may collide with an item's: a word of no item splits a run, it never costs the run
        joined[at] = self.one[h[at - 1] >> self.shift] & self.one[h[at] >> self.shift]
        starts = np.flatnonzero(~joined)  # every run of joined words, single words too
        long = np.diff(starts) >= self.least
        begin, end = starts[:-1][long], starts[1:][long]
        known = self.one[h[begin] >> self.shift]  # rules out single words only, longer runs have none but known words
        return list(zip(begin[known].tolist(), end[known].tolist(), strict=True))

    def hits(self, s: Slice) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Of each text with hits: merged stretches of hit words (counted from its first) and the items found."""
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for begin, end in self.stretches(s):
            text = int(s.text_of[begin])
            origin = int(s.word_at[text])
            words = [s.low[p:q].tobytes() for p, q in zip(s.begin[begin:end].tolist(), s.end[begin:end].tolist(), strict=True)]
            groups: dict[int, set[int] | list[int]] = {}  # a window that many items share is looked at once
            found = []
            for at, k, who in self.automaton.read(words):
                groups[id(who)] = who
                found.append((at - k + 1, at + 1))
            if found:
                spans, items = out.setdefault(text, ([], set()))
                items.update(*groups.values())
                for a, b in sorted(found):
                    a, b = a + begin - origin, b + begin - origin
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                    else:
                        spans.append((a, b))
        return out


FOUND = "n_words long, spans array<struct<first: int, past: int, begin: int, end: int>>, items array<string>"
LEAK = "struct<n_words: bigint, spans: array<struct<first: int, past: int, begin: int, end: int>>, items: array<string>>"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id", most_bytes: int = 4 << 20, into: str = "leak") -> DataFrame:
    """All columns of docs with `into` (where docs have such a column, the name with underscores behind): n_words, the merged hit stretches (words first
    to past - 1, bytes begin to end - 1 of the UTF-8 text) and the items, sorted as strings.

    Words are runs of 0-9, letters and non-ASCII characters, A-Z lower-cased. Null and empty texts have no words. Items with a
    null id or text, or no word, have no window; an empty benchmark hits nothing. The benchmark is measured first: up to `most_bytes`
    bytes of it are broadcast, and documents go through one pass in which nothing is shuffled; a larger one is joined (see _routed).
    """
    into = free_name(docs, into)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    if size > most_bytes:
        return _routed(docs, items, window, text, most_bytes, into)
    return _one_pass(docs, sorted((r.i, r.t) for r in items.collect()), window, text, into)


def _one_pass(docs: DataFrame, block: list[tuple[str, str]], window: int, text: str, into: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # within find_leaks' most_bytes
    rows = docs.withColumn(into, F.lit(None).cast(LEAK))
    at, leak = rows.columns.index(text), rows.columns.index(into)
    ready: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready["it"] = Detector(shared.value, window)
        names = [i for i, _ in shared.value]
        for batch in batches:
            kind = batch.column(leak).type
            for part, s in slices(batch, at, ALNUM):
                found = ready["it"].hits(s)
                if not found:
                    told = pa.StructArray.from_arrays([pa.array(s.n_words.astype(np.int64)), _empty(s.n, kind.field("spans").type), _empty(s.n, kind.field("items").type)], fields=list(kind))
                else:
                    told = pa.array([_told(found.get(k), s, k, names) for k in range(s.n)], kind)
                yield pa.RecordBatch.from_arrays([told if c == leak else x for c, x in enumerate(part.columns)], schema=part.schema)

    return rows.mapInArrow(run, rows.schema)


def _empty(n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind.value_type), type=kind)


def _told(found: tuple | None, s: Slice, text: int, names: list[str]) -> dict:
    spans, items = found or ([], ())
    w, origin = int(s.word_at[text]), int(s.at[text])
    places = [{"first": a, "past": b, "begin": int(s.begin[w + a]) - origin, "end": int(s.end[w + b - 1]) - origin} for a, b in spans]
    return {"n_words": int(s.n_words[text]), "spans": places, "items": sorted({names[k] for k in items})}


def _windows(rows: DataFrame, window: int, key: str, also: list[int] | None, marks: np.ndarray | None = None, bits: int = 0) -> DataFrame:
    """key and h: the hashes of a text's windows (`window` words, or all of a shorter text's); with `also`, of all its runs of so many words too, and
    only those that the marks may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch, 1, ALNUM):
                h = s.hashes()
                found = [s.shingles(h, k) for k in [window, *(also or [])]]
                hashes, of = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                if shared is not None:
                    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                    hit = (shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                    hashes, of = hashes[hit], of[hit]
                two = np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1)
                yield pa.record_batch([part.column(0).take(pa.array(two[0].astype(np.int64))), pa.array(two[1].view(np.int64))], names=["key", "h"])

    shared = None if marks is None else rows.sparkSession.sparkContext.broadcast(marks)
    return rows.select(F.col(key).alias("key"), "t").mapInArrow(run, f"key {dict(rows.dtypes)[key]}, h long")


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the first bits of the hashes: 16 bits for each, 2**30 (128 MB) at most, whatever the benchmark's size."""
    width = min(30, max(15, (16 * windows.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - width) + 1
    marks = windows.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in marks.toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out, width


def _routed(docs: DataFrame, items: DataFrame, window: int, text: str, most_bytes: int, into: str) -> DataFrame:
    """The same for a benchmark of any size, by distinct texts (told by xxhash64). The items' windows are hashed; the documents' windows that a bitmap of
    these may hold are joined with them, which gives the items that a text may share a window with. Each such text meets its items in groups of about
    `most_bytes`, through an automaton for each group, and the groups' stretches are merged. Texts that share no hash aren't shuffled."""
    scratch = Scratch(docs.sparkSession)
    owned = scratch.keep(_windows(items, window, "i", None), "windows")
    short = items.select(F.regexp_count("t", F.lit(WORD)).alias("n")).where(F.col("n").between(1, window - 1)).agg(F.array_sort(F.collect_set("n"))).first()[0]
    marks, bits = _bitmap(owned)
    texts = docs.select(F.xxhash64(F.col(text).cast("string")).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    met = _windows(texts, window, "k", list(short), marks, bits).distinct().join(owned.select("h", F.col("key").alias("i")), "h").select("key", "i").distinct()
    met = scratch.keep(met.join(items.select("i", "t", F.octet_length("t").alias("bytes")), "i"), "met")
    groups = met.groupBy(F.col("key").alias("k")).agg(F.ceil(F.sum("bytes") / most_bytes).alias("groups"))
    groups = scratch.keep(groups, "groups")
    listed = met.join(groups, met.key == groups.k).select("key", F.pmod(F.xxhash64("i"), "groups").alias("group"), "i", "t")
    wanted, _ = told_apart(texts, F.col("k"), *id_marks(groups, "k", scratch))
    whole = wanted.groupBy("k").agg(F.first("t").alias("t")).join(groups.withColumnRenamed("k", "key"), F.col("k") == F.col("key"))
    whole = whole.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), "t")

    def run(own: pa.Table, texts: pa.Table) -> pa.Table:
        if not own.num_rows or not texts.num_rows:
            return pa.Table.from_pylist([], schema=arrow)
        items = sorted(zip(own.column("i").to_pylist(), own.column("t").to_pylist(), strict=True))
        batch = texts.combine_chunks().to_batches()[0]
        _, s = next(slices(batch, batch.schema.get_field_index("t"), ALNUM))
        return pa.Table.from_pylist([{"key": batch.column("key")[0].as_py(), **_told(Detector(items, window, 16).hits(s).get(0), s, 0, [i for i, _ in items])}], schema=arrow)

    schema = T.StructType([T.StructField("key", T.LongType()), *T.StructType.fromDDL(FOUND)])
    arrow = to_arrow_schema(schema)
    found = listed.groupBy("key", "group").cogroup(whole.groupBy("key", "group")).applyInArrow(run, schema)

    def merged(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["past"], x["past"]).alias("past"), last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["past"]), F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(F.array_append(done, x))

    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    each = found.groupBy("key").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.array().cast("array<struct<first: int, past: int, begin: int, end: int>>")
    leaks = each.where(F.size("spans") > 0).select("key", F.struct("n_words", F.aggregate("spans", start, merged).alias("spans"), "items").cast(LEAK).alias("_leak"))
    leaks = scratch.keep(leaks, "leaks")

    n_words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    clean = F.struct(n_words.alias("n_words"), start.alias("spans"), F.array().cast("array<string>").alias("items")).cast(LEAK)
    hit, others = told_apart(docs, F.xxhash64(F.col(text).cast("string")), *id_marks(leaks, "key", scratch))
    rows = hit.select(F.struct("*").alias("_row"), F.xxhash64(F.col(text).cast("string")).alias("_key"), clean.alias("_clean"))
    joined = rows.join(leaks, F.col("_key") == F.col("key"), "left").select("_row.*", F.coalesce("_leak", "_clean").alias(into))
    return joined.union(others.withColumn(into, clean))


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    leaks = find_leaks(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda total, x: total + x.past - x.first)
    return leaks.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 0.5, text: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """The documents without their hit stretches; those hit in more than `most_share` of their words go as a whole.

    The bytes from a stretch's first word to its last are cut and one blank is left. Clean documents keep their text as it is, null too.
    """
    own = free_name(docs, "leak")
    leaks = find_leaks(docs, benchmark, window, text, most_bytes=most_bytes)
    leak = F.col(own)
    n_hit = F.aggregate(leak["spans"], F.lit(0).cast("long"), lambda total, x: total + x.past - x.first)
    kept = leaks.where(n_hit <= leak["n_words"] * most_share)
    return kept.withColumn(text, F.when(F.size(leak["spans"]) > 0, without(F.col(text), leak["spans"])).otherwise(F.col(text))).drop(own)


def without(text, spans):
    """A text without its byte spans (begin, end), in order and apart, each replaced by a blank."""
    raw = text.cast("binary")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    # the pieces between spans are whole characters, since words end at ASCII bytes or the text's end
    step = F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(F.concat(s.kept, F.substring(raw, s["at"] + 1, x.begin - s["at"]).cast("string"), F.lit(" ")).alias("kept"), x.end.alias("at")),
    )
    return F.concat(step.kept, F.substring(raw, step["at"] + 1, F.octet_length(text)).cast("string"))
