"""Toxicity scores by a small convolutional text classifier, fitted on every labelled row.

Labelled rows are dealt to groups by a hash of their ids. In each pass every group goes on from the model of all, in a task, and the groups' steps are
averaged by Spark, table rows over those groups that met them. Losses and thresholds are counted over every row that no step saw.

A word's embedding is the concatenation of two table rows, one picked by a hash of the word, one by a hash of its first letters, so
that a word never seen before still has its stem's. Rows begin near 0: words that were never learned add next to nothing. Filters of several widths slide over the words, the maximum over the whole text of each feeds a
logistic output, and the logit is shifted by a threshold calibrated for the text's language, which is itself told from the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import Scratch, id_marks, per_text, told_apart

WORD = re.compile(r"[^\W_]+")
WIDTHS = (1, 2, 3)
STEM = 5  # letters
GRID = np.linspace(-1.5, 2.0, 36)  # logits that may be a threshold
LANGUAGE_DIMS = 1024
CACHED_WORDS = 1 << 16  # some 10 MB


class Words:
    """The two table rows of each word, packed in one integer; what is remembered is dropped when it holds CACHED_WORDS words."""

    def __init__(self, bits: int):
        self.bits, self.mask, self.seen = bits, (1 << bits) - 1, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        if len(self.seen) > CACHED_WORDS:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = (xxhash.xxh64_intdigest(w) & self.mask) | ((xxhash.xxh64_intdigest(w[:STEM], 1) & self.mask) << self.bits)
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


class ToxicityModel:
    """Weights: two tables [2**bits, half], kernels {width: [width, 2 * half, filters]}, their biases, output vector and bias."""

    def __init__(self, bits: int = 15, half: int = 8, filters: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / math.sqrt(s[-1]), s).astype(np.float32)
        self.bits, self.half, self.filters = bits, half, filters
        self.p = {"t1": draw(1 << bits, half) * 0.03, "t2": draw(1 << bits, half) * 0.03}
        self.p |= {f"k{w}": draw(w, 2 * half, filters) for w in WIDTHS} | {f"b{w}": np.zeros(filters, np.float32) for w in WIDTHS}
        self.p |= {"v": np.abs(draw(len(WIDTHS) * filters)), "c": np.full(1, -2.0, np.float32)}
        self.languages: langid.LanguageModel | None = None
        self.thresholds: dict[str, float] = {}

    def embedded(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["t1"][words & ((1 << self.bits) - 1)], self.p["t2"][words >> self.bits]], 1)

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        """Both tables times every kernel slice, so that scoring only looks up and adds."""
        k = np.concatenate([self.p[f"k{w}"][o] for w in WIDTHS for o in range(w)], 1)
        return self.p["t1"] @ k[: self.half], self.p["t2"] @ k[self.half :]

    def logit(self, words: np.ndarray, tables: tuple[np.ndarray, np.ndarray], block: int = 8192) -> float:
        """Of a whole text, however long: blocks of words overlap by the widest filter, and the maximum runs on."""
        n, f, most = len(words), self.filters, np.zeros(len(WIDTHS) * self.filters, np.float32)
        for at in range(0, max(n, 1), block):
            part = words[at : at + block + WIDTHS[-1] - 1]
            m = max(1, len(part)) if at + block >= n else block
            x = np.zeros((m + WIDTHS[-1] - 1, tables[0].shape[1]), np.float32)  # zeros stand for words beyond the text's end
            x[: len(part)] = tables[0][part & ((1 << self.bits) - 1)]
            x[: len(part)] += tables[1][part >> self.bits]
            column = 0
            for k, w in enumerate(WIDTHS):
                a = x[:m, column : column + f]
                for o in range(1, w):
                    a = a + x[o : m + o, column + o * f : column + (o + 1) * f]
                column += w * f
                most[k * f : (k + 1) * f] = np.maximum(most[k * f : (k + 1) * f], a.max(0) + self.p[f"b{w}"])
        return float(most @ self.p["v"] + self.p["c"][0])

    def score(self, texts: list[str | None], words: Words, tables: tuple[np.ndarray, np.ndarray]) -> tuple[list[float], list[str]]:
        tongues = [r[0] for r in self.languages.predict(texts)]
        shift = [self.thresholds.get(y, self.thresholds[""]) for y in tongues]
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, self.logit(words(t), tables) - s)))) for t, s in zip(texts, shift, strict=True)], tongues


def peaks(m: ToxicityModel, docs: list[np.ndarray], block: int = 8192, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Of each document and filter the maximum over the whole text (not below 0) and the place of its first word. Documents go through in blocks of words
    that overlap by the widest filter, about `at_once` words at a time, however long they are."""
    pad, n, f = WIDTHS[-1] - 1, len(docs), m.filters
    kernel = np.concatenate([m.p[f"k{w}"][o] for w in WIDTHS for o in range(w)], 1)
    most, place = np.full((n, len(WIDTHS) * f), -np.inf, kernel.dtype), np.zeros((n, len(WIDTHS) * f), np.int64)
    cut = [(k, low) for k, d in enumerate(docs) for low in range(0, max(1, len(d)), block)]
    while cut:
        own, size = [], 0
        while cut and (not own or size < at_once):
            k, low = cut.pop()
            own.append((k, low, docs[k][low : low + block + pad], min(block, max(1, len(docs[k]) - low))))
            size += own[-1][3] + pad
        starts = np.cumsum([0, *(rows + pad for *_, rows in own)])
        flat, real = np.zeros(starts[-1], np.int64), np.zeros(starts[-1], bool)
        for s, (_, _, words, _) in zip(starts, own):
            flat[s : s + len(words)], real[s : s + len(words)] = words, True
        x = (m.embedded(flat) * real[:, None]) @ kernel
        a, column = np.empty((len(x), most.shape[1]), x.dtype), 0
        for k, w in enumerate(WIDTHS):
            here = a[:, k * f : (k + 1) * f]
            here[:] = m.p[f"b{w}"]
            for o in range(w):
                here[: len(x) - o] += x[o:, column : column + f]
                column += f
        for s, (k, low, _, rows) in zip(starts, own):
            at = a[s : s + rows].argmax(0)
            top = a[s + at, np.arange(a.shape[1])]
            better = (top > most[k]) | ((top == most[k]) & (low + at < place[k]))
            most[k, better], place[k, better] = top[better], low + at[better]
    return np.maximum(most, 0), place


def slopes(m: ToxicityModel, docs: list[np.ndarray], y: np.ndarray, weigh: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Of the weighted logistic loss of some documents: gradients of all but the tables, and of each table the rows met and theirs.
    Through max pooling only the words under a maximum get any."""
    h, place = peaks(m, docs)
    g = (1 / (1 + np.exp(-np.clip(h @ m.p["v"] + m.p["c"], -30, 30))) - y) * weigh / len(docs)
    out = {"v": h.T @ g, "c": g.sum(keepdims=True)}
    met, parts = [], []
    for k, w in enumerate(WIDTHS):
        own = slice(k * m.filters, (k + 1) * m.filters)
        dh = g[:, None] * m.p["v"][own] * (h[:, own] > 0)
        out[f"b{w}"] = dh.sum(0)
        out[f"k{w}"] = np.zeros_like(m.p[f"k{w}"])
        for o in range(w):
            spot = place[:, own] + o
            real = np.stack([p < len(d) for p, d in zip(spot, docs, strict=True)])  # beyond the text's end stand zeros
            words = np.zeros(spot.shape, np.int64)
            for row, p, d, inside in zip(words, spot, docs, real, strict=True):
                row[inside] = d[p[inside]]
            x = m.embedded(words.ravel()).reshape(*words.shape, -1) * real[..., None]
            out[f"k{w}"][o] = np.einsum("nf,nfe->ef", dh, x)
            hot = real & (dh != 0)
            met.append(words[hot])
            parts.append((dh[..., None] * m.p[f"k{w}"][o].T)[hot])
    words, dx = np.concatenate(met), np.concatenate(parts)
    tables = {}
    for name, rows, part in (("t1", words & ((1 << m.bits) - 1), dx[:, : m.half]), ("t2", words >> m.bits, dx[:, m.half :])):
        rows, own = np.unique(rows, return_inverse=True)
        total = np.zeros((len(rows), m.half), dx.dtype)
        np.add.at(total, own, part)
        tables[name] = rows, total
    return out, tables


def gradients(m: ToxicityModel, docs: list[np.ndarray], y: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
    """The same with whole tables."""
    out, tables = slopes(m, docs, y, weigh)
    for name, (rows, part) in tables.items():
        out[name] = np.zeros_like(m.p[name])
        out[name][rows] = part
    return out


def trained(m: ToxicityModel, docs: list[np.ndarray], y: np.ndarray, seed: list[int], batch: int = 32, most_words: int = 1 << 18, rate: float = 0.004, decay: float = 0.01) -> tuple[ToxicityModel, dict[str, np.ndarray]]:
    """One pass of Adam with weight decay over some documents, and which table rows it met. Tables are stepped where they are met, and decay as a whole at the end."""
    out, rng = ToxicityModel(m.bits, m.half, m.filters), np.random.default_rng(seed)
    out.p = {k: v.copy() for k, v in m.p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in m.p.items()} for _ in range(2))
    met = {k: np.zeros(len(m.p[k]), bool) for k in ("t1", "t2")}
    order, step, at = rng.permutation(len(docs)), 0, 0
    while at < len(order):
        sizes = np.cumsum([len(docs[i]) for i in order[at : at + batch]])
        part = order[at : at + max(1, int((sizes <= most_words).sum()))]
        at, step = at + len(part), step + 1
        whole, tables = slopes(out, [docs[i] for i in part], y[part], np.ones(len(part), np.float32))
        for k, (rows, g) in ({k: (slice(None), g) for k, g in whole.items()} | tables).items():
            first[k][rows] = 0.9 * first[k][rows] + 0.1 * g
            second[k][rows] = 0.99 * second[k][rows] + 0.01 * g * g
            out.p[k][rows] -= rate * (first[k][rows] / (1 - 0.9**step) / (np.sqrt(second[k][rows] / (1 - 0.99**step)) + 1e-7) + decay * out.p[k][rows] * (k[0] == "k" or k[0] == "b"))
            if k in met:
                met[k][rows] = True
    for k in met:
        out.p[k] *= np.float32((1 - rate * decay) ** step)
    return out, met


def threshold(z: np.ndarray, y: np.ndarray, weigh: np.ndarray, grid: np.ndarray = GRID) -> float:
    """The logit that gives the best weighted F1, in the middle of the best stretch, kept between two bounds."""
    hit = np.array([(weigh * y * (z >= t)).sum() for t in grid])
    told = np.array([(weigh * (z >= t)).sum() for t in grid])
    f1 = 2 * hit / (told + (weigh * y).sum() + 1e-9)
    return float(grid[f1 >= f1.max() - 1e-6].mean())


def _within(drawn: DataFrame, most: int) -> DataFrame:
    """Of each label's rows, in the order of their hashes, those that have `most` words together, and the first one anyhow."""
    sizes = drawn.select("y", "h", (F.octet_length("w") / 4).cast("long").alias("n")).collect()
    last = {}
    for label in {r.y for r in sizes}:
        own = sorted((r.h, r.n) for r in sizes if r.y == label)
        fits = [h for (h, _), told in zip(own, np.cumsum([n for _, n in own]), strict=True) if told <= most]
        last[label] = fits[-1] if fits else own[0][0]
    kept = F.lit(False)
    for label, h in last.items():
        kept = kept | ((F.col("y") == label) & (F.col("h") <= h))
    return drawn.where(kept)


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """With `g`, the group by a hash of the id."""
    return rows.withColumn("g", F.pmod(F.xxhash64(F.lit(3), F.col("i").cast("string")), F.lit(groups)).cast("long"))


@dataclass(frozen=True)
class Labelled:
    """Words (i, l, held, n, w) and labels (i, y) of rows, which meet only where groups are made, so that words are shuffled once."""

    words: DataFrame
    labels: DataFrame

    def rows(self) -> DataFrame:
        """i, l, held, n and y of the rows that have a label, without their words."""
        return self.words.select("i", "l", "held", "n").join(self.labels, "i")

    def count(self) -> int:
        return self.rows().count()


def _packed(rows: Labelled, groups: int) -> DataFrame:
    """One row for each group, to which rows are dealt by a hash of their ids: their labels, languages, whether held out, words and numbers of words, in the order of id and words."""

    def pack(words: pa.Table, labels: pa.Table) -> pa.Table:
        y = labels["y"].take(pc.index_in(words["i"], value_set=labels["i"].combine_chunks()))
        own = words.append_column("y", y).filter(pc.is_valid(y))
        if not own.num_rows:
            return arrow.empty_table()
        own = own.sort_by([("i", "ascending"), ("w", "ascending"), ("y", "ascending"), ("l", "ascending")])
        sizes = pc.divide(pc.binary_length(own["w"]), 4).cast(pa.int64()).to_numpy()
        return pa.table({"g": [own["g"][0].as_py()], "y": [own["y"].to_pylist()], "l": [own["l"].to_pylist()], "held": [own["held"].to_pylist()], "n": [sizes.tolist()], "w": [b"".join(own["w"].to_pylist())]}, schema=arrow)

    arrow = pa.schema([("g", pa.int64()), ("y", pa.list_(pa.int32())), ("l", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("w", pa.binary())])
    words, labels = (_dealt(t, groups).groupBy("g") for t in (rows.words.drop("n"), rows.labels))
    return words.cogroup(labels).applyInArrow(pack, "g long, y array<int>, l array<string>, held array<boolean>, n array<long>, w binary")


def _pass(packed: DataFrame, model: ToxicityModel, turn: int, known: list[str], step: bool) -> DataFrame:
    """Of each group: what the model gives for the rows held out, counted by language, label and place in the grid (with the sum of losses); and, with `step`, where one
    pass over its other rows leads, each array of the model with the weights of its rows."""
    shared = packed.sparkSession.sparkContext.broadcast((model, set(known)))  # 2 * 2**bits * half floats, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, names = shared.value
        tables = m.projected()
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            ends = np.cumsum([0, *row["n"]])
            words = np.frombuffer(row["w"], np.int32)
            docs = [words[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            y, counts = row["y"], {}
            for k in np.flatnonzero(row["held"]).tolist():
                z = m.logit(docs[k], tables)
                at = (row["l"][k] if row["l"][k] in names else None, y[k], int(np.searchsorted(GRID, z, "right")))
                n, loss = counts.get(at, (0, 0.0))
                counts[at] = n + 1, loss + float(np.logaddexp(0, -z if y[k] else z))
            out = [(row["g"], None, l, label, place, n, loss, None, None) for (l, label, place), (n, loss) in counts.items()]
            own = np.flatnonzero(~np.array(row["held"], bool)).tolist()
            if step and own:
                led, met = trained(m, [docs[k] for k in own], np.array([y[k] for k in own], np.float32), [5, turn, row["g"]])
                for name, to in led.p.items():
                    weights = np.where(met[name], 1, 1e-6) if name in met else np.ones(len(to))
                    out.append((row["g"], name, None, None, None, None, None, (to - m.p[name]).astype(np.float32).tobytes(), weights.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    arrow = pa.schema([("g", pa.int64()), ("name", pa.string()), ("l", pa.string()), ("y", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("loss", pa.float64()), ("moved", pa.binary()), ("weights", pa.binary())])
    return packed.mapInArrow(run, "g long, name string, l string, y int, place int, n long, loss double, moved binary, weights binary")


def _averaged(told: DataFrame, fan: int = 32) -> list:
    """(name, moved) of each array, the weighted mean over all groups: sums of up to `fan` sums at a time, so that no task has all groups' arrays."""

    def summed(last: bool):
        def add(own: pa.Table) -> pa.Table:
            own = own.sort_by("g")
            total = weight = 0.0
            for moved, w in zip(own["moved"], own["weights"], strict=True):
                w = np.frombuffer(w.as_buffer(), np.float32).astype(np.float64)
                x = np.frombuffer(moved.as_buffer(), np.float32).reshape(len(w), -1).astype(np.float64)
                total, weight = total + x * w[:, None], weight + w
            mean = total / weight[:, None]
            return pa.table({"g": own["g"][:1], "name": own["name"][:1], "moved": [mean.astype(np.float32).tobytes()], "weights": [weight.astype(np.float32).tobytes()]})

        return add

    rows, groups = told.where("name is not null").select("g", "name", "moved", "weights"), told.agg(F.max("g")).first()[0] or 0
    while groups >= fan:
        groups = (groups + 1) // fan
        rows = rows.withColumn("g", F.col("g") % (groups + 1)).groupBy("g", "name").applyInArrow(summed(False), rows.schema)
    return rows.groupBy("name").applyInArrow(summed(True), rows.schema).select("name", "moved").collect()


def _languages(rows: DataFrame, known: list[str]) -> langid.LanguageModel:
    """Tells the language whose mean of letter n-gram counts, over all rows of it, is nearest; languages that aren't known count as one, `und`. Counts are summed in whole
    numbers, so that the order of rows doesn't matter."""
    if not known:
        return langid.train(np.zeros((0, 1), np.float32), [])
    shared = rows.sparkSession.sparkContext.broadcast(set(known))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, l in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = langid.hashed_ngrams(t.as_py() or "", LANGUAGE_DIMS)
                if x is not None and l is not None:
                    own = total.setdefault(l if l in shared.value else langid.UNDETERMINED, np.zeros(LANGUAGE_DIMS + 1, np.int64))
                    own[:-1] += np.rint(x * (1 << 20)).astype(np.int64)
                    own[-1] += 1
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["l", "x"])

    def add(own: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_buffer(), np.int64) for x in own["x"]), np.zeros(LANGUAGE_DIMS + 1, np.int64))
        return pa.table({"l": own["l"][:1], "x": [total.tobytes()]})

    got = sorted(rows.select("t", "l").mapInArrow(sums, "l string, x binary").groupBy("l").applyInArrow(add, "l string, x binary").collect())
    counts = np.stack([np.frombuffer(r.x, np.int64) for r in got]) if got else np.zeros((0, LANGUAGE_DIMS + 1), np.int64)
    means = counts[:, :-1] / counts[:, -1:] / (1 << 20)
    book = 2 * np.eye(len(got), dtype=np.float32) - 1  # a code of one bit each, so that the least loss is the largest margin
    return langid.LanguageModel([r.l for r in got], book, (20 * means.T).astype(np.float32), (-10 * (means**2).sum(1)).astype(np.float32), 0.1) if got else langid.train(np.zeros((0, 1), np.float32), [])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", lang: str = "lang", id_column: str = "doc_id", bits: int = 15, least: int = 15, group_rows: int = 4096, group_words: int = 1 << 21, visits: int = 40_000) -> ToxicityModel:
    """Fits on every labelled row and its whole text. Rows with an unknown label don't count; of several labels of one id the largest does.

    A fifth of the rows, by a hash of their ids, is held out from all steps: the pass that does best on it stays, and the thresholds are calibrated on all of it. Of `visits` rows and more
    there are 3 passes, of fewer rows up to 10, so that about `visits` rows are stepped through. A group has about `group_rows` rows or `group_words` words. A language with fewer than `least`
    rows of either label among those held out gets the threshold of all. The driver holds one model and counts by language, label and place in the grid.
    """
    known = labels.select(F.col(id_column).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    scratch, words = Scratch(docs.sparkSession), Words(bits)
    known = scratch.keep(known, "known")
    named = docs.select(F.col(id_column).cast(known.schema["i"].dataType).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    wanted, _ = told_apart(named, F.col("i"), *id_marks(known, "i", scratch))  # texts of rows without a label are neither read as words nor shuffled

    def tokens(texts: list, langs: list) -> list:
        return [langs, [words(t).astype(np.int32).tobytes() for t in texts]]

    found = per_text(wanted, "l string, w binary", tokens, "t", "i", more=("l",)).withColumnRenamed("doc_id", "i")
    found = scratch.keep(found.withColumn("held", F.pmod(F.xxhash64(F.lit(5), F.col("i").cast("string")), F.lit(5)) == 0).withColumn("n", F.octet_length("w").cast("long")), "words")
    labelled = Labelled(found, known)
    counts = scratch.keep(labelled.rows().groupBy("l", "held", "y").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")), "counts")
    size = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("bytes").alias("bytes"), F.sum(F.when(~F.col("held"), F.col("rows"))).alias("own"), F.sum(F.when(~F.col("held"), F.col("rows") * F.col("y"))).alias("toxic"), (F.sum(F.col("rows") * F.col("y")) / F.sum("rows")).alias("share")).first()
    m = ToxicityModel(bits=bits)
    m.languages, m.thresholds = langid.train(np.zeros((0, 1), np.float32), []), {"": 0.0}
    if size.rows < 10 or not 0 < (size.toxic or 0) < (size.own or 0):
        m.p["c"][0] = -4.0 if (size.share or 0.0) < 0.5 else 4.0
        m.p["v"][:] = 0
        scratch.clear()
        return m
    both = counts.where("held and l is not null").groupBy("l").agg(F.sum(F.col("rows") * F.col("y")).alias("ones"), F.sum("rows").alias("n"))
    told = sorted(r.l for r in both.where((F.col("ones") >= least) & (F.col("n") - F.col("ones") >= least)).collect())
    groups = max(1, -(-size.rows // group_rows), -(-size.bytes // (4 * group_words)))
    packed = scratch.keep(_packed(labelled, groups), "groups")
    scratch.drop(found)
    turns = min(10, max(3, round(visits / size.own)))
    best, least_loss = None, math.inf
    for turn in range(turns + 1):
        out = scratch.keep(_pass(packed, m, turn, told, turn < turns), "pass")
        counted = out.where("place is not null").groupBy("l", "y", "place").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).collect()
        loss = sum(r.loss for r in counted)
        if best is None or not counted or loss < least_loss:
            best, least_loss = (m, counted), loss
        if turn < turns:
            moved = {r.name: np.frombuffer(r.moved, np.float32) for r in _averaged(out)}
            now, m = m, ToxicityModel(bits=bits)
            m.p = {k: v + moved[k].reshape(v.shape) for k, v in now.p.items()}
        scratch.drop(out)
    m, counted = best
    m.languages = _languages(wanted, told)
    for tongue in ["", *told]:
        here = sorted((r.place, r.y, r.n) for r in counted if not tongue or r.l == tongue)
        totals = {}
        for place, y, n in here:
            totals[place, y] = totals.get((place, y), 0) + n
        z, y = np.array([GRID[p - 1] if p else GRID[0] - 1 for p, _ in totals]), np.array([float(x) for _, x in totals])
        m.thresholds[tongue] = threshold(z, y, np.array(list(totals.values()), float)) if len(set(y)) > 1 else 0.0
    scratch.clear()
    return m


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted and the language told from the text, for every whole text. One pass, nothing shuffled.

    Null texts count as empty, and empty ones get the score of a text without any known word. Repeated rows give repeated
    results; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2**bits * half floats, whatever the input's size
    state: dict = {}

    def run(texts: list) -> list:
        if not state:
            state.update(words=Words(shared.value.bits), tables=shared.value.projected())
        got, tongues = shared.value.score(texts, state["words"], state["tables"])
        return [got, [int(s >= 0.5) for s in got], tongues]

    return per_text(docs, "score double, predicted int, lang_told string", run, text, id_column)


def kept(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns: one pass, nothing shuffled or joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.update(words=Words(shared.value.bits), tables=shared.value.projected())
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                got, _ = shared.value.score(part.column(at).to_pylist(), state["words"], state["tables"])
                yield part.filter(pa.array([s < 0.5 for s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
