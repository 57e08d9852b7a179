"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked (each blank and the begin become U+2581) and falls into words that no piece crosses. The distinct words of some
texts are sorted, which is the depth-first order of their trie, and a word starts from the forward states of the prefix
it shares with the one before. A state is the best way to the end of a prefix, as its last piece. For a unigram model the best
way is the one of the largest sum of scores. For a BPE model a way is valid where merging makes exactly its pieces, which holds if
and only if it holds for each two neighbours; there is one such way to every prefix, so the same search gives the merges' result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PAIR_BITS = 20  # of the table of neighbouring characters: 1 MB
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
EDGE = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")  # where a word ends and the next begins
DEFAULT_MODEL = "piece_bpe_32k.model"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


KINDS = {1: "unigram", 2: "bpe"}  # fixed values: the model file's numbers of kinds
USER_DEFINED = 4  # fixed value: the model file's number of this type of piece


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: whole numbers, or bytes of texts, messages and fixed-size numbers."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """A model's pieces, read from its file on the driver; small and fixed, so that it can be broadcast.

    The kind (bpe or unigram) and whether a text is given a blank at its begin are read from the file. A model that changes texts in
    other ways (a normaliser, joined blanks), that has user-defined pieces or pieces across words, is refused with a ValueError.
    """

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer, normaliser, types = {}, {}, set()
        for n, value in fields(p.serialized_model_proto()):
            if n == 1:
                types.add(dict(fields(value)).get(3, 1))
            elif n == 2:
                trainer = dict(fields(value))
            elif n == 3:
                normaliser = dict(fields(value))
        kind = kind or KINDS.get(trainer.get(3, 1))
        if kind not in KINDS.values():
            raise ValueError("neither a unigram nor a BPE model")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or USER_DEFINED in types:
            raise ValueError("the model normalises texts or has pieces of the user's own")
        n = p.get_piece_size()
        self.kind, self.unknown, self.lead = kind, p.unk_id(), MARK if normaliser.get(3, 1) else ""
        self.ids, self.scores, self.byte_ids, self.shown = {}, {}, [self.unknown] * 256, [b""] * n
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.shown[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, p.get_score(i)
                self.shown[i] = piece.replace(MARK, " ").encode()
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece crosses words")
        self.byte_at = np.cumsum([0, *map(len, self.shown)])
        self.bytes = np.frombuffer(b"".join(self.shown), np.uint8)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: of all neighbours that make a piece, those of the highest score merge, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Encodes words and remembers some of them, within `most_bytes`; what is remembered changes no result.

    Words are kept in two generations: when the young one is full it becomes the old one, and words met again move up. States and
    pairs are numbers: a piece's id, or the model's size and more for a character that no piece has; all are bounded.
    """

    def __init__(self, pieces: Pieces, most_bytes: int = 40 << 20, most_pairs: int = 1 << 18):
        self.p, self.most_pairs = pieces, most_pairs
        self.most = most_bytes // 2
        self.pairs: dict[int, dict[int, bool]] = {}  # of each piece, by the state before it, whether it may follow
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the young words, about
        self.names = {i: x for x, i in pieces.ids.items()}
        self.scores = {i: pieces.scores[x] for x, i in pieces.ids.items()}
        self.base = len(pieces.shown)
        self.heads = {x[:k] for x in pieces.ids for k in range(1, len(x) + 1)} | {""}  # what pieces begin with
        self.reading: dict[str, dict[str, object]] = {"": {"": ""}}  # by head: the head itself, and by the next character what `reads` gives
        self.ends: dict[str, tuple[tuple[int, int, dict[int, bool]], ...]] = {}
        self.noted = self.stepped = 0  # pairs and characters read that are remembered

        inside = np.frombuffer("".join(a + b for x in pieces.ids for a, b in zip(x, x[1:], strict=False)).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.joined = np.zeros(1 << PAIR_BITS, bool)  # by a hash: whether two neighbouring characters stand together in any piece
        self.joined[self._neighbours(inside)[::2]] = True

    @staticmethod
    def _neighbours(codes: np.ndarray) -> np.ndarray:
        mixed = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]) * np.uint32(0x85EBCA6B)
        return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - PAIR_BITS)

    def units(self, words: list[str]) -> tuple[list[str], list[int]]:
        """Words cut wherever two neighbouring characters stand together in no piece, which no piece then crosses: their units, and where each
        word's begin (one more than words). Colliding hashes only leave a cut out, which changes no ids."""
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.joined[self._neighbours(codes)] if len(codes) else False
        starts = np.cumsum([0, *map(len, words)])
        cut[starts] = True
        at = np.flatnonzero(cut)
        ends = at.tolist()
        return [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], np.searchsorted(at, starts).tolist()

    def spelt(self, state: int) -> str:
        return "" if state < 0 else chr(state - self.base) if state >= self.base else self.names[state]

    def fits(self, before: int, piece: int) -> bool:
        if self.noted >= self.most_pairs:
            for known in self.pairs.values():
                known.clear()
            self.noted = 0
        a, b = self.spelt(before), self.names[piece]
        good = self.p.merged(a + b) == ([a, b] if a else [b])
        self.pairs.setdefault(piece, {})[before] = good
        self.noted += 1
        return good

    def reads(self, at: dict[str, object], c: str) -> tuple[dict[str, object], tuple[tuple[int, int, dict[int, bool]], ...]]:
        """From the longest end of a text that pieces begin with, one character on: the next such end, and the pieces that end there, the longest first, with their
        lengths and what is known of the states before them."""
        if self.stepped >= self.most_pairs:
            for x, known in self.reading.items():
                known.clear()
                known[""] = x
            self.stepped = 0
        x = at[""] + c
        while x not in self.heads:
            x = x[1:]
        if x not in self.ends:
            inside = [(self.p.ids[x[k:]], len(x) - k) for k in range(len(x)) if x[k:] in self.p.ids]
            self.ends[x] = tuple((i, n, self.pairs.setdefault(i, {})) for i, n in inside)
        at[c] = got = self.reading.setdefault(x, {"": x}), self.ends[x]
        self.stepped += 1
        return got

    def add(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each of some new words with its ids. Depth first through their trie: `last`, `total` and `read` hold the states of the present word's
        prefixes (last piece, score so far, what `reads` goes on from), and a word goes on from the states of the prefix it shares with the one before."""
        reads, fits, bpe = self.reads, self.fits, self.p.kind == "bpe"
        names, scores, base = self.names, self.scores, self.base
        last, total, read = [-1], [0.0], [self.reading[""]]
        before = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], total[shared + 1 :], read[shared + 1 :]
            at = read[shared]
            for end, c in enumerate(word[shared:], shared + 1):
                at, ending = at.get(c) or reads(at, c)
                way = -1
                if bpe:
                    for piece, long, known in ending:
                        ok = known.get(last[end - long])
                        if ok or ok is None and fits(last[end - long], piece):
                            way = piece
                            break
                else:
                    best = None
                    for piece, long, _ in ending:
                        score = total[end - long] + scores[piece]
                        if best is None or score >= best:  # of equal ways the one of the shortest last piece
                            best, way = score, piece
                    total.append(best if best is not None else total[end - 1] - 1e4)
                last.append(way if way >= 0 else base + ord(c))  # an unknown character stands for itself
                read.append(at)
            before = word
            back, end = [], len(word)
            while end:
                back.append(last[end])
                end -= len(names[last[end]]) if last[end] < base else 1
            back.reverse()
            if back and max(back) >= base:
                back = [i for state in back for i in ([state] if state < base else (self.p.byte_ids[b] for b in chr(state - base).encode("utf-8", "surrogatepass")))]
            yield word, array("i", back).tobytes()

    def _recall(self, words: set[str]) -> set[str]:
        """Those of some words that aren't remembered; words of the old generation move up."""
        young, old = self.young, self.old
        new = words.difference(young)
        for w in filter(old.__contains__, new):  # as many looks as new words; an intersection goes through all that is remembered
            self._remember(w, old[w])
        return new.difference(young)

    def _remember(self, word: str, ids: bytes) -> None:
        self.young[word] = ids
        self.held += 2 * len(word) + len(ids) + 160

    def coded(self, words: list[str]) -> list[bytes]:
        """Each word's ids. Words not remembered are put together from their units, which many words share."""
        young = self.young
        new = list(self._recall(set(words)))
        units, at = self.units(new)
        for u, x in self.add(self._recall(set(units))):
            self._remember(u, x)
        for w, a, b in zip(new, at[:-1], at[1:], strict=True):
            if b - a > 1:
                self._remember(w, b"".join(map(young.__getitem__, units[a:b])))
        out = list(map(young.__getitem__, words))
        if self.held > self.most:
            self.old, self.young, self.held = young, {}, 0
        return out

    def encode(self, texts: list[str | None], at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin (one more than texts). Null and empty texts have none.
        Words are made and coded for about `at_once` characters at a time, so that a long text is never held as words."""
        flat, sizes, ends = [], [], [0]
        words: list[str] = []
        read = n = 0
        for t in texts:
            low = 0
            while t and low < len(t):
                cut = EDGE.search(t, min(len(t), low + at_once))
                high = cut.start() if cut else len(t)
                words += WORD.findall(("" if low else self.p.lead) + t[low:high].replace(" ", MARK))
                read, low = read + high - low, high
                if read >= at_once:
                    n += len(words)
                    self._code(words, flat, sizes)
                    words, read = [], 0
            ends.append(n + len(words))
        self._code(words, flat, sizes)
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.frombuffer(b"".join(flat), np.int32), at[ends]

    def _code(self, words: list[str], flat: list[bytes], sizes: list[np.ndarray]) -> None:
        got = self.coded(words)
        flat.append(b"".join(got))
        sizes.append(np.fromiter(map(len, got), np.int64, len(got)) // 4)


@lru_cache(1)
def _encoder(pieces: Pieces, most_bytes: int = 40 << 20, most_pairs: int = 1 << 18) -> Encoder:
    """A worker's encoder, which goes on from task to task with what it remembers, as long as the model is the same broadcast one."""
    return Encoder(pieces, most_bytes, most_pairs)


def decoded(pieces: Pieces, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The texts of some ids, as UTF-8: pieces joined, marks as blanks, without the one that the begin was given."""
    size = np.diff(pieces.byte_at)[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = pieces.bytes[np.repeat(pieces.byte_at[:-1][ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    where = ends[at].tolist()
    return [raw[a + 1 : b] if pieces.lead and raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(where[:-1], where[1:], strict=True)]


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def encode(docs: DataFrame, model_path: str | None = None, text: str = "text", id_column: str = "doc_id", most_bytes: int = 40 << 20, most_pairs: int = 1 << 18) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding the ids gives the text again) of every whole text. One pass, nothing shuffled.

    Null and empty texts have no ids. A text with U+2581 itself decodes to blanks there, so its round_trip is false. Characters
    that no piece has become their UTF-8 bytes' pieces. Repeated rows give repeated results; other columns are not looked at.
    A worker remembers words of `most_bytes` bytes and `most_pairs` pairs of pieces, which changes its time and memory only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_path or default_path()))  # the model's size, whatever the input's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, most_bytes, most_pairs)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for part in _parts(batch, lengths, 1 << 19):
                texts = part.column(1).to_pylist()
                ids, at = encoder.encode(texts)
                same = [(t or "").encode("utf-8", "surrogatepass") == d for t, d in zip(texts, decoded(shared.value, ids, at), strict=True)]
                yield pa.record_batch(
                    [part.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "round_trip"],
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str | None = None, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """doc_id and text of every row of ids. Null ids give a null text; ids outside the model, and control pieces, give nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces(model_path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            n = len(shared.value.shown)
            clean = [[i for i in r or () if i is not None and 0 <= i < n] for r in rows]
            at = np.cumsum([0, *map(len, clean)])
            texts = decoded(shared.value, np.array([i for r in clean for i in r], np.int64), at)
            yield pa.record_batch([batch.column(0), pa.array([None if r is None else t.decode("utf-8", "replace") for r, t in zip(rows, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    rows = tokens.select(F.col(id_column).alias("doc_id"), F.col(ids).cast("array<int>").alias("i"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
