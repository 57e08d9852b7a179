"""Token counts by deterministic transducers compiled from a byte-level BPE model.

Two transducers run one behind the other. The first reads kinds of characters and tells where the model's pattern begins a new word; it
has nine states. A text is cut into chunks, each chunk's state map (the state it leaves for every state that it may be entered in) is made
for all chunks at once, and the maps compose through a parallel prefix scan, which gives each chunk the state that it is really entered in;
a second pass tells the begins. The second transducer reads a word's bytes. Each of its transitions is annotated with the tokens that the
byte adds to the count (less than none where it lets earlier ones merge), so a word's count is the sum along its path. Its states are
made when a word first needs them: a state holds, for each end of the word read so far that some token begins with, the token before it and the
tokens since. One token is the last one of a prefix's encoding, and which one follows from neighbours alone: two tokens stand side by side
in an encoding if and only if merging what they spell leaves them apart.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_text

DEFAULT_MODEL = "byte_bpe_50k.json"
CHUNK = 256  # characters of a chunk
SLICE = 1 << 20  # characters looked at at once, unless one text has no place to cut
SAFE = re.compile("(?<=[a-z]) (?=[a-z])")  # a word begins here whatever stands around


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def byte_letters() -> dict[str, int]:
    """The model's alphabet: bytes that can be shown are their own letters, the others get letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values of byte-level models
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Model:
    """A model's merges as numbers, read from its file on the driver (some 400 KB, whatever the input's size).

    Tokens are numbered by rank: a byte is itself, the merge of rank r is 256 + r. A model of another kind, with a normaliser, another pattern,
    two merges to one token or a merge before its parts is refused with a ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, before = j["model"], j.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or j.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE model")
        added = j.get("added_tokens") or []
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special strings that take in what stands around them")
        self.special = [a["content"] for a in added]
        number, pairs = byte_letters(), []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            if a not in number or b not in number or a + b in number:
                raise ValueError("a merge before its parts, or two merges to one token")
            pairs.append((number[a], number[b]))
            number[a + b] = 256 + len(pairs) - 1
        self.pairs = np.array(pairs, np.int32).reshape(-1, 2)


class Reader:
    """The second transducer. What it remembers (states, transitions, neighbours, words) is bounded, some 300 MB at most, and changes no result."""

    START = ((0, -1, 0),)

    def __init__(self, pairs: np.ndarray, most_states: int = 1 << 18, most_words: int = 1 << 18):
        self.left, self.right = [-1] * 256 + pairs[:, 0].tolist(), [-1] * 256 + pairs[:, 1].tolist()
        self.rank = {(a << 32) | b: k for k, (a, b) in enumerate(pairs.tolist(), 256)}
        self.most_states, self.most_words = most_states, most_words
        self.near: dict[int, bool] = {}
        self.old_near: dict[int, bool] = {}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        spelt = [bytes([b]) for b in range(256)]
        whole = [True] * 256  # whether a token's own bytes merge to it
        for a, b in pairs.tolist():
            spelt.append(spelt[a] + spelt[b])
            whole.append(whole[a] and whole[b] and self._apart(a, b, self.rank[(a << 32) | b]))
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for t, word in enumerate(spelt):
            node = 0
            for b in word:
                self.inner[node] = True
                key = (node << 8) | b
                node = self.child.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            if whole[t]:
                self.token[node] = t
        self._begin()

    def _begin(self) -> None:
        self.states, self.numbers, self.moves = [self.START], {self.START: 0}, {}

    def _apart(self, a: int, b: int, end: int) -> bool:
        """Whether merging the bytes of a and b, up to rank `end`, makes both without a merge across. The tokens at the border grow by their own
        merges in order of rank, the left one first of equals; a merge across comes first if its rank is lower than both next ones (or equal to the right's)."""
        left, right = [a], [b]
        while (x := self.right[left[-1]]) >= 0:
            left.append(x)
        while (x := self.left[right[-1]]) >= 0:
            right.append(x)
        never = len(self.left) + 1
        while True:
            next_left = left[-2] if len(left) > 1 else never
            next_right = right[-2] if len(right) > 1 else never
            across = self.rank.get((left[-1] << 32) | right[-1], never)
            if across < end and across < next_left and across <= next_right:
                return False
            if next_left == next_right == never:
                return True
            (left if next_left <= next_right else right).pop()

    def fits(self, before: int, token: int) -> bool:
        """Whether `token` may stand behind `before` (-1: at a word's begin)."""
        if before < 0:
            return True
        key = (before << 32) | token
        good = self.near.get(key)
        if good is None:
            good = self.old_near.get(key)
            if good is None:
                good = self._apart(before, token, len(self.left) + 1)
            if len(self.near) >= self.most_words:
                self.old_near, self.near = self.near, {}
            self.near[key] = good
        return good

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The state behind a byte, and the tokens that it adds."""
        found, live = None, []
        for node, last, since in self.states[state]:  # the longest end first
            to = self.child.get((node << 8) | byte)
            if to is None:
                continue
            token = self.token[to]
            if found is None and token >= 0 and self.fits(last, token):
                found = (token, since + 1)
            if self.inner[to]:
                live.append((to, last, since))
        token, more = found
        after = (*((node, last, since - more) for node, last, since in live), (0, token, 0))
        number = self.numbers.get(after)
        if number is None:
            if len(self.states) >= self.most_states or len(self.moves) >= 2 * self.most_states:
                self._begin()
                state = -1
            number = self.numbers.setdefault(after, len(self.states))
            if number == len(self.states):
                self.states.append(after)
        if state >= 0:
            self.moves[(state << 8) | byte] = (number, more)
        return number, more

    def path(self, word: bytes) -> int:
        """Tokens of a word."""
        state = total = 0
        for byte in word:
            step = self.moves.get((state << 8) | byte)
            state, more = step if step is not None else self.move(state, byte)
            total += more
        return total

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word. Words met again are looked up; they are kept in two generations, long ones not at all."""
        got = list(map(self.young.get, words))
        for k in [k for k, n in enumerate(got) if n is None]:
            got[k] = self._looked_up(words[k])
        return np.array(got, np.int64)

    def _looked_up(self, word: str) -> int:
        n = self.young.get(word)
        if n is None:
            n = self.old.get(word)
            if n is None:
                n = self.path(word.encode("utf-8", "surrogatepass"))
            if len(word) <= 48:
                if len(self.young) >= self.most_words:
                    self.old, self.young = self.young, {}
                self.young[word] = n
        return n


LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, ONE, TWO, ELL, E, END = range(11)  # kinds of characters
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, WANTS_E, WANTS_L, ON_BLANK, ON_SPACE = range(9)  # states
STATES = 9
ENDINGS = {"'": QUOTE, " ": BLANK, "s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": TWO, "v": TWO, "l": ELL, "e": E}  # fixed values: 's 't 'm 'd 're 've 'll are words


@lru_cache(1)
def pattern() -> tuple[bytes, bytes]:
    """The first transducer, as tables over 16 * state + kind: 16 * the next state, and what begins (1: a word with this character, 2: with the one before)."""
    after, begins = bytearray(256), bytearray(256)
    letters = {LETTER, ONE, TWO, ELL, E}

    def first(kind: int) -> int:
        """The state behind a word's first character."""
        if kind in letters:
            return IN_LETTERS
        return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: QUOTED, BLANK: ON_BLANK, SPACE: ON_SPACE, END: FRESH}[kind]

    for state in range(STATES):
        for kind in range(11):
            ended, own = state, 0
            if state in (WANTS_E, WANTS_L) and kind != (E if state == WANTS_E else ELL):
                ended, own = IN_LETTERS, 2  # no such word after all: the letter before began one
            begin, to = 1, first(kind)
            if kind == END:
                begin = 0
            elif state in (WANTS_E, WANTS_L) and ended == state:
                begin, to = 0, FRESH
            elif ended == IN_LETTERS and kind in letters:
                begin = 0
            elif state == IN_NUMBERS and kind == NUMBER:
                begin = 0
            elif state in (IN_OTHERS, QUOTED) and kind in (OTHER, QUOTE):
                begin, to = 0, IN_OTHERS
            elif state == QUOTED and kind in (ONE, TWO, ELL):
                begin, to = 0, {ONE: FRESH, TWO: WANTS_E, ELL: WANTS_L}[kind]
            elif state in (ON_BLANK, ON_SPACE) and kind in (BLANK, SPACE):
                begin = 0
            elif state == ON_BLANK:  # a blank goes with what follows it
                begin, own, to = 0, 2, IN_OTHERS if kind == QUOTE else to
            elif state == ON_SPACE:
                own = 2
            after[16 * state + kind], begins[16 * state + kind] = 16 * to, begin | own
    return bytes(after), bytes(begins)


class Kinds:
    """The kind of every character, asked of the library itself when a character is first met, so that its Unicode version decides."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.of = np.full(0x110000, 255, np.uint8)
        self.ask(np.arange(128))
        for letter, kind in ENDINGS.items():
            self.of[ord(letter)] = kind

    def ask(self, points: np.ndarray) -> None:
        for at in range(0, len(points), 4096):
            some = points[at : at + 4096].tolist()
            said = "".join(f"\na{chr(c)}\n1{chr(c)}\n!{chr(c)}" for c in some)
            begins = {where[0] for _, where in self.split(said)}
            for k, c in enumerate(some):
                b = 9 * k  # joins a letter, a number, another sign, or none
                self.of[c] = LETTER if b + 2 not in begins else NUMBER if b + 5 not in begins else OTHER if b + 8 not in begins else SPACE

    def __call__(self, points: np.ndarray) -> np.ndarray:
        kinds = self.of[points]
        new = kinds == 255
        if new.any():
            self.ask(np.unique(points[new]))
            kinds = self.of[points]
        return kinds


def scanned(maps: np.ndarray) -> np.ndarray:
    """State maps (a row a chunk) composed with all before them, by a parallel prefix scan of log2 steps."""
    step = 1
    while step < len(maps):
        joined = maps.copy()
        joined[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps, step = joined, 2 * step
    return maps


def begins(kinds: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character of a sequence of kinds that starts fresh."""
    after, marks = pattern()
    n = -(-len(kinds) // CHUNK)
    padded = np.full(n * CHUNK, END, np.uint8)
    padded[: len(kinds)] = kinds
    steps = np.ascontiguousarray(padded.reshape(n, CHUNK).T)  # all chunks' first characters, then all second ones, ...
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None] * 16, n, 1)
    for kind in steps:
        state = np.frombuffer((state | kind).tobytes().translate(after), np.uint8).reshape(STATES, n)
    maps = scanned(np.ascontiguousarray(state.T) >> 4)
    entered = np.zeros(n, np.uint8)
    entered[1:] = maps[:-1, FRESH] << 4
    out = np.empty((CHUNK, n), np.uint8)
    for k, kind in enumerate(steps):
        read = (entered | kind).tobytes()
        out[k] = np.frombuffer(read.translate(marks), np.uint8)
        entered = np.frombuffer(read.translate(after), np.uint8)
    said = out.T.reshape(-1)[: len(kinds)]
    found = (said & 1).astype(bool)
    found[:-1] |= said[1:] >= 2
    return found


class Tokens:
    """Token counts of texts. One for each Python worker and model."""

    def __init__(self, model: Model):
        self.counter, self.kinds = Reader(model.pairs), Kinds()
        longest = sorted(model.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if longest else None

    def _some(self, parts: list[str]) -> np.ndarray:
        """Tokens of each of some parts."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(lengths) - 1
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds(points)
        kinds[ends] = END
        specials = []
        for m in self.special.finditer(joined) if self.special else ():
            kinds[m.start() : m.end()] = END
            specials.append(m.start())
        begin = begins(kinds)
        edges = np.flatnonzero(begin | (kinds == END))
        first = begin[edges]
        at, to = edges[:-1][first[:-1]], edges[1:][first[:-1]]
        counts = self.counter.counts([joined[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)])
        out = np.bincount(np.searchsorted(ends, at), counts, len(parts)) if len(at) else np.zeros(len(parts))
        if specials:
            out = out + np.bincount(np.searchsorted(ends, specials), minlength=len(parts))
        return out.astype(np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text. Long texts are cut where a word surely begins; parts of about SLICE characters are held at once."""
        out, parts, owners, size = np.zeros(len(texts), np.int64), [], [], 0

        def settle() -> None:
            nonlocal size
            if parts:
                np.add.at(out, owners, self._some(parts))
                parts.clear()
                owners.clear()
            size = 0

        for k, text in enumerate(texts):
            at = 0
            while text and at < len(text):
                cut = SAFE.search(text, at + SLICE) if len(text) - at > SLICE else None
                part = text[at : cut.start()] if cut else text[at:]
                parts.append(part)
                owners.append(k)
                at, size = at + len(part), size + len(part)
                if size >= SLICE:
                    settle()
        settle()
        return out


_READY: dict[bytes, Tokens] = {}


def ready(model: Model) -> Tokens:
    """The worker's transducers for a model; the last model's are kept from task to task."""
    key = model.pairs.tobytes() + repr(model.special).encode()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Tokens(model)
    return _READY[key]


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 1024, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, as the model's own library counts them: special strings inside a text are one token,
    none is added.

    Null and empty texts have no tokens. Rows that repeat give repeated results, null ids stay null, other columns aren't looked at. A very long
    text is read in slices, cut at blanks between small letters; without such a place it is one slice. One narrow pass; the model is broadcast (its size is fixed).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(model_path or default_path()))

    def counted(texts: list[str | None]) -> list:
        sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
        return [sizes, pa.array(ready(shared.value).count(texts))]

    return per_text(docs, "n_bytes long, n_tokens long", counted, text, id_column).withColumn("over_limit", F.col("n_tokens") > limit)


def words_of(text: str) -> Iterator[str]:
    """The words that the first transducer makes of one text without special strings."""
    kinds = Kinds()(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    at = [*np.flatnonzero(begins(np.append(kinds, np.uint8(END)))).tolist(), len(text)]
    yield from (text[a:b] for a, b in zip(at, at[1:], strict=False))
