"""Words of many texts at once, as numpy arrays over their UTF-8 bytes: places, documents and 64-bit hashes, no Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"


def byte_table(separators: bytes) -> np.ndarray:
    """What each byte becomes: 0 for a separator, A-Z lower-cased, anything else itself."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    t[0] = 0 if 0 in separators else 255  # 0 marks separators; 255 is in no UTF-8 text
    return t


SPACED = byte_table(BLANKS)  # words [^\x20\x09-\x0D]+
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, back):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Slice:
    """Some texts: their bytes, where each begins (`at`, one more than texts), and their words' begins, ends and texts."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, table: np.ndarray):
        self.raw, self.at, self.n = raw, at, len(at) - 1
        self.low = table[raw]
        word = self.low != 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = at[:-1][at[1:] > at[:-1]]
        first[full] = word[full]
        last[full[1:] - 1] = word[full[1:] - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.word_at = np.searchsorted(self.begin, at)  # the first word of each text, and the number of words
        self.n_words = np.diff(self.word_at)
        self.text_of = np.repeat(np.arange(self.n), self.n_words)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, then mixed."""
        size = max(1 << 20, 1 << int(len(self.low)).bit_length())
        up, down = powers(size)
        total = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum(self.low * up[: len(self.low)], out=total[1:])
        return mixed((total[self.end] - total[self.begin]) * down[self.begin])

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words of a text, and the texts. A text of fewer words, but not none, has all of them as one."""
        n = max(0, len(hashes) - k + 1)
        whole = self.text_of[:n] == self.text_of[k - 1 :] if n else np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for o in range(k):
            out = out * BASE + hashes[o : o + n]
        out, of = mixed(out[whole]), self.text_of[:n][whole]
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j, i in enumerate(short):
                x = 0
                for h in hashes[self.word_at[i] : self.word_at[i + 1]].tolist():
                    x = (x * int(BASE) + h) % (1 << 64)
                own[j] = x
            out, of = np.concatenate([out, mixed(own)]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
        return out, of


def slices(batch: pa.RecordBatch, column: int, table: np.ndarray, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """A batch in parts of about `most_bytes` bytes of text (or one longer text), each with its words. Null texts are empty."""
    texts = batch.column(column)
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most_bytes, "right")) - 1)
        high = min(high, low + 4096, len(texts))
        yield batch.slice(low, high - low), Slice(raw[at[low] : at[high]], at[low : high + 1] - at[low], table)
        low = high
