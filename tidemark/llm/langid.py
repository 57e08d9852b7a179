"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit one binary logistic classifier over hashed letter 1- to 3-grams
predicts the bit. A text's bit margins are decoded with the logistic loss: the language whose codeword loses least wins,
and a small gap to the runner-up flags the text as ambiguous.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, per_text

UNDETERMINED = "und"
OUT = "lang_pred string, score double, runner_up string, ambiguous boolean"


def hashed_ngrams(text: str, dims: int) -> np.ndarray | None:
    """L2-normalised counts of the letter 1-, 2- and 3-grams of a whole text, words padded by a blank; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(codes.max(initial=0)) + 1
    letter = np.zeros(top, bool)
    seen = np.flatnonzero(np.bincount(codes, minlength=top)) if top <= 1 << 16 else np.unique(codes)
    letter[[c for c in seen.tolist() if chr(c).isalpha()]] = True
    is_letter = letter[codes] if len(codes) else np.zeros(0, bool)
    if not is_letter.any():
        return None
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(is_letter, codes, 0)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # one blank between words
    c = padded[keep] * np.uint32(0x9E3779B1)
    two = (c[:-1] ^ (c[1:] * np.uint32(31) + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (c[2:] * np.uint32(1009))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - int(math.log2(dims)))
    counts = np.zeros(dims, np.float32)
    for grams in (c[1:-1] ^ np.uint32(0x5BD1E995), two, three):
        counts += np.bincount((grams * np.uint32(0x2C1B3C6D)) >> shift, minlength=dims)
    counts = np.sqrt(counts)
    return counts / np.sqrt(counts @ counts)


def codebook(n: int, bits: int, seed: int) -> np.ndarray:
    """n codewords of -1/1: of many random books, one whose two nearest words are farthest apart and whose columns all split."""
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200 if n <= 64 else 8):
        book = rng.choice(np.array([-1.0, 1.0], np.float32), (n, bits))
        if n > 1 and (np.abs(book.sum(0)) == n).any():
            flat = np.abs(book.sum(0)) == n
            book[rng.integers(n), flat] *= -1
        alike = book @ book.T
        np.fill_diagonal(alike, -bits)
        gap = int((bits - alike.max(initial=-bits)) // 2)
        if gap > most:
            best, most = book, gap
    return best


class LanguageModel:
    def __init__(self, languages: list[str], book: np.ndarray, weights: np.ndarray, bias: np.ndarray, min_margin: float):
        self.languages, self.book, self.weights, self.bias, self.min_margin = languages, book, weights, bias, min_margin

    def losses(self, features: np.ndarray) -> np.ndarray:
        """Mean logistic loss of each language's codeword against the bit margins, one row a text."""
        margins = features @ self.weights + self.bias
        ones = (self.book > 0).astype(np.float32).T  # a bit costs one amount where it is 1 and another where it isn't, so two products give all losses
        return (np.logaddexp(0, -margins) @ ones + np.logaddexp(0, margins) @ (1 - ones)) / self.book.shape[1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, str | None, bool]]:
        out = [(UNDETERMINED, 0.0, None, False)] * len(texts)
        dims, rows, at = len(self.weights), [], []
        for i, text in enumerate(texts):
            if text and self.languages and (x := hashed_ngrams(text, dims)) is not None:
                rows.append(x)
                at.append(i)
            if rows and (len(rows) == 512 or i + 1 == len(texts)):
                self._decode(np.stack(rows), at, out)
                rows, at = [], []
        if rows:
            self._decode(np.stack(rows), at, out)
        return out

    def _decode(self, x: np.ndarray, at: list[int], out: list) -> None:
        loss = self.losses(x)
        share = np.exp(-self.book.shape[1] * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        order = np.argsort(loss, 1, kind="stable")
        for k, i in enumerate(at):
            first, second = order[k, 0], order[k, 1] if len(self.languages) > 1 else None
            gap = math.inf if second is None else loss[k, second] - loss[k, first]
            out[i] = (self.languages[first], float(share[k, first]), None if second is None else self.languages[second], bool(gap < self.min_margin))


def train(features: np.ndarray, labels: list[str], bits: int | None = None, rounds: int = 300, seed: int = 11, min_margin: float = 0.1) -> LanguageModel:
    """All bits (by default 15, more beyond 8 languages) at once by Nesterov gradient steps on the logistic loss; every language weighs the same."""
    languages = sorted(set(labels))
    dims = features.shape[1] if len(labels) else 1
    bits = bits or max(15, 4 * len(languages).bit_length())  # more languages need longer words
    book = codebook(max(1, len(languages)), bits, seed)
    weights, bias = np.zeros((dims, bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) > 1:
        place = {x: k for k, x in enumerate(languages)}
        y = np.array([place[x] for x in labels])
        target = book[y]
        weigh = (1 / np.bincount(y)[y] / len(languages)).astype(np.float32)[:, None]
        v, vb, rate = weights.copy(), bias.copy(), np.float32(8.0)
        for k in range(rounds):
            g = -target * weigh / (1 + np.exp(np.clip(target * (features @ v + vb), -30, 30)))
            step_w = v - rate * (features.T @ g + 1e-5 * v)
            step_b = vb - rate * g.sum(0)
            m = k / (k + 3)
            v, vb = step_w + m * (step_w - weights), step_b + m * (step_b - bias)
            weights, bias = step_w, step_b
    elif languages:
        bias = book[0] * 3
    return LanguageModel(languages, book, weights, bias, min_margin)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", each: int = 400, dims: int = 4096, most_rows: int = 8192) -> LanguageModel:
    """Fits on about `each` rows of every language there is (one at least; fewer of each where they would be over `most_rows` in all, twice that and one of each at
    most; of more than 4,096 values of `lang` the commonest), a stated bounded sample. Whole texts become counts on the executors, of which only those above 0 are sent; the driver
    holds 2 * most_rows * dims * 4 bytes at most."""

    def features(texts: list, langs: list) -> list:
        got = [hashed_ngrams(t, dims) for t in texts]
        places = [None if x is None else np.flatnonzero(x).astype(np.uint16) for x in got]
        return [langs, [None if p is None else p.tobytes() for p in places], [None if x is None else x[p].tobytes() for x, p in zip(got, places, strict=True)]]

    labelled = rows.select(F.col(id_column).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("y")).where("t is not null and y is not null")
    sample = bounded(labelled, "y", each, "i", most_rows=most_rows)
    got = per_text(sample, "y string, p binary, x binary", features, "t", "i", more=("y",)).where("x is not null").select("y", "p", "x").collect()
    got.sort()  # the same model however the rows were dealt
    x = np.zeros((len(got), dims), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r.p, np.uint16)] = np.frombuffer(r.x, np.float32)
    return train(x, [r.y for r in got])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score, runner_up, ambiguous. One pass, nothing shuffled.

    Null, empty and letterless texts are `und` with score 0. With no labelled row to learn from, all are `und`. Repeated rows
    give repeated results; other columns are not looked at. Equal losses go to the language that sorts first. A very long text is
    counted as a whole, in memory of some 30 bytes a character.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims * bits floats, whatever the input's size
    return per_text(docs, OUT, lambda texts: list(zip(*shared.value.predict(texts), strict=True)) or [[]] * 4, text, id_column)
