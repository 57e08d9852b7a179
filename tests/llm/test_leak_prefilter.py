"""Words that collide in the detector's tables must not hide an item."""

import random

import numpy as np
from brute import leak_hits

from tidemark.llm import decontaminate
from tidemark.llm.words import ALNUM, Slice


def sliced(texts):
    raw = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    return Slice(np.frombuffer(raw, np.uint8), at, ALNUM)


def invented(rnd, n):
    return ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randrange(4, 10))) for _ in range(n)]


def test_a_colliding_word_before_or_after_an_item(spark):
    rnd = random.Random(11)
    known = invented(rnd, 4000)
    items = [(str(k), " ".join(rnd.choice(known) for _ in range(30))) for k in range(200)]
    it = decontaminate.Detector(items, 10)
    others = sorted(set(invented(rnd, 60_000)) - set(known))
    docs = {}
    for k, (_, text) in enumerate(items[:40]):
        w = text.split()
        for near, place in ((w[0], 0), (w[-1], 1)):
            pairs = sliced([f"{o} {near}" if place == 0 else f"{near} {o}" for o in others])
            h = pairs.hashes()
            hit = it.two[it._pairs(h)][::2] & ~it.one[h[place::2] >> it.shift]  # the pair looks like an item's, the outside word doesn't
            for o in np.flatnonzero(hit)[:2]:
                docs[len(docs)] = f"{others[o]} {text} tail" if place == 0 else f"head {text} {others[o]}"
    assert len(docs) > 20
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.leak_report(df, bench).collect()}
    assert got == leak_hits(docs, items)


def test_crowded_tables_lose_nothing():
    """Tables of 2**9 places, where most words and pairs collide, and items of one, two and three words."""
    rnd = random.Random(12)
    words = invented(rnd, 600)
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    for least in (1, 2, 3, 10):
        items = [(str(k), some(rnd.choice([least, 15]))) for k in range(12)]
        docs = {k: " ".join([some(rnd.randrange(1, 6)), rnd.choice(items)[1], some(rnd.randrange(1, 6))]) for k in range(300)}
        found = decontaminate.Detector(items, 10, bits=9).hits(sliced([t + " " for t in docs.values()]))
        want = {k: n for k, (_, n) in leak_hits(docs, items).items() if n}
        assert {k: sum(b - a for a, b in spans) for k, (spans, _) in found.items()} == want
