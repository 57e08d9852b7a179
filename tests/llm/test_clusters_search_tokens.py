"""Delta Lloyd, wavelet search and transducer counts against plain programs, on nulls, ties, repeats, long texts, clashing names and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import lexical, lloyd, tokencounts
from tidemark.llm.common import table

LOWER = {i: i + 32 for i in range(65, 91)}
VECTORS = "vec_id long, embedding array<float>, cluster string, block int"
TEXTS = "doc_id long, text string, term string, n_tokens int"


# Delta Lloyd


def lloyd_plainly(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest(), i or 0)
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners, strict=True) if o == n]
            if own:
                centroids[n] = [math.floor(Fraction(sum(x), len(own))) for x in zip(*own, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    within = Counter()
    for _, d, n in last:
        within[n] += d
    return sorted(((i, n, d, within[n], sum(within.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in last), key=str)


@pytest.mark.parametrize("n", [0, 3, 700])
def test_lloyd_like_a_plain_program(spark, n):
    rnd = random.Random(n)
    near = [[rnd.choice([-1.0, 0.0, 0.5]) for _ in range(64)] for _ in range(5)]
    rows = [(rnd.choice([i, 3, None]) if i % 9 == 0 else i, [round(x + rnd.choice([0, 0.01, -0.25]), 4) for x in rnd.choice(near)]) for i in range(n)]
    rows += [(9001, None), (9002, [0.0] * 63), (9003, [0.0] * 63 + [float("nan")]), (9004, [0.0] * 63 + [float("inf")]), (9005, [None] + [0.0] * 63), (9006, [])]
    rows += rows[:40]
    given = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in given], VECTORS).repartition(3)
    out = lloyd.cluster(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == lloyd_plainly(given)


def test_lloyd_looks_at_changed_centroids_only():
    """A vector whose owner stood still isn't held against centroids that did; results are those of a full round."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-3, 4, (400, 6))
    old = rnd.integers(-3, 4, (5, 6))
    full = np.ones(5, bool)
    none = np.full(400, -1), np.zeros(400, np.int64)
    owner, near = lloyd.reassigned(x, *none, old, full)
    new = old.copy()
    new[1] += 1
    want = lloyd.reassigned(x, *none, new, full)
    got = lloyd.reassigned(x, owner, near, new, np.arange(5) == 1)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    poisoned = new.copy()
    poisoned[[0, 2, 3, 4]] = 10**6  # a centroid said to be unchanged isn't looked at by those who keep their owner
    got = lloyd.reassigned(x, owner, near, poisoned, np.arange(5) == 1)
    assert (got[0][owner != 1] == want[0][owner != 1]).all()


def test_lloyd_rounds_are_not_shuffled(spark, sf_dir, monkeypatch):
    plans = []
    keep = lloyd.Bucketed.keep
    monkeypatch.setattr(lloyd.Bucketed, "keep", lambda self, df, dealt=False: (dealt or plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df, dealt))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert lloyd.cluster(table(spark, sf_dir, "embeddings")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 2 and not any("hashpartitioning" in p for p in plans)


def test_lloyd_refuses_what_has_no_exact_distance(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        lloyd.cluster(df).collect()


# wavelet search


def search_plainly(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [(4096, 1 << 20), (7, 1 << 20), (4096, 50)])
def test_search_like_a_plain_program(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "MOST_DOCS", most[0])
    monkeypatch.setattr(lexical, "MOST_POSTINGS", most[1])
    rnd = random.Random(11)
    vocabulary = ["a", "É", "straße", "x9", "Ünder", "中文", *(f"w{n}" for n in range(60))]
    say = lambda n: " ".join(rnd.choice(vocabulary[: rnd.choice([5, 20, 66])]) for _ in range(n))
    docs = [(i, say(rnd.choice([1, 5, 40, 200]))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in (900, 901, 5, 902, None, None)]  # ties, an id twice, no id
    docs += [(910, None), (911, ""), (912, "... !"), (913, "Long-" + "w1 w2 W3;" * 9000)]
    items = [(n, say(12)) for n in range(12)] + [(3, "w1 w2"), (None, "w5 É x9"), (None, "w6"), (20, None), (21, ""), (22, "nowhere"), (23, docs[5][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], TEXTS).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = search_plainly(docs, items)
    assert sorted((tuple(r) for r in lexical.search(d, q).collect()), key=str) == want
    assert sorted((tuple(r) for r in lexical.search(d, q, most_terms=20).collect()), key=str) == want


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), spark.createDataFrame([(1, "a c d")], "item_id long, text string")
    names = ["item_id", "rank", "doc_id", "score"]
    for d, i in ((docs.limit(0), items), (docs.where("doc_id > 9"), items), (docs, items.where("item_id > 9"))):
        out = lexical.search(d, i)
        assert out.columns == names and out.collect() == []
    assert lexical.search(docs, items.selectExpr("cast(item_id as string) as item_id", "text")).schema["item_id"].dataType.simpleString() == "string"


def test_search_leaves_nodes_unopened(monkeypatch):
    """Best-first with bounds opens few of a tree's nodes where one document stands out."""
    rnd = random.Random(2)
    now = lexical.Gathered()
    for i in range(2000):
        now.add(i, Counter(f"w{rnd.randrange(400)}".encode() for _ in range(30)) | (Counter({b"rare": 3, b"w1": 2}) if i == 77 else Counter()))
    shard = now.shard().to_pylist()[0]
    n_docs, n_terms = shard["n_docs"], shard["n_terms"]
    doc, count, starts = np.frombuffer(shard["docs"], np.uint32), np.frombuffer(shard["counts"], np.uint32), np.array(shard["starts"])
    worth = lexical.impacts(count, lexical.lengths(shard["sizes"], n_docs, n_terms)[doc])
    order = np.lexsort((doc, -worth, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
    levels, bits, at = lexical.depth(n_docs), [], doc[order]
    for level in range(levels - 1, -1, -1):
        bit = (at >> level) & 1
        bits.append(np.packbits(bit.astype(bool)))
        at = np.concatenate([at[bit == 0], at[bit == 1]])
    tree = lexical.Tree(shard["ids"], shard["sizes"], starts, count[order], np.concatenate(bits), n_docs, n_terms)
    seen = []
    bounds = tree.bounds
    monkeypatch.setattr(tree, "bounds", lambda level, *rest: (seen.append(len(level)), bounds(level, *rest))[1])
    terms = shard["terms"].split("\n")
    asked = np.array([[terms.index("rare"), terms.index("w1"), -1]])
    best = lexical.Best(1, 1)
    lexical.best_first(tree, np.array([0]), asked, np.array([[7000, 900, 0]]), best)
    assert best.key[0, 0] == 77 and sum(seen) < 400  # of 4,000


# transducer counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokens():
    return tokencounts.Tokens(tokencounts.Model(tokencounts.default_path()))


def test_counts_are_the_librarys(library, tokens):
    rnd = random.Random(3)
    texts = ["", "a", "'s", " 's", "!'s", "'re", "'ra", "'r", "'ll'lx", "''s", "\n's", "\n\n 's", "a  b", "a \n", "  ", "\n", "don't we've I'll x'd", "<|endoftext|>"]
    texts += ["a <|endoftext|><|endoftext|> b  <|endoftext|>c", "<|endoftext<|endoftext|>", "a" * 3000, " " * 700 + "y", "-" * 1000, "\u0085　 x ", "x́̈ ำ"]
    alphabet = "aaabcdelrstvmLL'' '  \n\t!.,-_19é中́\U0001f600 <|>"
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0, 0x2FFF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(1, 200))) for _ in range(400)]
    texts += ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5000))]
    assert tokens.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_the_librarys(library):
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("ab's rvel 'tm\n\t!9é中 ") for _ in range(rnd.randint(1, 700)))
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert list(tokencounts.words_of(text)) == want


def test_state_maps_compose():
    """A scan gives each chunk the state that reading all before it leads to, whatever was cut where."""
    rnd = np.random.default_rng(1)
    maps = rnd.integers(0, 9, (37, 9)).astype(np.uint8)
    state, want = np.arange(9), []
    for m in maps:
        state = m[state]
        want.append(state)
    assert (tokencounts.scanned(maps) == np.array(want)).all()


def test_small_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "SLICE", 50)
    model = tokencounts.Model(tokencounts.default_path())
    small = tokencounts.Tokens(model)
    small.counter = tokencounts.Reader(model.pairs, most_states=5, most_words=3)
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abc de fg hi' s") for _ in range(rnd.randint(0, 900))) for _ in range(60)]
    assert small.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_tokens(spark, sf_dir, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "Same text"), (3, "Same text"), (4, "word " * 300_000), (5, "x" * 40_000)]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], TEXTS)
    out = tokencounts.count_tokens(df)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), size(t), size(t) > 1024) for i, t in rows]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    assert tokencounts.count_tokens(df.limit(0)).collect() == []
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert all(r.n_tokens == size(docs[r.doc_id]) for r in tokencounts.count_tokens(table(spark, sf_dir, "documents")).collect())


def test_other_models_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokencounts.Model(public_tokenizers.path("word_bpe_49k.json"))
