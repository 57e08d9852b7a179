"""Operators without SQL against plain programs: shards' tree, scores, codes, passages by length, WARC records, and two pipeline stages."""

import base64
import hashlib
import json
import math
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chunks, langid, shards, toxicity, warc
from tidemark.llm.common import table


def said(rnd, n, letters=3):
    return ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(letters)) for _ in range(n)]


# shards


def test_every_cut_of_the_tree(spark, sf_dir):
    """Each node is cut along its widest dimension, at one place of its key, into bytes in proportion to its leaves."""
    docs = table(spark, sf_dir, "documents").unionByName(spark.createDataFrame([(None, None), (9001, ""), (9002, "")], "doc_id long, text string"), allowMissingColumns=True)
    tolerance, n = 0.01, 11
    placed = {(r.doc_id, r.text_crc32): r.shard for r in shards.shard(docs, n, tolerance).collect()}
    whole = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(whole) + 8).alias("bytes"), F.crc32(whole.cast("binary")).alias("crc"), F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("h"), *(c.alias(d) for d, c in shards.metadata(whole).items())).collect()
    span = {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in shards.DIMS}

    def check(part, low, high):
        if high - low == 1:
            assert all(placed[r.doc_id, r.crc] == low for r in part)
            return
        middle = low + (high - low) // 2
        wide = max(shards.DIMS, key=lambda d: (max(r[d] for r in part) - min(r[d] for r in part)) / span[d])
        key = lambda r: (r[wide], r.crc, r.h)
        left, right = ([r for r in part if (placed[r.doc_id, r.crc] < middle) == side] for side in (True, False))
        assert not left or not right or max(map(key, left)) < min(map(key, right))
        total, leaf = sum(r.bytes for r in part), sum(r.bytes for r in part) / (high - low)
        near = [r.bytes for r in ([max(left, key=key)] if left else []) + ([min(right, key=key)] if right else [])]
        assert abs(sum(r.bytes for r in left) - total * (middle - low) / (high - low)) <= tolerance * leaf + max(near, default=0)
        check(left, low, middle)
        check(right, middle, high)

    check(rows, 0, n)


def test_shards_of_ties_at_every_cut(spark):
    """All rows alike in every dimension and text: only the ids' hashes part them."""
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    counts = [r["count"] for r in shards.shard(df, 7).groupBy("shard").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 2


# classifiers


def test_toxicity_scores_are_those_of_the_net():
    """The packed scorer against the net written out word by word, filter by filter."""
    m = toxicity.ToxicityModel(bits=9, half=3, filters=2, seed=3)
    m.p = {k: (v * 20 if k[0] == "t" else v) for k, v in m.p.items()}
    m.languages, m.thresholds = langid.train(np.zeros((0, 1), np.float32), []), {"": 0.25}
    rnd, words = random.Random(4), toxicity.Words(9)
    texts = [None, "", "  ", "one", *(" ".join(said(rnd, k)) for k in (2, 3, 40, 9000))]
    got, _ = m.score(texts, words, m.projected())
    for text, score in zip(texts, got, strict=True):
        rows = [np.concatenate([m.p["t1"][w & 511], m.p["t2"][w >> 9]]) for w in words(text).tolist()] or [np.zeros(6)]
        rows += [np.zeros(6)] * 2
        z = float(m.p["c"][0])
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(2):
                best = max(sum(float(rows[at + o] @ m.p[f"k{width}"][o, :, f]) for o in range(width)) for at in range(len(rows) - 2)) + float(m.p[f"b{width}"][f])
                z += max(0.0, best) * float(m.p["v"][k * 2 + f])
        assert abs(score - 1 / (1 + math.exp(-(z - 0.25)))) < 1e-4


def test_thresholds_come_from_rows_that_no_step_saw(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "threshold", lambda z, y, w: seen.append(len(y)) or 0.0)
    rows = [(i, " ".join(said(random.Random(i), 20) + (["awful"] if i % 3 == 0 else [])), "en", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, i long")  # a column named as the operator's own
    toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"), least=5)
    assert seen and max(seen) <= 60


def test_codes_are_decoded_by_their_loss():
    rnd = np.random.default_rng(5)
    model = langid.LanguageModel([f"l{k}" for k in range(9)], langid.codebook(9, 20, 1), rnd.normal(0, 1, (64, 20)).astype(np.float32), rnd.normal(0, 1, 20).astype(np.float32), 0.1)
    texts = [" ".join(said(random.Random(k), 12)) for k in range(50)] + [None, "", "12 34!"]
    for text, (name, score, second, unsure) in zip(texts, model.predict(texts), strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score, second, unsure) == ("und", 0.0, None, False)
            continue
        x = langid.hashed_ngrams(text, 64)
        loss = sorted((sum(math.log1p(math.exp(-float(code[b]) * (float(x @ model.weights[:, b]) + float(model.bias[b])))) for b in range(20)) / 20, n) for n, code in zip(model.languages, model.book, strict=True))
        assert (name, second, unsure) == (loss[0][1], loss[1][1], loss[1][0] - loss[0][0] < 0.1) and 0 < score <= 1


def test_every_language_can_be_told(spark):
    """More languages than a short code tells apart: none is left out of the learned values."""
    rows = [(100 * k + j, " ".join(said(random.Random(k), 6) * 3), f"x{k:03d}") for k in range(80) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 80
    got = langid.identify(docs, model).join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)
    assert {r.lang_pred for r in langid.identify(docs.limit(0), model).collect()} == set()


# passages


def test_recall_by_length(spark):
    """Passages of one length shared by two documents at random places: from 51 words on all are found, from 28 on most."""
    rnd, rows, length = random.Random(6), [], {}
    for k in range(600):
        length[k] = (24, 28, 34, 40, 46, 51, 60)[k % 7]
        shared = said(rnd, length[k])
        for side in (0, 1):
            rows.append((2 * k + side, " ".join(said(rnd, rnd.randrange(60)) + shared + said(rnd, rnd.randrange(60)))))
    found = {r.doc_id // 2 for r in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {n: sum(k in found for k in length if length[k] == n) / sum(v == n for v in length.values()) for n in (24, 28, 34, 40, 46, 51, 60)}
    print(share)
    assert share[24] == 0 and share[51] == share[60] == 1 and share[46] > 0.9 and share[40] > 0.6


def test_repeats_within_a_text(spark):
    rnd = random.Random(7)
    passage, other = said(rnd, 80), [said(rnd, 40) for _ in range(3)]
    text = " ".join(other[0] + passage + other[1] + passage + other[2] + passage)
    docs = spark.createDataFrame([(1, text), (1, text), (2, " ".join(["again"] * 300)), (3, " ".join(said(rnd, 12) * 20)), (4, " ".join(said(rnd, 200)))], "doc_id long, text string")
    rows = sorted({(r.doc_id, r.first_doc_id, r.begin, r.end, r.words) for r in chunks.repeated_passages(docs).collect()})
    assert [r[:2] for r in rows] == [(1, 1)] * 2 and all(58 <= r[4] <= 80 for r in rows)
    for _, _, begin, end, _ in rows:
        assert text.encode()[begin:end].decode().strip() in " ".join(passage)
    first = len(" ".join(other[0] + passage))
    assert min(r[2] for r in rows) > first  # the first of them stays


# WARC


def test_a_record_by_hand(spark):
    page = "<html lang='de'><head><title> A &lt; B </title><style>p{}</style></head><body><p>x<a href=\"/q?a=1&amp;b=2\">y</a><br>z <!-- no --><script>no()</script></body></html>"
    row = spark.createDataFrame([(7, "http://h/ä", page, "x", "y")], "page_id long, url string, html string, record_type string, block string")
    got = {r.record_type: r.asDict(True) for r in warc.built(row).collect()}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    payload = page.encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    ident = lambda kind, key, b: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {key} {hashlib.sha256(b).hexdigest()}')}>"
    source = ident("response", f"7 http://h/ä {warc.DATE}", payload)
    text = "A < B\nx y\nz".encode()  # inline elements are blanks, block elements lines
    blocks = {"conversion": text, "metadata": bytes(got["metadata"]["block"])}
    assert bytes(got["conversion"]["block"]) == text
    assert json.loads(blocks["metadata"]) == {
        "title": "A < B", "languages": "de", "outlinks": ["/q?a=1&b=2"], "source-http-headers": {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))},
        "source-content-length": len(payload), "source-payload-digest": sha(payload), "source-block-digest": sha(head + payload),
    }
    for kind, block in blocks.items():
        r = got[kind]
        assert (r["refers_to"], r["target_uri"], r["block_digest"], r["payload_digest"], r["refers_to_payload_digest"], r["content_length"]) == (source, "http://h/ä", sha(block), sha(block), sha(payload), len(block))
        assert r["record_id"] == ident(kind, source, block)
        named = {h["name"]: h["value"] for h in r["headers"]}
        assert named["WARC-Refers-To"] == source and named["Content-Length"] == str(len(block)) and named["WARC-Type"] == kind
    assert warc.built(row.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<!--", "<a href", "<script>", "<script></scriptx", "<", "<svg/>", "<title>", "<!-- -->", "<p>&#99999999999999999999;", "<a href='x' "])
def test_broken_pages_take_no_longer_than_whole_ones(piece):
    page = piece * (500_000 // len(piece))
    began = time.time()
    warc.plain_text(page)
    assert time.time() - began < 5
    warc.plain_text("&#" + "9" * 100_000 + ";")


def test_no_header_can_be_forged(spark):
    rows = [(1, "http://x/\r\nWARC-Type: response\r\n\r\nboo", "<p>a</p>"), (2, " http://y/\tz ", None), (3, None, "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = [r.asDict(True) for r in warc.built(df).collect()] + [r.asDict(True) for r in warc.responses(df).collect()]
    data = b"".join(warc.serialized(r) for r in made)
    assert [(x["headers"], x["block"]) for x in warc.parsed(data)] == [(r["headers"], bytes(r["block"])) for r in made]
    assert all(len([h for h in r["headers"] if h["name"] == "WARC-Type"]) == 1 for r in made)


# pipeline stages


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    """Documents with passages that repeat at several lengths, null, empty and repeated rows, and columns named as the stages' own."""
    rnd, rows = random.Random(8), []
    passages = [said(rnd, n) for n in (20, 30, 52, 70, 120)]
    for k in range(60):
        words = said(rnd, 40)
        for p in rnd.sample(passages, k % 3):
            words += p + said(rnd, rnd.randrange(30))
        rows.append((80_000 + k, " ".join(words)))
    rows += [(81_000, None), (81_001, ""), (None, "no id"), (81_002, " ".join(passages[3]) + " x"), (81_002, " ".join(passages[3]) + " x")]
    own = spark.createDataFrame([(i, t, "en", "s", 0, "y", 1, "z", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, leak string, i int, _row string, spans int")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.lit("y").alias("leak"), F.lit(1).alias("i"), F.lit("z").alias("_row"), F.lit(5).alias("spans"))
    return docs.unionByName(own).repartition(5)


def test_toxicity_stage(spark, sf_dir, corpus):
    kept = corpus_pipeline.without_toxic(spark, corpus, sf_dir)
    assert kept.columns == corpus.columns
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(corpus.where(held), table(spark, sf_dir, "labels").where(held))
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    z, words, tables = [], toxicity.Words(model.bits), model.projected()
    for _, t in rows:  # one text at a time
        z.append(model.score([t], words, tables)[0][0])
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((r for r, s in zip(rows, z, strict=True) if s < 0.5), key=repr)


def test_repeated_passages_stage(spark, sf_dir, corpus):
    """After it no document has 51 words in a row that stand in a document of a smaller id; what shares no 28 words in a row is as it was."""
    out = corpus_pipeline.without_repeats(spark, corpus, sf_dir)
    assert out.columns == corpus.columns and out.count() == corpus.count()
    before = {r.doc_id: (r.text or "").lower().split() for r in corpus.where("doc_id is not null").collect()}
    after = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    seen = {51: set(), 28: set()}
    cut = 0
    for i in sorted(before):
        text = (after[i] or "").lower().split()
        assert not grams(text, 51) & seen[51]
        own = grams(before[i], 28)
        if not own & seen[28] and len(own) == max(0, len(before[i]) - 27):
            assert text == before[i]
        cut += text != before[i]
        for n in seen:
            seen[n] |= grams(before[i], n)
    assert cut > 5


def test_near_duplicates_stage_keeps_one_of_equal_rows(spark, sf_dir, corpus):
    out = corpus_pipeline.without_near_duplicates(spark, corpus, sf_dir)
    assert out.columns == corpus.columns
    assert out.where("doc_id = 81002").count() == 1 and out.where("doc_id is null").count() == 1
