"""The operators on small tables: against brute force, exact round trips, and the cases every one must bear."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunks, decontaminate, langid, licenses, neardup, pieces, shards, superminhash, topk, toxicity, warc
from tidemark.llm.common import table

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, cls long, leak string"

SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def documents(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="module")
def odd(words):
    """Null, empty, blank, tiny, repeated and very long texts, null and repeated ids."""
    rnd = random.Random(6)
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    base = " ".join(rnd.choice(words) for _ in range(90))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (5, base), (6, base), (7, base + " tail"), (8, long), (9, long[:200_000]), (None, base), (None, None), (10, "déjà VU À l'été 日本語"), (11, "one")]


def similar_groups(rows):
    sets = {i: (frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])) for i, t in rows for w in [spaced(t)]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, words):
    rnd = random.Random(7)
    rows, k = [], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 120]))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((k := k + 1, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == similar_groups(rows)


def test_near_duplicates_of_a_large_loose_group(spark, words):
    """Copies of one text around the limit: many candidates, part of them linked only through others; small blocks force all block pairs."""
    rnd = random.Random(8)
    base = [rnd.choice(words) for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows), block=32).collect()}
    assert got == {i: c for i, (_, c) in similar_groups(rows).items()}


def test_near_duplicates_odd_rows(spark, odd):
    got = neardup.near_duplicates(documents(spark, odd)).collect()
    assert len(got) == len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.component_id for i in (5, 6, 7) for r in by[i]] == [5] * 4 and all(r.kept for r in by[5]) and not by[6][0].kept
    assert all(r.n_shingles == 0 and r.component_id == i and r.kept for i in (1, 2, 3) for r in by[i])
    assert by[11][0].component_id == 4 and all(r.component_id is None and r.kept for r in by[None])
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_superminhash_is_the_sequential_one():
    """The signature made step by step for all elements equals the one made element by element."""
    m, rnd = 16, np.random.default_rng(1)
    for n in (1, 3, 12, 60):
        elements = rnd.integers(1, 1 << 62, n).astype(np.uint64)
        want = [np.iinfo(np.uint64).max] * m
        for e in elements:
            p = list(range(m))
            for j in range(m):
                value, place = superminhash.draws(np.array([e]), j, m)
                k = int(place[0])
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], int(value[0]))
        got = superminhash.signatures(elements, np.zeros(n, np.int64), 1, m)[0]
        assert got.tolist() == want


def test_signatures_tell_the_similarity():
    rnd = np.random.default_rng(2)
    pool = rnd.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = pool[:200], pool[100:]
    got = superminhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 512)
    assert abs(superminhash.estimate(got[0], got[1]) - 100 / 300) < 0.07


def test_repeated_passages(spark, words):
    rnd = random.Random(9)
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = text(52)
    line = text(12)
    rows = [(1, " ".join(text(100) + shared + text(80))), (2, " ".join(text(33) + shared + text(50))), (3, " ".join(text(300))), (4, " ".join(text(40) + line + text(40))), (5, " ".join(text(60) + line + text(9)))]
    docs = documents(spark, rows)
    got = chunks.repeated_passages(docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(2, 1)}
    cut = rows[1][1].encode()[got[0].begin : got[0].end].decode()
    assert cut in " ".join(shared) and len(cut.split()) == got[0].words >= 28
    after = {r.doc_id: r.text for r in chunks.deduplicated(docs).collect()}
    assert [after[i] for i in (1, 3, 4, 5)] == [rows[i - 1][1] for i in (1, 3, 4, 5)]
    assert after[2] == rows[1][1].replace(cut, " ")


def test_chunks_resist_insertions(spark, words):
    rnd = random.Random(10)
    for seed in range(60):
        w = [rnd.choice(words) for _ in range(51)]
        rows = [(1, " ".join([rnd.choice(words) for _ in range(rnd.randrange(70))] + w)), (2, " ".join(["x" * rnd.randrange(1, 9)] + w + [rnd.choice(words)] * rnd.randrange(20)))]
        s = [chunks.Slice(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), chunks.SPACED) for _, t in rows]
        inner = []
        for x in s:
            ends = [x.low[x.begin[k] : x.end[k]].tobytes().decode() for k in np.flatnonzero(chunks.cuts(x, 10))]
            inner.append([e for e in ends if e in w])
        assert len(set(inner[0]) & set(inner[1])) >= 3


def test_repeats_odd_rows(spark, odd):
    docs = documents(spark, odd)
    assert {r.doc_id for r in chunks.repeated_passages(docs).collect()} == {6, 7, 9}
    out = chunks.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(odd)
    assert chunks.deduplicated(documents(spark, [])).count() == 0


def brute_leaks(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(g) for g in windows}
    out = {}
    for i, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= who
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("alphabet, block", [(6, 1 << 20), (6, 400), (60, 1 << 20)])
def test_leaks_equal_brute_force(spark, alphabet, block):
    """Few different words, so that items overlap themselves and each other; short items too; and a benchmark of several blocks."""
    rnd = random.Random(alphabet)
    said = lambda n: " ".join(f"w{rnd.randrange(alphabet)}" for _ in range(n))
    items = [(k, said(rnd.choice([1, 2, 4, 9, 10, 11, 25, 40]) if k % 3 else 30)) for k in range(25)] + [(90, "!!"), (91, "")]
    docs = [(k, said(rnd.randrange(0, 80)) + ". " + (items[k % 25][1].upper() if k % 4 == 0 else "")) for k in range(60)] + [(100, None), (101, "")]
    bench = spark.createDataFrame(items + [(92, None)], "item_id long, text string")
    found = decontaminate.find_leaks(documents(spark, docs), bench, most_bytes=block)
    assert found.columns == [*SCHEMA_NAMES, "leak_"]  # the documents' own column of that name stays
    rows = found.collect()
    got = {r.doc_id: (r.leak_.n_words, sum(s.past - s.first for s in r.leak_["spans"]), list(r.leak_["items"])) for r in rows}
    assert len(rows) == len(docs) and all(r.leak == "y" for r in rows)
    assert got == brute_leaks(docs, items)
    for r in rows:  # the stretches' bytes are those of their words
        text = (r.text or "").encode()
        for s in r.leak_["spans"]:
            assert alnum(text[s.begin : s.end].decode()) == alnum(r.text)[s.first : s.past]


def test_leaks_of_a_large_benchmark_are_one_pass(spark):
    """However large the benchmark, documents go through one Python stage for their windows, and nothing is broadcast but bitmaps."""
    bench = spark.range(400).select(F.col("id").alias("item_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * 13 + k) % 997) for k in range(20))).alias("text"))
    docs = bench.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    found = decontaminate.find_leaks(docs, bench, most_bytes=500)
    assert found.where("size(leak.spans) = 1 and leak.spans[0].past - leak.spans[0].first >= 20").count() == 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 0  # all was written before; only rows with leaks are joined
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("size(leak.spans) > 0").count() == 0


def test_decontaminated_text(spark, words):
    rnd = random.Random(12)
    item = [rnd.choice(words) for _ in range(30)]
    clean = " ".join(rnd.choice(words) for _ in range(90))
    rows = [(1, "Été: " + clean + " " + " ".join(item[5:22]) + ", done."), (2, clean), (3, " ".join(item)), (4, None)]
    out = {r.doc_id: r.text for r in decontaminate.decontaminated(documents(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert out == {1: "Été: " + clean + "  " + ", done.", 2: clean, 4: None}


def test_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.4, 12).round(1)]) for i in range(400)] + [(400, None), (450, [None] * 12), (500, [float("nan")] * 12), (550, [0.5] * 11), (600, rows0 := [0.25] * 12), (601, rows0), (602, rows0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 50 == 0, block=64, queries_in_block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-int(v @ whole[q]), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert got.pop(q, []) == [(i, -s) for s, i in scores]
    assert not got


def test_topk_stops_early():
    """With a few outstanding vectors most lists are never read to the end."""
    rnd = np.random.default_rng(3)
    x = rnd.integers(-10, 10, (2000, 4)).astype(np.float32)
    x[:8] *= 50
    lists, depths = topk.Lists(x), []
    read = lists.read
    lists.read = lambda d: depths.append(d) or read(d)
    list(topk.top_k(np.abs(x[:1]), np.array([0]), lists, np.arange(2000), 5))
    assert max(depths) < 2000


def test_topk_stops_early_on_the_embeddings(spark, sf_dir):
    """On the real vectors nearly all queries stop before the lists' ends, and the bounds hold at every depth."""
    rows = table(spark, sf_dir.replace("sf0.001", "sf0.1"), "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v")).where("v is not null").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], np.float32)
    lists, q = topk.Lists(x), x[ids % 50 == 0]
    exact = q @ x.T
    asked = {}
    for depth in (250, 1000, 1500, 1750, len(x)):
        lower, upper = topk.bounds(q, lists, depth)
        assert (lower <= exact).all() and (upper >= exact).all()
        bar = np.sort(lower, 1)[:, -5]
        asked[depth] = float(((upper >= bar[:, None]).sum(1) <= len(x) // 16).mean())
    assert asked[1500] > 0.5 and asked[1750] > 0.95


def test_topk_of_an_empty_table_and_of_no_query(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df, F.col("vec_id") % 50 == 0).count() == 0
    assert [(r.query_id, r.vec_id) for r in topk.search(df.withColumns({"id": F.lit(1), "dims": F.lit(2), "rank": F.lit(0)}), F.col("vec_id") == 1).collect()] == [(1, 2)]


def test_pieces_equal_the_library(spark, sf_dir, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(documents(spark, odd).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    n = 0
    by_text = {t or "": sp.encode(t or "") for _, t in texts}
    rows = pieces.encode(docs.withColumn("ids", F.lit(1))).join(docs.distinct(), "doc_id").collect()
    for r in rows:
        if len([1 for i, _ in texts if i == r.doc_id]) == 1:
            n += 1
            assert list(r.ids) == by_text[r.text or ""] and r.n_tokens == len(r.ids) and r.round_trip
    assert n > 190
    back = pieces.decode(pieces.encode(docs)).join(docs.distinct().withColumnRenamed("text", "was"), "doc_id").where("doc_id > 20").collect()
    assert back and all(r.text == (r.was or "") for r in back)


def test_unigram_search_is_the_best_of_all():
    p = pieces.Pieces(pieces.default_path(), "unigram")
    p.ids = {c: k for k, c in enumerate(["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab"])}
    rnd = random.Random(2)
    p.scores = {c: -rnd.random() * 5 for c in p.ids}

    def best(w):
        return 0.0 if not w else max((p.scores[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p.scores), default=-1e9)

    e = pieces.Encoder(p)
    names = {v: k for k, v in p.ids.items()}
    for _ in range(40):
        w = "▁" + "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9)))
        ids, _ = e.encode([w[1:]])
        got = [names[i] for i in ids.tolist()]
        assert "".join(got) == w and abs(sum(p.scores[g] for g in got) - best(w)) < 1e-9


def test_shards(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(documents(spark, odd).select("doc_id", "text"))
    rows = shards.shard(docs, 8).collect()
    texts = Counter(len((r.text or "").encode()) + 8 for r in docs.collect())
    assert Counter(r["size"] for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.text_crc32 for r in rows if r["size"] == 8} == {zlib.crc32(b"")}
    even = shards.shard(spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1999).cast("string")).alias("text")), 24).collect()
    weight, of = Counter(), defaultdict(set)
    for r in even:
        weight[r.shard] += r["size"]
        of[r.text_crc32].add(r.shard)
    assert len(weight) == 24 and max(weight.values()) < 1.03 * min(weight.values())
    assert sum(len(v) > 1 for v in of.values()) <= 24
    copies = shards.shard(spark.range(900).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text")), 6).groupBy("shard").count().collect()
    assert len(copies) == 6 and max(r["count"] for r in copies) - min(r["count"] for r in copies) <= 2
    assert shards.shard(documents(spark, [])).count() == 0


def test_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").limit(40).unionByName(spark.createDataFrame([(900, None, None), (901, "http://x", ""), (902, "http://y", "<p>a &amp; b<script>no</script><br>c</p>")], "page_id long, url string, html string"))
    source = warc.responses(pages)
    one, two = (sorted((r.asDict(True) for r in x.collect()), key=lambda r: (r["page_id"], r["record_type"])) for x in (warc.derivatives(source), warc.built(pages)))
    assert one == two and len(one) == 86
    known = {r.record_id: r for r in source.collect()}
    for r in one:
        s = known[r["refers_to"]]
        assert (r["target_uri"], r["date"], r["refers_to_payload_digest"]) == (s.target_uri, s.date, s.payload_digest)
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"])
    assert [bytes(r["block"]).decode() for r in one if r["page_id"] == 902 and r["record_type"] == "conversion"] == ["a & b\nc"]
    data = b"".join(warc.serialized(r) for r in one)
    assert [(x["headers"], x["block"]) for x in warc.parsed(data)] == [(r["headers"], bytes(r["block"])) for r in one]
    import gzip

    members = {r.record_id: bytes(r.member) for r in warc.members(warc.built(pages)).collect()}
    assert all(gzip.decompress(members[r["record_id"]]) == warc.serialized(r) for r in one)


def test_licenses(spark, odd):
    mit = licenses.TEXTS["mit-text"]
    broken = mit.replace("without restriction, including", "with some small restriction including also").replace("merge,", "")
    rows = [(20, "MIT  License; and the mit-license. GNU General\nPublic License!"), (21, mit), (22, broken), (23, mit[:150]), (24, "general public"), (25, "mit licenſe mit license")]
    docs = documents(spark, odd + rows)
    got = {r.doc_id: r for r in licenses.scan(docs).collect() if r.doc_id is not None}
    assert licenses.scan(docs).count() == len(odd) + len(rows)
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels, got[20].labels, got[20].score) == (3, 0, 7, "gpl,mit", "gpl,mit", 1.0)
    assert got[21].labels == "mit-text" and got[21].score == 1.0 and got[21].n_base == 0
    assert got[22].labels == "mit-text" and licenses.LEAST <= got[22].score < 1
    assert got[23].labels == "" and 0 < got[23].score < licenses.LEAST
    assert got[24].n_base == 0 and got[25].n_base == 1
    assert (got[1].n_words, got[1].score, got[1].labels) == (0, 0.0, "")
    assert licenses.scan(documents(spark, [])).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_language_codes(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, odd), model).collect()}
    assert [again[i] for i in (1, 2, 3)] == ["und"] * 3 and again[5] != "und"
    nobody = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.limit(5), nobody).collect()} == {"und"}


def test_codewords_are_apart():
    book = langid.codebook(6, 15, 1)
    assert min((book[i] != book[j]).sum() for i in range(6) for j in range(i)) >= 5


def test_toxicity(spark, odd):
    rnd = random.Random(13)
    plain = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]
    text = lambda bad: " ".join([rnd.choice(plain) for _ in range(40)] + (["awful", "rotten"] if bad else []) + [rnd.choice(plain) for _ in range(20)])
    rows = [(i, text(i % 4 == 0)) for i in range(500)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows if i % 3] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == int(i % 4 == 0) for i, _ in rows if i % 3 == 0) > 0.95 * len([1 for i, _ in rows if i % 3 == 0])
    assert toxicity.score(documents(spark, odd), model).where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.kept(docs, model).count() == sum(p == 0 for p in got.values())
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}


def test_gradients_are_those_of_the_loss():
    m = toxicity.ToxicityModel(bits=6, half=3, filters=2)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(0, 1 << 12, n) for n in (3, 7, 12)]
    y, weigh = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        total = 0.0
        for d, t in zip(docs, y, strict=True):
            x = np.vstack([m.embedded(d), np.zeros((2, 6))])
            h = []
            for w in toxicity.WIDTHS:
                a = sum(x[o : o + len(d)] @ m.p[f"k{w}"][o] for o in range(w)) + m.p[f"b{w}"]
                h.append(np.maximum(a.max(0), 0))
            z = np.concatenate(h) @ m.p["v"] + m.p["c"][0]
            total += np.logaddexp(0, -z if t else z) / 3
        return total

    g = toxicity.gradients(m, docs, y, weigh)
    for name in ("v", "k2", "b1", "t1", "t2"):
        flat = m.p[name].reshape(-1)
        for at in np.argsort(-np.abs(g[name].reshape(-1)))[:3]:
            was, eps = flat[at], 1e-5
            flat[at] = was + eps
            up = loss()
            flat[at] = was - eps
            down = loss()
            flat[at] = was
            assert abs((up - down) / 2 / eps - g[name].reshape(-1)[at]) < 1e-4
