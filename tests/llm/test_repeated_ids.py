"""The pipeline's stages judge and cut rows that repeat an id by their own text."""

import random

import corpus_pipeline


def said(rnd, n):
    return ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_duplicates(spark, tmp_path):
    rnd = random.Random(31)
    base, own = " ".join(said(rnd, 90)), " ".join(said(rnd, 90))
    docs = frame(spark, [(1, base), (2, base), (2, own), (2, None), (None, base)])
    out = corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, base), (2, own), (2, None), (None, base)], key=repr)


def test_repeated_passages(spark, tmp_path):
    rnd = random.Random(32)
    passage, other = said(rnd, 70), said(rnd, 80)
    head, tail = " ".join(said(rnd, 20)), " ".join(said(rnd, 20))
    first = " ".join(passage) + " " + " ".join(other)
    a, b, clean = f"{head} {' '.join(passage)} {tail}", f"{' '.join(other)} {head}", " ".join(said(rnd, 150))
    docs = frame(spark, [(1, first), (2, a), (2, b), (2, clean), (2, None)])
    out = corpus_pipeline.without_repeats(spark, docs, str(tmp_path))
    got = [r.text for r in out.where("doc_id = 2").collect()]
    assert len(got) == 4 and clean in got and None in got and out.where("doc_id = 1").first().text == first
    cut = [t for t in got if t not in (clean, None)]
    for whole, most in ((a, 40 + 23), (b, 20 + 23)):  # only words of the passage are gone, and most of them
        mine = [t for t in cut if set(t.split()) <= set(whole.split()) and set(head.split()) <= set(t.split())]
        assert any(len(t.split()) <= most for t in mine)
