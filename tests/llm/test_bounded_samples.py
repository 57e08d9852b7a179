"""Samples that models are fitted on: every class has a row, and what the driver holds is bounded whatever the rows are."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity
from tidemark.llm.common import bounded


def test_every_class_has_a_row_however_many_there_are(spark):
    rows = spark.range(6000).withColumn("y", F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 300).cast("string"))))
    got = {r.y: r["count"] for r in bounded(rows, "y", 400, "id", most_rows=301).groupBy("y").count().collect()}
    assert len(got) == 301 and sum(got.values()) <= 3 * 301
    assert bounded(rows, "y", 400, "id").where("y != 'hot'").groupBy("y").count().where("count < 10").count() == 0  # all of the small ones
    few = {r.y for r in bounded(rows, "y", 2, "id", most_classes=3).select("y").distinct().collect()}
    assert few == {"hot", "c0", "c1"}  # the commonest, equal ones in order
    assert bounded(rows.limit(0), "y", 5, "id").count() == 0
    assert bounded(rows.withColumn("y", F.lit(None).cast("string")), "y", 5, "id").count() == 0


def test_losses_by_products_are_those_of_each_codeword():
    rnd = np.random.default_rng(2)
    book = rnd.choice(np.array([-1.0, 1.0], np.float32), (7, 15))
    m = langid.LanguageModel(list("abcdefg"), book, rnd.normal(size=(64, 15)).astype(np.float32), rnd.normal(size=15).astype(np.float32), 0.1)
    x = rnd.normal(size=(40, 64)).astype(np.float32)
    margins = x @ m.weights + m.bias
    plain = np.array([[np.mean([np.log1p(np.exp(-np.float64(a * c))) for a, c in zip(row, word)]) for word in book] for row in margins])
    assert np.allclose(m.losses(x), plain, atol=1e-5)


def test_a_sample_of_long_texts_is_bounded_by_its_words(spark):
    rows = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as y", "encode(repeat('abcd', cast(10 + id as int)), 'utf-8') as w").withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    got = toxicity._within(rows, 1500).collect()
    for label in (0, 1):
        own = sorted((r.h, len(r.w) // 4) for r in rows.collect() if r.y == label)
        told = np.cumsum([n for _, n in own])
        assert sorted(r.h for r in got if r.y == label) == [h for (h, _), t in zip(own, told) if t <= 1500]
    assert toxicity._within(rows, 1).count() == 2 and toxicity._within(rows, 10**9).count() == 200 and toxicity._within(rows.limit(0), 5).count() == 0
