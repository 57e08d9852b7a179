"""The toxicity model is fitted on every labelled row, of any length, in groups whose steps are averaged."""

import re

import numpy as np

from tidemark.llm import toxicity


def rows_of(spark, n=900):
    """A toxic row has a word of its own kind; one kind is that of a single text of 45,000 words, and of no other."""
    plain = [f"plain{k}" for k in range(40)]
    rnd = np.random.default_rng(4)
    text = lambda i: " ".join([*rnd.choice(plain, 30), *(["awful"] if i % 3 == 0 else [])])
    rows = [(i, text(i), "en" if i % 2 else "de") for i in range(n)] + [(n, "plain1 " * 45_000 + "awful", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n + 1)], "doc_id long, toxic int")


def test_every_labelled_row_is_stepped_through_or_counted(spark, monkeypatch):
    docs, labels = rows_of(spark)
    seen = []
    judge = toxicity.threshold
    monkeypatch.setattr(toxicity, "threshold", lambda z, y, w: seen.append(w.sum()) or judge(z, y, w))
    held = docs.selectExpr("pmod(xxhash64(5, cast(doc_id as string)), 5) = 0 as held").where("held").count()
    packed = []
    dealt = toxicity._packed
    monkeypatch.setattr(toxicity, "_packed", lambda rows, groups: packed.append((rows.count(), groups)) or dealt(rows, groups))
    model = toxicity.fit(docs, labels, group_rows=200)
    assert packed == [(901, 5)] and seen[0] == held  # no row is left out for its number or its length
    assert set(model.thresholds) == {"", "de", "en"} and sum(seen[1:]) == held
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(r.predicted == (i % 3 == 0) for i, r in got.items()) > 0.98 * len(got) and got[900].predicted == 1


def test_the_model_is_the_same_however_rows_are_dealt(spark):
    docs, labels = rows_of(spark, 200)
    one, two = (toxicity.fit(docs.repartition(n), labels.repartition(n), group_rows=40, least=5) for n in (1, 7))
    assert one.thresholds == two.thresholds and all(np.array_equal(one.p[k], two.p[k]) for k in one.p)
    assert np.array_equal(one.languages.weights, two.languages.weights)


def test_words_are_shuffled_once(spark, monkeypatch):
    docs, labels = rows_of(spark, 60)
    plans = []
    keep = toxicity.Scratch.keep
    monkeypatch.setattr(toxicity.Scratch, "keep", lambda self, df, name: plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")) or keep(self, df, name))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # labels that are too many to be sent to all
    try:
        toxicity.fit(docs, labels, group_rows=20, least=5, visits=100)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    carried = [len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\bw#", p)) for p in plans]
    assert sum(carried) == 1, carried  # before, once to meet their labels and once more to meet their group


def test_words_meet_their_labels_in_one_python_step(spark):
    words = spark.createDataFrame([(i, "en", i % 5 == 0, 4, bytes([i, 0, 0, 0])) for i in [*range(40), 7]], "i long, l string, held boolean, n long, w binary")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5, 60, 2)], "i long, y int")
    packed = toxicity._packed(toxicity.Labelled(words, labels), 6)
    assert packed._jdf.queryExecution().executedPlan().toString().count("InArrow") == 1  # one Python worker a task
    got = [x for r in packed.collect() for x in zip(np.frombuffer(r.w, np.int32).tolist(), r.y, r.held, r.n, strict=True)]
    assert sorted(got) == sorted((i, i % 2, i % 5 == 0, 1) for i in [*range(5, 40, 2), 7])  # neither words without label nor labels without words
