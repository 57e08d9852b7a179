"""The pipeline's stages one after another, each held against what a plain program does with its input."""

import random

import pytest

import corpus_pipeline
from brute import leak_hits, near_groups


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The small tables, with planted documents of far ids: an exact copy, a near copy, a repeated passage, a benchmark passage, null and empty texts."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4))) for _ in range(4000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    base, passage = text(120), text(70)
    near = list(base)
    near[60] = "changed"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [
        (90_001, " ".join(base)), (90_002, " ".join(base)), (90_003, " ".join(near)), (90_004, " ".join(text(50) + passage + text(50))), (90_005, " ".join(text(80) + passage + text(10))),
        (90_006, " ".join(text(100)) + " " + item + " " + " ".join(text(100))), (90_007, None), (90_008, ""), (90_009, " ".join(text(150))), (None, "no id at all"),
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    out = tmp_path_factory.mktemp("sf")
    docs.unionByName(more).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return str(out), dict(rows)


def test_stages(spark, folder, tmp_path):
    path, planted = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "tokens":
            assert docs.columns == columns
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
            assert len(after) > 0.75 * len(before) and set(planted) <= set(after)
            assert all(after[i].text == before[i] for i in after)
            gone = [labels[i] for i in before if i not in after and i in labels]
            assert sum(gone) >= 0.5 * len(gone)
        elif name == "near_duplicates":
            groups = near_groups({i: t for i, t in before.items() if i is not None})
            assert {i for i in after if i is not None} == {i for i in groups if groups[i] == i} and None in after
            assert 90_002 not in after and 90_003 not in after
        elif name == "repeated_passages":
            assert set(after) == set(before) and after[90_005].text != before[90_005] and len(after[90_005].text.split()) < 120
            assert all(after[i].text == before[i] for i in (90_001, 90_004, 90_006, 90_007, 90_008, 90_009, None))
        elif name == "benchmark_leaks":
            hits = leak_hits(before, items)
            assert {i for i in before if i not in after} == {i for i, (n, hit) in hits.items() if hit > 0.5 * n}
            assert all((after[i].text == before[i]) == (hits[i][1] == 0) for i in after)
            assert hits[90_006][1] > 0 and not any(hit for _, hit in leak_hits({i: r.text for i, r in after.items() if hits[i][1]}, items).values())
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())


def test_run_of_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
