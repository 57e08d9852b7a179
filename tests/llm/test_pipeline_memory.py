"""Stages bound the batches that go to Python, whatever the session's own setting is."""

import pytest

import corpus_pipeline

SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("setting, after", [("10000", "1000"), ("0", "1000"), ("300", "300")])
def test_batches_are_bounded(spark, sf_dir, setting, after):
    was = spark.conf.get(SIZE)
    try:
        for stage in (corpus_pipeline.without_leaks, corpus_pipeline.tokens):
            spark.conf.set(SIZE, setting)
            stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
            assert spark.conf.get(SIZE) == after
    finally:
        spark.conf.set(SIZE, was)
