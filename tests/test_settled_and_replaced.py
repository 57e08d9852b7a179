"""Sets that settle before they are sent, states refreshed on change, tables replaced at once."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.states import batch_states
from tidemark.sources import sinks
from tidemark.streaming import live

UPLOADS = "batch_id string, upload_id string, state string, cleanup_pending boolean, at long, deleted boolean"
STATES = "batch_id string, expected long, actual long, verified long, failed long, cleanup_pending long, manifest array<string>, state string"


def test_a_set_is_sent_once_it_has_settled(spark, tmp_path):
    """b comes a while after a, so both go as one; a never goes again though it is listed again; a set that empties isn't sent."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    inbox, schema = tmp_path / "in", "folder string, id string, there boolean"

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(inbox))

    put(("raw", "a", True), ("gone", "x", True))
    out = live.settled_sets(spark.readStream.schema(schema).parquet(str(inbox)), "folder", "id", "there", quiet_seconds=9)
    q = out.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    sent = lambda: sorted((r.key, tuple(r.ids)) for r in spark.table("settled").collect())

    def until(done, seconds):
        end = time.time() + seconds
        while not done() and time.time() < end:
            assert q.isActive, q.exception()
            time.sleep(0.3)

    try:
        until(lambda: any(p.numInputRows for p in q.recentProgress), 60)
        put(("raw", "b", True), ("raw", "a", True), ("gone", "x", False))
        until(lambda: sum(p.numInputRows for p in q.recentProgress) >= 5, 30)
        assert sent() == []  # the clock began anew
        until(sent, 60)
        assert sent() == [("raw", ("a", "b"))]
        put(("raw", "a", True), ("raw", "c", True))
        until(lambda: len(sent()) > 1, 60)
        assert sent() == [("raw", ("a", "b")), ("raw", ("c",))]
    finally:
        q.stop()
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_refresh_equals_the_batch_form_after_every_micro_batch(spark, tmp_path):
    rnd = random.Random(6)
    batches = spark.createDataFrame([(f"b{k}", k % 4 + 1) for k in range(30)], "batch_id string, expected long")
    uploads = sinks.KeptByKey(spark, str(tmp_path / "uploads"), "batch_id", UPLOADS, buckets=8)
    states = sinks.KeptByKey(spark, str(tmp_path / "states"), "batch_id", STATES, buckets=8)
    write, seen = live.refresh_on_change(uploads, states, batches), []
    for number in range(4):
        some = rnd.sample(range(31), 4)  # b30 is no known batch
        rows = [(f"b{rnd.choice(some)}", f"u{rnd.randrange(6)}", rnd.choice(["verified", "uploading", "failed"]), rnd.random() < 0.2, 100 * number + k, rnd.random() < 0.2) for k in range(20)]
        before = states.versions()
        changes = spark.createDataFrame(rows, UPLOADS)
        touched = uploads.touched(changes)
        opened = uploads.read(touched).inputFiles()
        assert all(int(f.split("bucket=")[1].split("/")[0]) in touched for f in opened)
        for _ in range(1 + (number == 2)):  # a repeated batch changes nothing
            write(changes, number)
        assert {b: v for b, v in states.versions().items() if int(b) not in touched} == {b: v for b, v in before.items() if int(b) not in touched}
        seen += rows
        last = spark.createDataFrame(seen, UPLOADS).groupBy("batch_id", "upload_id").agg(F.max_by(F.struct("state", "cleanup_pending", "deleted"), "at").alias("r")).select("batch_id", "upload_id", "r.*")
        changed = {r[0] for r in seen}
        want = {r.batch_id: r.asDict() for r in batch_states(batches, last.where("not deleted")).collect() if r.batch_id in changed}
        assert {r.batch_id: r.asDict() for r in states.read().collect()} == want


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        sinks.current_table(spark, path)
    sinks.replace_table(spark.range(5), path)
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="half-way"):
        sinks.replace_table(broken, path)
    assert sinks.current_table(spark, path).count() == 5
    begun = sinks.current_table(spark, path)
    sinks.replace_table(begun.selectExpr("id + 10 as id"), path)  # from its own rows
    assert sorted(r.id for r in begun.collect()) == [0, 1, 2, 3, 4] and sorted(r.id for r in sinks.current_table(spark, path).collect()) == [10, 11, 12, 13, 14]
    sinks.replace_table(spark.range(1), path)
    assert len(json.loads(sinks.read_small(spark, f"{path}/{sinks.CURRENT}"))) == 2 and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 3  # two versions and the broken one
    sinks.replace_json(spark.range(3), str(tmp_path / "j"))
    assert sinks.current_table(spark, str(tmp_path / "j"), "json").count() == 3
