import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.queries import QUERIES
from tidemark.sources import readers, sinks
from tidemark.streaming import live


def test_json_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_video": "v", "frame_width": 10, "frame_height": 20, "detections": [{"frame_index": 1, "time_sec": 0.5, "bbox_xyxy": [1, 2, 3, 4], "class_name": "person", "track_id": "7"}]}))
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.json").write_text(json.dumps({"source_video": "w", "frames": [{"frame_index": 3, "time_sec": 1.5, "width": 8, "height": 9, "detections": [{"bbox_xyxy": [1, 2, 3, 4], "track_id": "1"}]}]}))
    good, bad = readers.json_objects(spark, str(tmp_path), readers.SIDECAR)
    assert bad.count() == 1
    d = {r.source_video: r for r in readers.detections(good).collect()}
    assert (d["v"].frame_width, d["w"].frame_width, d["w"].time_sec, d["w"].frame_index) == (10, 8, 1.5, 3)
    fine, rejected = readers.normalised_detections(readers.detections(good))
    assert (fine.count(), rejected.first().reason) == (1, "missing_class")


def test_listing_and_logs(spark, tmp_path):
    (tmp_path / "x.MP4").write_bytes(b"abc")
    (tmp_path / "y.txt").write_text("critical: DUPLICATE_MOMENT\n3 draft(s) uploaded\n")
    assert readers.listing(spark, str(tmp_path)).count() == 1
    rows = readers.log_lines(spark, str(tmp_path / "y.txt"), {"uploaded": r"(\d+) draft\(s\) uploaded", "code": r"critical: (\w+)"}).collect()
    assert {(r.uploaded, r.code) for r in rows} == {("3", None), (None, "DUPLICATE_MOMENT")}
    digest = {r.key.rsplit("/", 1)[1]: r.sha256 for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert digest["x.MP4"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_merge_versions(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string, at long")
    order = [F.desc("at")]
    sinks.merge_table(spark, str(tmp_path), rows((1, "a", 1), (1, "b", 2), (2, "c", 1)), ["k"], order, 0)
    out = sinks.merge_table(spark, str(tmp_path), rows((2, "d", 5), (3, "e", 1)), ["k"], order, 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "b"), (2, "d"), (3, "e")]


def test_tumbling_stream_equals_batch(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).write.parquet(str(src))
    stream = live.event_time(spark.readStream.schema(schema).parquet(str(src)))
    q = live.tumbling_counts(stream, ["event_type"], late="0 seconds").writeStream.format("memory").queryName("tumbling").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.event_type, r.s): r.rows for r in spark.sql("select event_type, cast(start as long) s, max(rows) as rows from tumbling group by 1, 2").collect()}
    want = {(r.event_type, r.start): r.rows for r in QUERIES["q54_tumbling_counts"](spark, sf_dir).collect()}
    assert got == want


def test_once_and_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k long, v string, at long")
    live.upsert_sink(str(tmp_path / "out"), ["k"], "at")(rows, 3)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect()] == [(1, "b")]
    late = live.late_rows(spark.createDataFrame([(5.0, 0.0, 10.0), (10.5, 0.0, 10.0), (12.0, 0.0, 10.0)], "t double, lo double, hi double"), "t", "lo", "hi")
    assert [(r.t, r.place) for r in late.orderBy("t", "place").collect()] == [(5.0, "inside"), (10.0, "clamped"), (12.0, "outside_chunk_bounds")]


def events_stream(spark, sf_dir, folder, parts=4):
    """The events as a stream of some files in order of time, one a batch."""
    e = live.event_time(spark.read.parquet(f"{sf_dir}/events.parquet"))
    ordered = e.select("*", F.ntile(parts).over(Window.orderBy("ts")).alias("part")).cache()
    for k in range(parts):  # files are taken in order of their age
        ordered.where(F.col("part") == k + 1).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(df, name, folder, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_quiet_sessions_on_a_stream(spark, sf_dir, tmp_path):
    """Every session that the watermark has passed comes once, with the rows that the batch form gives it."""
    e, stream = events_stream(spark, sf_dir, tmp_path / "in")
    got = [(r.user_id, r.first, r.past, r.rows) for r in drained(live.quiet_sessions(stream, ["user_id"], quiet="2 hours", late="0 seconds"), "quiet", tmp_path / "c", "append").collect()]
    want = {(r.user_id, r.first, r.past, r.rows) for r in live.quiet_sessions(e, ["user_id"], quiet="2 hours").collect()}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) > 0.7 * len(want)


def test_once_on_a_stream(spark, sf_dir, tmp_path):
    e, stream = events_stream(spark, sf_dir, tmp_path / "in")
    got = [r.user_id for r in drained(live.once(stream, "user_id", late="1000 days"), "once", tmp_path / "c", "append").collect()]
    assert sorted(got) == sorted({r.user_id for r in e.collect()})


def test_rate_limit_on_a_stream(spark, sf_dir, tmp_path):
    e, stream = events_stream(spark, sf_dir, tmp_path / "in")
    count = lambda df: live.sliding_counts(df, ["event_type"], 2, width="2 hours", slide="1 hour", late="0 seconds")
    got = {(r.event_type, r.start): r.rows for r in drained(count(stream), "sliding", tmp_path / "c", "update").groupBy("event_type", "start").agg(F.max("rows").alias("rows")).collect()}
    assert got == {(r.event_type, r.start): r.rows for r in count(e).collect()}


def test_allowed_and_latest_on_a_stream(spark, sf_dir, tmp_path):
    e, stream = events_stream(spark, sf_dir, tmp_path / "in")
    kinds = ["view", "purchase"]
    status = live.latest_status(live.allowed_events(stream, "event_type", kinds).select("user_id", "ts", "event_type"), "user_id", "ts", "event_type")
    rows = drained(status, "latest", tmp_path / "c", "update").groupBy("key").agg(F.max_by("value", "at_ns").alias("value")).collect()
    want = e.where(F.col("event_type").isin(kinds)).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("value")).collect()
    assert {r.key: r.value for r in rows} == {r.user_id: r.value for r in want}


def test_digests_of_files_larger_than_a_chunk(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 5000
    (tmp_path / "large.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")  # Spark lists no empty files
    got = {r.key.rsplit("/", 1)[1]: r.sha256 for r in readers.file_digests(spark, str(tmp_path), chunk=1000).collect()}
    assert got == {"large.bin": hashlib.sha256(data).hexdigest()}
