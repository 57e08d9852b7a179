import json

from pyspark.sql import functions as F

from tidemark.operators import timeline
from tidemark.plans import sessions


def test_replies(spark):
    reply = {"activity": "surf", "persons": [{"id": "A", "description": "red", "events": [{"type": "jump", "start": 3, "score": 12, "edit": {"zoom": 5, "transition_out": "swirl"}}, {"start": "x"}, {"start": "1.5", "end": 9, "peak_time": 0, "setup_start": "?"}]}, {"description": "no id", "events": []}]}
    df = spark.createDataFrame([("v", "```json\n" + json.dumps(reply) + "\n```"), ("w", "nonsense"), ("x", None)], "source string, raw string")
    good, bad = sessions.events_of(df)
    rows = good.orderBy("event_place").collect()
    assert [(r.start, r.end, r.score, r.zoom, r.transition, r.crop_y) for r in rows] == [(3.0, 13.0, 10, 2.0, "slide", 0.65), (1.5, 9.0, 5, 1.0, "slide", 0.65)]
    assert (rows[1].peak_time, rows[1].setup_start) == (0.0, None)
    assert sorted(r.source for r in bad.collect()) == ["w", "x"]
    assert [(r.start, r.end) for r in sessions.padded(good).orderBy("start").collect()] == [(1.5, 9.0), (3.0, 13.0)]


def test_chunks_on_source_time(spark):
    chunks = timeline.chunk_specs(spark.createDataFrame([("v", 548.9)], "source string, seconds double"), "source", "seconds", 480.0)
    assert sorted((r.chunk_index, round(r.offset, 1), round(r.length, 1)) for r in chunks.collect()) == [(0, 0.0, 480.0), (1, 480.0, 68.9)]
    events = spark.createDataFrame([("v", 0, "A", 2.0, 2.52), ("v", 0, "B", 546.0, 619.0), ("v", 1, "A", 16.0, 32.0)], "source string, chunk_index long, person string, start double, end double")
    good, bad = sessions.on_source_time(events, chunks)
    assert sorted((r.person, r.start, r.end, r.encoding) for r in good.collect()) == [("chunk_00:A", 120.0, 172.0, "minute_second"), ("chunk_01:A", 496.0, 512.0, "decimal_seconds")]
    assert [(r.person, r.reason) for r in bad.collect()] == [("chunk_00:B", "timestamp_outside_chunk_bounds")]


def test_small_reports(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (2, "v", "t", 15), (3, "w", None, None)], "id long, owner string, token string, expires long")
    assert tuple(sessions.expiry_counts(rows, "expires", F.lit(10)).first()) == (1, 1, 1)
    assert sorted(r.id for r in sessions.visible_to(rows, "owner", "token", F.lit("u")).collect()) == [1, 2]
