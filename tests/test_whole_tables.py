"""Queries without SQL run over the whole table."""

import duckdb

from tidemark.queries import QUERIES


def test_stitched_tracks_of_all_events(spark, sf_dir):
    got = {r.source: (r.raw_tracks, r.tracks) for r in QUERIES["q60_stitched_tracks"](spark, sf_dir).collect()}
    want = duckdb.execute(f"select event_type, count(distinct (user_id % 20, cast(floor(epoch(ts)) as bigint) // 86400)) from '{sf_dir}/events.parquet' group by 1").fetchall()
    assert {k: raw for k, (raw, _) in got.items()} == dict(want)
    assert all(1 <= tracks <= raw for raw, tracks in got.values())
