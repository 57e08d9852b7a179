"""The order by impact, held against cases by hand."""

from tidemark.operators.impact_order import impact_order

SCHEMA = "reel string, ordinal long, kind string, score int, start double, end double"


def places(spark, rows):
    df = spark.createDataFrame([("r", k, *row) for k, row in enumerate(rows)], SCHEMA)
    return [r.ordinal for r in impact_order(df, "reel").orderBy("place").collect()]


def test_hook_build_climax(spark):
    # impacts: 80+15=95, 60+9=69, 90+0-8=82, 100+18=118 (the climax), 70+12=82
    rows = [("snap", 8, 0.0, 6.0), ("wave_catch", 6, 10.0, 15.0), ("paddle", 9, 20.0, 25.0), ("aerial", 10, 30.0, 36.0), ("carve", 7, 40.0, 45.0)]
    assert places(spark, rows) == [0, 1, 2, 4, 3]
    rows[0] = ("snap", 8, 0.0, 11.0)  # too long for a hook: 95 - 2.1
    assert places(spark, rows) == [4, 1, 2, 0, 3]
    low = [("paddle", 9, 0.0, 5.0), ("snap", 9, 5.0, 9.0), ("wipeout", 3, 9.0, 12.0)]
    assert places(spark, low) == [0, 2, 1]  # none but low kinds is left to open


def test_neighbours_of_one_kind_and_reels_that_stay(spark):
    snaps = [("snap", s, float(s), s + 4.0) for s in (1, 2, 3)] + [("carve", 5, 20.0, 24.0), ("aerial", 9, 30.0, 34.0), ("barrel", 10, 40.0, 44.0)]
    assert places(spark, snaps) == [4, 0, 3, 2, 1, 5]  # 1 gives its place to the carve, then no other kind is left
    assert places(spark, [("snap", 1, 0.0, 4.0), ("aerial", 9, 5.0, 9.0)]) == [0, 1]
    assert places(spark, [("goal", 9, 0.0, 4.0), ("pass", 1, 5.0, 9.0), ("goal", 5, 9.0, 12.0)]) == [0, 1, 2]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, "snap", 5, 0.0, 4.0), ("r", 1, None, None, None, None), ("r", 2, "SNAP", 5, 0.0, 4.0), ("r", 3, "snap", 5, 0.0, 4.0)], SCHEMA)
    assert {(r.reel, r.ordinal): r.place for r in impact_order(df, "reel").collect()} == {(None, 1): None, ("r", 1): 2, ("r", 2): 3, ("r", 3): 1}
    assert impact_order(df.limit(0), "reel").collect() == []
