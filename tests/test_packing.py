"""Packing by pointers from block to block against a plain next-fit program."""

import numpy as np
import pytest

from tidemark.operators import packing, sequential

LEVELS = [(9, 0.5, 2.5), (7, 0.4, 2.0)]


def plain(rows, budget, fade):
    """place -> (part, seconds of the part) of one reel: (seconds, score, slow) in order."""
    part, total, best, more, of, lengths = -1, 0.0, -np.inf, 0.0, [], []
    for seconds, score, slow in rows:
        level = next(((share, times) for least, share, times in LEVELS if score >= least), None) if slow else None
        own = seconds * level[0] * (level[1] - 1) if level else 0.0
        longer = total + seconds - fade
        top, extra = (score, own) if level and score > best else (best, more)
        if part < 0 or max(0.0, longer + extra) > budget:
            part, total, best, more = part + 1, seconds, score if level else -np.inf, own
            lengths.append(0.0)
        else:
            total, best, more = longer, top, extra
        lengths[part] = max(0.0, total + more)
        of.append(part)
    return [(p, lengths[p]) for p in of]


@pytest.mark.parametrize("block, longest", [(4, 20), (7, 2), (1000, 20)])
def test_blocks_change_nothing(spark, block, longest):
    """Reels of one to 150 events over blocks of 4 and 7: parts that cross one block or many, events shorter than a fade, equal scores."""
    rng = np.random.default_rng(block)
    rows, want = [], {}
    for reel, n in enumerate([1, 3, 4, 5, 8, 9, 29, 64, 150]):
        events = [(float(rng.integers(0, longest * 4)) / 4, int(rng.integers(5, 11)), bool(rng.random() < 0.4)) for _ in range(n)]
        rows += [(reel, k, *e) for k, e in enumerate(events)]
        want.update({(reel, k): p for k, p in enumerate(plain(events, 30.0, 0.25))})
    df = spark.createDataFrame(rows, "reel int, ordinal long, seconds double, score int, slow boolean").repartition(3)
    rank, gain = packing.stretched(df.seconds, df.score, df.slow, LEVELS)
    got = packing.parts(df.withColumns({"rank": rank, "gain": gain}), "reel", ["ordinal"], 30.0, 0.25, block=block, group=40).collect()
    assert len(got) == len(rows)
    assert {(r.reel, r.ordinal): (r.part, r.seconds) for r in got} == want


def test_one_long_reel_of_production_blocks(spark):
    """20,000 events of one reel are ten blocks; no block is more than one group's rows."""
    n = 20_000
    df = spark.range(n).selectExpr("'r' reel", "id ordinal", "concat('s', id % 3) source", "cast(id as double) start", "id + 4.0 + (id * 7919) % 13 as end", "cast(5 as int) score")
    got = {r.ordinal: r.part for r in sequential.packed_parts(df, "reel").select("ordinal", "part").collect()}
    order = sorted(range(n), key=lambda k: (k % 3, k))
    want = plain([(4.0 + (k * 7919) % 13, 5, False) for k in order], 89.0 - 2.75, 0.25)
    assert got == {k: p for k, (p, _) in zip(order, want, strict=True)}


def test_rows_without_reel_time_or_source_and_empty_tables(spark):
    schema = "reel string, ordinal long, source string, start double, end double, score int, part_ string"
    rows = [("a", 1, None, 0.0, 10.0, 5, "x"), ("a", 2, "s", 50.0, 60.0, 5, "x"), (None, 3, "s", 0.0, 9.0, 5, "x"), ("a", 4, "s", None, 9.0, 5, "x"), ("a", 5, "s", 0.0, 200.0, 5, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r.ordinal: (r.part, r.seconds) for r in sequential.packed_parts(df, "reel", budget=15.0).collect()}
    assert got == {1: (1, 10.0), 2: (0, 10.0), 3: (None, None), 4: (None, None), 5: (-1, 200.0)}
    unscored = spark.createDataFrame([("a", 1, 0.0, 9.0, None), ("a", 2, 0.0, 9.0, 1), ("a", 3, 0.0, 40.0, 9)], "reel string, ordinal long, start double, end double, score int")
    assert {r.ordinal: r.part for r in sequential.scored_parts(unscored, "reel", budget=20.0).collect()} == {3: 0, 2: 1, 1: 1}
    assert sequential.packed_parts(df.limit(0), "reel").collect() == []
    assert sequential.scored_parts(unscored.limit(0), "reel").collect() == []
