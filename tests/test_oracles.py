"""Every query of the library against its SQL in DuckDB, on the same files."""

import datetime
import glob
import os

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = db.execute(ORACLES[name])
    named = [d[0] for d in cur.description]
    assert sorted(named) == cols
    want = sorted((tuple(plain(r[named.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_interval_joins_keep_an_equal_key(spark, sf_dir):
    for name in ("q01_pairwise_overlap", "q05_detections_in_window", "q27_band_match"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
