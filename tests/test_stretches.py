"""Tracks stitched by stretches: one group at a time is small, and the result is that of all segments in one go."""

import math
import random

from tidemark.operators import sequential

SCHEMA = "source string, class string, raw string, t double, frame long, x1 double, y1 double, x2 double, y2 double, width int, height int"


def boxes(a, b):
    """Overlap over union, centre distance and size ratio."""
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    s, t = ((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))
    away = math.dist(((a[0] + a[2]) / 2, (a[1] + a[3]) / 2), ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2))
    return both / (s + t - both), away, min(s, t) / max(s, t)


def one_go(data, most_gap):
    """raw -> track of each source, all segments against all tracks."""
    out, by = {}, {}
    for r in data:
        by.setdefault((r[0], r[2]), []).append(r)
    for source in {s for s, _ in by}:
        own = sorted((min(x[3] for x in v), max(x[3] for x in v), raw, min(v, key=lambda x: x[3:5]), max(v, key=lambda x: x[3:5])) for (s, raw), v in by.items() if s == source)
        tracks = []
        for start, end, raw, first, last in own:
            able = []
            for t in tracks:
                if not 0 <= start - t["end"] <= most_gap:
                    continue
                both, distance, like = boxes(t["last"], first[5:9])
                if (both >= 0.05 or distance / math.hypot(1920, 1080) <= 0.12) and like >= 0.15:
                    able.append((distance / math.hypot(1920, 1080), start - t["end"], -both, len(able), t))
            t = min(able)[-1] if able else None
            if t is None:
                tracks.append({"name": raw, "end": end, "last": last[5:9]})
                t = tracks[-1]
            elif end >= t["end"]:
                t["end"], t["last"] = end, last[5:9]
            out[source, raw] = t["name"]
    return out


def fixture():
    rnd, data = random.Random(21), []
    for k in range(400):
        source, t0 = "hot" if k % 3 else "v", rnd.choice([0, 60, 200, 1000]) + rnd.uniform(0, 40)
        for step in range(3):
            x, y = rnd.uniform(0, 500), rnd.uniform(0, 300)
            data.append((source, "person", f"r{k}", t0 + step * rnd.uniform(0.1, 2), 10 * k + step, x, y, x + 100, y + 200, 1920, 1080))
    return data


def test_equal_to_one_go(spark):
    data = fixture()
    got = {(r.source, r.raw): r.track for r in sequential.stitched_tracks(spark.createDataFrame(data, SCHEMA)).select("source", "raw", "track").distinct().collect()}
    assert got == one_go(data, 3.0)


def test_python_gets_one_stretch_at_a_time(spark):
    plan = sequential.stitched_tracks(spark.createDataFrame(fixture(), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [source" in plan and "stretch" in plan.split("FlatMapGroupsInPandas")[1].splitlines()[0]
