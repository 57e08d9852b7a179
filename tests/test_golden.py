"""Small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry, intervals, text
from tidemark.operators import greedy, identity, ledger, overlap, policies, reports, sequential, states, timeline


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_source_window_dedup(spark):
    df = spark.createDataFrame([(0, "v", 495.0, 512.5, 10), (1, "v", 493.0, 517.0, 8), (2, "v", 209.0, 223.0, 9)], "ordinal long, source string, start double, end double, score int")
    assert rows(greedy.source_window_dedup(df), "ordinal", "kept", "duplicate_of") == [(0, True, None), (1, False, 0), (2, True, None)] or {r.ordinal: r.kept for r in greedy.source_window_dedup(df).collect()} == {0: True, 1: False, 2: True}


def test_greedy_is_the_same_however_rows_are_dealt(spark):
    rnd = random.Random(3)
    data = [(k, "ab"[k % 2], s := float(rnd.randrange(400)), s + rnd.randrange(3, 60), rnd.randrange(1, 11)) for k in range(300)]

    def brute():
        kept = []
        for o, src, s, e, score in sorted(data, key=lambda r: (-r[4], -(r[3] - r[2]), r[0])):
            hit = any(x[1] == src and min(e, x[3]) - max(s, x[2]) >= 2 and 2 * (min(e, x[3]) - max(s, x[2])) >= min(e - s, x[3] - x[2]) for x in kept)
            if not hit:
                kept.append((o, src, s, e, score))
        return sorted(x[0] for x in kept)

    for seed in (1, 2):
        shuffled = random.Random(seed).sample(data, len(data))
        df = spark.createDataFrame(shuffled, "ordinal long, source string, start double, end double, score int").repartition(5)
        assert sorted(r.ordinal for r in greedy.source_window_dedup(df).where("kept").collect()) == brute()


def test_selector_candidates(spark):
    data = [(0, "p", 12.0, 20.0, 9), (1, "p", 15.0, 22.0, 8), (2, "p", 80.0, 90.0, 7), (3, "p", 40.0, 47.0, 4), (4, "p", 50.0, 53.0, 8)]
    df = spark.createDataFrame(data, "ordinal long, person string, start double, end double, score int")
    out = {r.ordinal: (r.selected, r.discard_cause) for r in greedy.selector_candidates(df, ["person"], least_seconds=6).collect()}
    assert out == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, "score_below_selection_threshold"), 4: (False, "fragment_shorter_than_min_event_sec")}


MMSS = [(2.0, 2.52, 120, 172), (3.0, 3.32, 180, 212), (4.01, 4.21, 241, 261), (5.46, 6.19, 346, 379), (4.52, 5.17, 292, 317), (7.03, 7.35, 423, 455), (0.11, 0.38, 11, 38), (0.52, 1.06, 52, 66), (1.07, 1.21, 67, 81), (2.08, 2.23, 128, 143), (7.39, 7.55, 459, 475), (2.0, 2.05, 120, 125)]


def test_minute_second_recovery(spark):
    df = spark.createDataFrame([(a, b) for a, b, _, _ in MMSS] + [(16.0, 32.0), (2.75, 2.90)], "s double, e double")
    got = [tuple(r.r) for r in df.select(intervals.recovered(F.col("s"), F.col("e")).alias("r")).collect()]
    assert got == [(s, e, "minute_second") for _, _, s, e in MMSS] + [(16.0, 32.0, "decimal_seconds"), (2.75, 2.90, "decimal_seconds")]


@pytest.mark.parametrize(
    "start, end, offset, length, want",
    [
        (11.0, 38.0, 0.0, 480.0, (True, None, "decimal_seconds", 11.0, 38.0)),
        (2.0, 2.52, 0.0, 480.0, (True, None, "minute_second", 120.0, 172.0)),
        (7.39, 7.55, 0.0, 480.0, (True, None, "minute_second", 459.0, 475.0)),
        (453.0, 516.0, 0.0, 480.0, (True, None, "decimal_seconds", 453.0, 480.0)),
        (546.0, 619.0, 0.0, 480.0, (False, "timestamp_outside_chunk_bounds", None, None, None)),
        (16.0, 32.0, 480.0, 68.9, (True, None, "decimal_seconds", 496.0, 512.0)),
        (520.0, 527.0, 480.0, 68.9, (True, None, "decimal_seconds", 520.0, 527.0)),
        (480.5, 490.5, 480.0, 68.9, (True, None, "decimal_seconds", 480.5, 490.5)),
        (8.12, 8.30, 480.0, 68.9, (True, None, "minute_second", 492.0, 510.0)),
        (478.5, 482.0, 0.0, 480.0, (False, "insufficient_time_inside_chunk", "decimal_seconds", None, None)),
    ],
)
def test_chunk_windows(spark, start, end, offset, length, want):
    w = one(spark, intervals.chunk_window(*(F.lit(x) for x in (start, end, offset, length))).alias("w")).w
    got = (w.valid, w.reason, w.encoding, w.start, w.end)
    assert got[:2] == want[:2] and (want[2] is None or got[2] == want[2])
    assert all(a is None or abs(a - b) < 1e-6 for a, b in zip(want[3:], got[3:], strict=True))


def test_overlapping_windows_of_drafts(spark):
    df = spark.createDataFrame([(0, "a", "v", 11.0, 38.0), (1, "a", "v", 121.0, 148.0), (2, "b", "v", 39.0, 106.0)], "o long, draft string, source string, start double, end double")
    assert overlap.overlapping_pairs(df, ["source"], "o", differ="draft").count() == 0
    assert rows(overlap.possible_pairs(df, ["source"], "draft"), "source", "possible_pairs") == [("v", 2)]
    wide = spark.createDataFrame([(0, "a", "v", 12.0, 20.0), (1, "b", "v", 15.0, 22.0)], df.schema)
    assert rows(overlap.overlapping_pairs(wide, ["source"], "o", differ="draft"), "overlap_seconds") == [(5.0,)]


def test_a_long_pair_is_given_once(spark):
    df = spark.createDataFrame([(0, "v", 0.0, 5000.0), (1, "v", 100.0, 4900.0)], "o long, source string, start double, end double")
    assert overlap.overlapping_pairs(df, ["source"], "o", bucket=10).count() == 1


def test_stitched_tracks(spark):
    near, far = (100.0, 100.0, 200.0, 300.0), (1500.0, 600.0, 1600.0, 800.0)
    data = [("10", 10.0, near), ("10", 11.0, near), ("20", 12.5, near), ("20", 13.0, near), ("30", 13.5, far), ("40", 10.5, near), ("40", 12.8, near)]
    df = spark.createDataFrame([("v", "person", t, s, k, *b, 1920, 1080) for k, (t, s, b) in enumerate(data)], "source string, class string, raw string, t double, frame long, x1 double, y1 double, x2 double, y2 double, width int, height int")
    out = sequential.stitched_tracks(df)
    assert dict(rows(out, "raw", "track")) == {"10": "10", "20": "10", "30": "30", "40": "40"}
    assert out.count() == 7


def test_clean_subwindow(spark):
    events = spark.createDataFrame([(1, "v", "a", 0.0, 30.0)], "event_id long, source string, primary string, start double, end double")
    points = spark.createDataFrame([("v", float(t), "a") for t in range(0, 31)] + [("v", 10.0, "b")], "source string, t double, track string")
    got = timeline.clean_subwindows(events, points, ["source"]).first()
    assert (round(got.start, 2), round(got.end, 2), got.hits) == (10.8, 25.8, 15)


def test_rides(spark):
    df = spark.createDataFrame([(0, "v", "t", 10.0, 16.0, 5, None), (1, "v", "t", 17.0, 25.0, 7, 28.0), (2, "v", "t", 40.0, 44.0, 6, None)], "ordinal long, source string, track string, start double, end double, score int, outcome double")
    got = rows(timeline.merged_rides(df, ["source"], "track"), "start", "end", "fragments", "score", "review")
    assert got == [(10.0, 25.0, 2, 7, []), (40.0, 44.0, 1, 6, ["RIDE_BOUNDARY_UNCERTAIN"])]


def test_packing(spark):
    df = spark.createDataFrame([(k, "r", "v", 100.0 * k, 100.0 * k + 18.0, 5) for k in range(6)] + [(9, "s", "v", 0.0, 95.0, 5)], "ordinal long, reel string, source string, start double, end double, score int")
    got = {r.ordinal: r.part for r in sequential.packed_parts(df, "reel").collect()}
    assert [got[k] for k in range(6)] == [0, 0, 0, 0, 1, 1] and got[9] == -1


def test_final_guard(spark):
    schema = "ordinal long, reel string, fingerprint string, event_id string, source string, track string, start double, end double, quality double, teaser boolean"
    data = [
        (0, "a", None, "e", "v", None, 10.0, 18.0, 7.0, False), (1, "a", None, "e", "v", None, 10.2, 18.2, 9.0, False),
        (0, "b", None, None, "v", None, 20.0, 30.0, 5.0, False), (1, "b", None, None, "v", None, 21.0, 29.0, 4.0, False),
        (0, "c", None, None, "v", None, 10.0, 20.0, 5.0, False), (1, "c", None, None, "v", None, 14.0, 16.5, 5.0, True),
    ]
    for reel, want in (("a", [(0, False, "same_event_id"), (1, True, None)]), ("b", [(0, True, None), (1, False, "same_source_time_overlap")]), ("c", [(0, True, None), (1, True, None)])):
        df = spark.createDataFrame([r for r in data if r[1] == reel], schema)
        assert [(r.ordinal, r.kept, r.reason) for r in sequential.final_guard(df, ["reel"]).orderBy("ordinal").collect()] == want


def test_coverage(spark):
    data = [(0, "p7", 10, 20, True, None), (1, "p7", 11, 20, False, "dup"), (2, "B", 30, 45, False, "target_not_trackable"), (3, "p10", 50, 61, False, None)]
    report = reports.coverage(spark.createDataFrame(data, "ordinal long, cluster string, start long, end long, selected boolean, discard_cause string"), "cluster")
    total = reports.coverage_totals(report).first()
    assert (total.clusters, total.represented, total.accounted, total.gaps, total.candidate_seconds, total.selected_seconds) == (3, 1, 2, 1, 45, 10)
    assert dict(rows(report, "cluster", "outcome")) == {"p7": "selected_for_render", "B": "target_not_trackable", "p10": "unresolved_selection_path"}


def test_fingerprints(spark):
    df = spark.createDataFrame([(0, "x", "a.mp4", 7), (1, "x", "b.mp4", 9), (2, None, "a.mp4", 1), (3, "y", "a.mp4", 1), (4, "y", "a.mp4", 2)], "o long, fp string, source string, q int")
    assert rows(greedy.fingerprint_dedup(df, "fp", "source", F.col("q"), "o"), "o", "kept") == [(0, False), (1, True), (2, True), (3, True), (4, True)]


def test_uploads(spark):
    df = spark.createDataFrame([("old", "d", 10), ("new", "d", 11), ("other", "e", 9), ("none", None, 1)], "upload string, digest string, at int")
    got = {r.upload: (r.canonical, r.superseded) for r in timeline.canonical_uploads(df, "digest", [F.desc("at"), F.desc("upload")], "upload").collect()}
    assert got == {"old": ("new", True), "new": ("new", False), "other": ("other", False), "none": ("none", False)}


def test_identity(spark):
    m = spark.createDataFrame([(1, "a", "t7"), (1, "b", "t7"), (2, "a", "t1"), (2, "b", "t2"), (3, "a", None), (3, "b", None), (4, "a", None)], "cluster long, clip string, track string")
    assert dict(rows(identity.identity_gate(m, "cluster", "clip", "track"), "cluster", "status")) == {1: "pass", 2: "conflicting_track_ids", 3: "missing_track_evidence", 4: "unchanged"}
    c = spark.createDataFrame([(1, "track:7"), (2, "track:7"), (3, None), (4, "")], "cluster long, strong string")
    ids = dict(rows(identity.canonical_ids(c, "cluster", "strong"), "cluster", "athlete_id"))
    assert ids[1] == ids[2] and len(set(ids.values())) == 3


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = dict(rows(identity.connected(edges), "node", "comp"))
    assert set(got[k] for k in range(41)) == {0} and got[101] == 100


def test_numbers_and_tokens(spark):
    r = one(spark, text.numbers(F.lit("Bib 7, player 23 and #9")).alias("n"), text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j"), text.unfenced(F.lit('```json\n{"a": 1}\n```')).alias("u"), text.key(F.lit("  Blue-Shirt  #7 ")).alias("k"))
    assert (sorted(r.n), r.j, r.u, r.k) == (["23", "7", "9"], 1 / 3, '{"a": 1}', "blue_shirt_7")


def test_boxes(spark):
    a, b = (tuple(F.lit(float(x)) for x in box) for box in ((0, 0, 10, 10), (5, 5, 15, 15)))
    r = one(spark, geometry.iou(a, b).alias("iou"), geometry.visible_ratio(b, F.lit(10), F.lit(10)).alias("v"), geometry.crop_status(b, F.lit(10), F.lit(10)).alias("s"))
    assert (round(r.iou, 6), r.v, r.s) == (round(25 / 175, 6), 0.25, "low_visible_ratio")


def test_resolved_windows(spark):
    null = F.lit(None).cast("double")
    w = lambda *x: one(spark, intervals.resolved_window(*(null if v is None else F.lit(float(v)) for v in x)).alias("w")).w
    assert tuple(w(10, 18, 100, None, None, None)) == (10.0, 18.0, "valid")
    assert tuple(w(10, 30, 100, None, None, None)) == (19.0, 30.0, "cap_no_phase")
    assert tuple(w(10, 18, 100, 8, 12, 19)) == (8.0, 19.0, "setup+outcome")
    assert w(99, 120, 100, None, None, None) is None
    assert tuple(w(10, 20, 100, None, None, 13)) == (10.0, 14.5, "outcome_trim")


def test_states(spark):
    b = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "batch_id long, expected long")
    u = spark.createDataFrame([(1, "a", "verified", False), (1, "b", "verified", False), (2, "c", "verified", True)], "batch_id long, upload_id string, state string, cleanup_pending boolean")
    assert dict(rows(states.batch_states(b, u), "batch_id", "state")) == {1: "ready", 2: "uploading", 3: "empty"}
    cur = spark.createDataFrame([("a", "pending", None, "single_put", None), ("b", "superseded", 1, "single_put", None)], "upload_id string, state string, size long, kind string, verified_at string")
    cmd = spark.createDataFrame([("a", 1, 5, "t"), ("a", 2, 6, "t"), ("b", 3, 1, "t"), ("z", 4, 1, "t")], "upload_id string, seq long, size long, at string")
    new, rejects = states.verify_uploads(cur, cmd)
    assert {r.upload_id: (r.state, r.size) for r in new.collect()} == {"a": ("verified", 5), "b": ("superseded", 1)}
    assert rows(rejects, "upload_id", "seq", "reason") == [("a", 2, "superseded_in_batch"), ("b", 3, "superseded"), ("z", 4, "missing")]


def test_ledger_prefers_the_exact_window(spark):
    used = spark.createDataFrame([(1, "v", "jump", 10, 20, 8, 18)], "used_id long, source string, event_type string, start long, end long, original_start long, original_end long")
    up = spark.createDataFrame([(5, "v", "jump", 8, 18, 7, None), (6, "v", "jump", 10, 20, 7, None), (7, "v", "jump", 50, 60, 7, "low")], "candidate_id long, source string, event_type string, start long, end long, score int, discard_cause string")
    got = {r.candidate_id: (r.selected, r.discard_cause) for r in ledger.reconciled(used, up).collect()}
    assert got == {5: (False, "not_in_any_draft"), 6: (True, None), 7: (False, "low")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ordinal long, source string, person string, start double, end double, score int")
    assert greedy.source_window_dedup(none).count() == 0
    assert overlap.overlapping_pairs(none, ["source"], "ordinal").count() == 0
    assert timeline.rides(none, ["source"]).count() == 0


def test_rides_of_different_known_tracks_stay_apart(spark):
    rows_ = [(0, "v", 0.0, 10.0, 5, "a", None), (1, "v", 12.0, 20.0, 6, "b", None), (2, "v", 22.0, 30.0, 7, None, None), (3, "v", 32.0, 40.0, 7, "a", None), (4, "v", 41.0, 50.0, 9, "a", 1.0)]
    df = spark.createDataFrame(rows_, "ordinal long, source string, start double, end double, score int, track string, outcome double")
    got = [(r.start, r.end, r.fragments) for r in timeline.merged_rides(df, ["source"], "track").orderBy("start").collect()]
    assert got == [(0.0, 10.0, 1), (12.0, 50.0, 4)]  # only neighbours are compared: b, unknown, a, a


def test_descriptions_merge_into_the_first_cluster_only(spark):
    clusters = spark.createDataFrame([(1, "red cap"), (2, "red cap"), (3, "red cap"), (4, ""), (5, ""), (6, None), (7, "red cap")], "cluster long, description string")
    members = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (5, 13), (6, 14), (7, 11)], "cluster long, clip long")
    got = {r.cluster: r.merged_into for r in identity.merge_by_description(clusters, members).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}  # 2 shares a clip with 1, 7 with what 1 holds by then


def merged_one_by_one(clusters, clips):
    out, held, first = {}, {}, {}
    for c, said in sorted(clusters):
        f = first.setdefault(said, c)
        free = not held.setdefault(said, set()) & clips.get(c, set())
        held[said] |= clips.get(c, set()) if free else set()
        out[c] = f if free else c
    return out


def test_descriptions_of_many_clusters(spark, monkeypatch):
    """In rounds and by folds as one by one; clusters of the same clips take no part twice, and no fold holds more than the limit."""
    loads, fold = [0], identity.taken_by_fold

    def counted(sets):
        loads.append(sets.groupBy("description").count().agg(F.max("count")).first()[0] or 0)
        return fold(sets)

    monkeypatch.setattr(identity, "taken_by_fold", counted)
    rnd = random.Random(4)
    clusters = [(k, rnd.choice("ab")) for k in range(400)]
    clips = {k: {rnd.randrange(90) for _ in range(rnd.choice([0, 1, 2, 3]))} for k in range(400)}
    clips |= {k: {5, 6} for k in range(100, 200)}
    c, m = spark.createDataFrame(clusters, "cluster long, description string"), spark.createDataFrame([(k, x) for k, v in clips.items() for x in v], "cluster long, clip long")
    for limit in (2000, 20, 1):
        got = {r.cluster: r.merged_into for r in identity.merge_by_description(c, m, limit).collect()}
        assert got == merged_one_by_one(clusters, clips) and max(loads) <= limit
        loads.clear()
    alike = spark.range(100_000).select(F.col("id").alias("cluster"), F.lit("red cap").alias("description"))
    out = identity.merge_by_description(alike, alike.select("cluster", (F.col("cluster") % 3).alias("clip")))
    assert out.where("merged_into = 0").count() == 3 and loads == [3]  # three sets of clips, not 100,000 clusters


def test_slow_runs_hold_both_ends(spark):
    def places(flags):
        df = spark.createDataFrame([("r", k, f) for k, f in enumerate(flags)], "reel string, ordinal long, slow boolean")
        return [r.ordinal for r in sequential.slow_runs_broken(df, "reel").orderBy("place").collect()]

    assert places([True, True, True, False]) == [0, 1, 2, 3]
    assert places([True, True, False, True]) == [0, 2, 1, 3]
    assert places([True, True, True, False, False, True]) == [0, 3, 2, 4, 1, 5]
    assert places([True, True]) == [0, 1] and places([True]) == [0]


def test_scored_parts_count_fades_and_slow_motion(spark):
    rows_ = [("r", k, 0.0, 28.4, 5, True) for k in range(3)]
    df = spark.createDataFrame(rows_, "reel string, ordinal long, start double, end double, score int, slow boolean")
    assert {r.part for r in sequential.scored_parts(df, "reel").collect()} == {0}  # 85.2 less two fades
    assert sorted(r.part for r in sequential.scored_parts(df, "reel", slow="slow").collect()) == [0, 0, 1]  # and 0.15 of the best
    long = df.limit(1).withColumn("end", F.lit(200.0))
    assert [(r.part, r.seconds) for r in sequential.scored_parts(long, "reel").collect()] == [(0, 200.0)]


def test_ledger_takes_second_choices(spark):
    used = spark.createDataFrame([(1, "a", "x", 0.0, 5.0, None, None), (2, "a", "x", 0.0, 5.0, None, None)], "used_id long, source string, event_type string, start double, end double, original_start double, original_end double")
    up = spark.createDataFrame([(11, "a", "x", 0.0, 5.0, 1, None), (12, None, "x", 0.0, 5.0, 1, None)], "candidate_id long, source string, event_type string, start double, end double, score int, discard_cause string")
    got = {r.used_id: (r.candidate_id, r.match) for r in ledger.reconciled(used, up).collect()}
    assert got == {1: (11, "matched"), 2: (12, "matched")}


def test_drafts_of_the_same_windows(spark):
    m = [(1, 0, None, "v", 0.1, 5.0, None, 5, None, None, False), (2, 0, None, "v", 0.0, 5.1, None, 7, 0.5, 2.0, False), (2, 1, None, "v", 0.0, 2.0, None, 9, None, None, True), (3, 0, "f", "v", 0.0, 5.0, None, 5, None, None, False)]
    moments = spark.createDataFrame(m, "draft long, ordinal long, fingerprint string, source string, start double, end double, track string, score int, visible double, confidence double, teaser boolean")
    drafts = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "draft long, ordinal long")
    got = {r.draft: (r.quality, r.kept, r.rival) for r in greedy.draft_fingerprint_dedup(drafts, moments).collect()}
    assert got == {1: (7.0, False, 2), 2: (8.5, True, None), 3: (7.0, True, None), 4: (0.0, True, None)}


def test_a_social_moment_passes_and_a_lost_actor_does_not(spark):
    row = spark.range(1)
    none = F.lit(None)
    reasons = policies.ambiguity_reasons({"target_lost": F.lit(True)}, {}, none.cast("boolean"), none.cast("double"), {}, F.lit("a"), none.cast("boolean"), F.lit("identity switches here"), none.cast("boolean"))
    actor = policies.primary_actor(reasons, F.lit("a"), none.cast("boolean"), F.lit(0.25), F.lit(3), none.cast("boolean"))
    gate = policies.multi_person_gate(actor["decision"], F.array(F.lit("a"), F.lit("b")), none.cast("boolean"), none.cast("array<string>"), F.lit("Celebration"), none.cast("string"))
    r = row.select(actor.alias("a"), gate.alias("g")).first()
    assert (r.a.decision, r.a.defect, r.a.reasons) == ("review_required", "IDENTITY_SWITCH", ["target_lost", "identity_switch_description", "primary_continuity_ratio:0.250"])
    assert (r.g.decision, r.g.social, r.g.visible) == ("allowed_social_moment", True, 2)
