"""The library's queries over the driver's tables, and the SQL that gives the same rows.

Moments and detections stand for the tables that this library is made for: intervals on the time line of a source (the kind of
event), of a person (the user), with a score; and points with a track and a box.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry, intervals, scores, text
from tidemark.operators import greedy, identity, ledger, lookups, overlap, reports, sequential, states, timeline
from tidemark.plans import decisions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MOMENTS = """m as (select event_id as ordinal, event_type as source, user_id as person, cast(floor(epoch(ts)) as bigint) as start,
    cast(floor(epoch(ts)) as bigint) + 120 + cast(floor(value) as bigint) * 37 % 1200 as "end", cast(1 + event_id % 10 as int) as score from events)"""
_DETECTIONS = """d as (select event_id as point_id, event_type as source, cast(floor(epoch(ts)) as bigint) as t, user_id % 20 as track, value as confidence,
    event_id * 37 % 1600 as x1, event_id * 91 % 900 as y1, event_id * 37 % 1600 + 40 + event_id * 13 % 200 as x2, event_id * 91 % 900 + 60 + event_id * 29 % 300 as y2 from events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("ts").cast("timestamp").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ordinal"), F.col("event_type").alias("source"), F.col("user_id").alias("person"), start.alias("start"),
        (start + 120 + F.floor("value") * 37 % 1200).alias("end"), (1 + F.col("event_id") % 10).cast("int").alias("score"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    x, y = e * 37 % 1600, e * 91 % 900
    return table(spark, sf_dir, "events").select(
        e.alias("point_id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").cast("long").alias("t"), (F.col("user_id") % 20).alias("track"), F.col("value").alias("confidence"),
        x.alias("x1"), y.alias("y1"), (x + 40 + e * 13 % 200).alias("x2"), (y + 60 + e * 29 % 300).alias("y2"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every moment as a window in which detections are looked for."""
    return moments(spark, sf_dir).select(F.col("ordinal").alias("window_id"), "source", "start", "end", F.col("person").alias("owner"))


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PAIRS = """p as (select l.source, l.ordinal as l_ordinal, r.ordinal as r_ordinal, least(l."end", r."end") - greatest(l.start, r.start) as seconds,
    least(l."end" - l.start, r."end" - r.start) as shorter
    from m l join m r on l.source = r.source and l.ordinal < r.ordinal and l.person <> r.person and l.start < r."end" and r.start < l."end"),
q as (select * from p where seconds >= 2 and seconds >= 0.5 * shorter)"""


@query(f"with {_MOMENTS}, {_PAIRS} select source, l_ordinal, r_ordinal, seconds as overlap_seconds from q")
def q01_pairwise_overlap(spark, d):
    pairs = overlap.overlapping_pairs(moments(spark, d), ["source"], "ordinal", differ="person")
    return pairs.select(F.col("l_source").alias("source"), "l_ordinal", "r_ordinal", "overlap_seconds")


@query(f"with {_MOMENTS} select l.source, count(*) as possible_pairs from m l join m r on l.source = r.source and l.ordinal < r.ordinal and l.person <> r.person group by 1")
def q02_possible_pairs(spark, d):
    return overlap.possible_pairs(moments(spark, d), ["source"], "person")


@query(f"""with {_MOMENTS}, {_PAIRS}, c as (select source, count(*) as n from m group by 1), o as (select source, sum(k * k) as own from (select source, person, count(*) as k from m group by 1, 2) group by 1),
    x as (select source, count(*) as pairs, cast(sum(seconds) as bigint) as seconds from q group by 1)
    select c.source, cast((n * n - own) // 2 as bigint) as possible_pairs, coalesce(pairs, 0) as pairs, coalesce(seconds, 0) as seconds from c join o using (source) left join x using (source)""")
def q03_overlap_rate(spark, d):
    return decisions.window_report(moments(spark, d), ["source"], "person", "ordinal").drop("rate")


_WINDOWS = """w as (select ordinal as window_id, source, start, "end", person as owner from m),
h as (select w.window_id, w.owner, d.* from w join d on w.source = d.source and d.t between w.start and w."end")"""


@query(f"""with {_MOMENTS}, {_DETECTIONS}, {_WINDOWS}, k as (select window_id, track, count(*) as n from h group by 1, 2),
    s as (select window_id, cast(sum(n) as bigint) as hits, count(*) as tracks, max(n) as dominant from k group by 1) select * from s where hits >= 4 and tracks >= 2 and dominant <= hits * 0.7""")
def q04_mixed_subject_windows(spark, d):
    hits = overlap.points_in_intervals(detections(spark, d), windows(spark, d), ["source"])
    return reports.mixed_windows(hits, "window_id", "track")


@query(f"with {_MOMENTS}, {_DETECTIONS}, {_WINDOWS} select window_id, point_id, t, track from h")
def q05_detections_in_window(spark, d):
    return overlap.points_in_intervals(detections(spark, d), windows(spark, d), ["source"]).select("window_id", "point_id", "t", "track")


@query(f"""with {_MOMENTS}, {_DETECTIONS}, {_WINDOWS} select window_id, point_id, track from (select h.*, row_number() over (partition by window_id order by confidence desc, abs(2 * t - (w.start + w."end")), point_id) as r
    from h join w using (window_id)) where r = 1""")
def q06_best_primary(spark, d):
    hits = overlap.points_in_intervals(detections(spark, d), windows(spark, d), ["source"])
    return overlap.best_in_window(hits, ["window_id"], "confidence", "t", (F.col("start") + F.col("end")) / 2, "point_id").select("window_id", "point_id", "track")


@query(f"""with {_MOMENTS}, {_DETECTIONS}, {_WINDOWS} select window_id, point_id, distance from (select w.window_id, d.point_id, abs(d.t - w."end") as distance,
    row_number() over (partition by w.window_id order by abs(d.t - w."end"), d.point_id) as r from w join d on w.source = d.source and abs(d.t - w."end") <= 300) where r = 1""")
def q07_nearest_within(spark, d):
    targets = windows(spark, d).select("window_id", "source", F.col("end").alias("at"))
    return overlap.nearest_point(detections(spark, d), targets, ["source"], "window_id", within=300).select("window_id", "point_id", "distance")


@query(f"""with {_MOMENTS}, {_DETECTIONS}, {_WINDOWS}, a as (select window_id, count(*) as points, string_agg(distinct track, ',' order by track) as tracks from h group by 1)
    select w.window_id, coalesce(points, 0) as points, coalesce(tracks, '') as tracks from w left join a using (window_id)""")
def q08_enrich_window(spark, d):
    out = overlap.enriched(windows(spark, d), detections(spark, d), ["source"], "window_id", "track")
    return out.select("window_id", "points", F.array_join(F.col("tracks").cast("array<string>"), ",").alias("tracks"))


@query(f"""with {_MOMENTS}, {_DETECTIONS}, {_WINDOWS}, f as (select window_id, t // 600 as frame, count(distinct track) as n, bool_or(track = owner % 20) as own from h group by 1, 2)
    select window_id, count(*) as frames, count(*) filter (n > 1) as concurrent_frames, max(n) as most_at_once, count(*) filter (own) as primary_frames from f group by 1""")
def q09_frame_concurrency(spark, d):
    hits = overlap.points_in_intervals(detections(spark, d), windows(spark, d), ["source"]).withColumn("frame", F.floor(F.col("t") / 600)).withColumn("primary", F.col("owner") % 20)
    return reports.frame_concurrency(hits, "window_id", "frame", "track", "primary")


@query(f"""with {_DETECTIONS}, k as (select source, track, max(t) - min(t) as seconds from d group by 1, 2)
    select source, count(*) as tracks, count(*) filter (seconds < 2400000) as short_tracks, count(*) >= 10 and count(*) filter (seconds < 2400000) >= 0.5 * count(*) as fragmented from k group by 1""")
def q10_track_fragmentation(spark, d):
    return reports.fragmentation(detections(spark, d), "source", "track", short=2_400_000)


_FOLD = """list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda y: {meets})) > 0 then acc else list_concat(acc, x) end)"""
_SHORT = """(select ordinal, source, person, start, start + 30 + cast(score as bigint) * 17 % 200 as "end", score from m)"""


def short_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of up to some minutes."""
    return moments(spark, sf_dir).withColumn("end", F.col("start") + 30 + F.col("score").cast("long") * 17 % 200)


@query(f"""with {_MOMENTS}, s as {_SHORT}, g as (select source, list({{'p': -score, 'l': start - "end", 'o': ordinal, 's': start, 'e': "end"}} order by -score, start - "end", ordinal) as rows from s group by 1),
    k as (select source, {_FOLD.format(meets='least(x[1].e, y.e) - greatest(x[1].s, y.s) >= 2 and 2 * (least(x[1].e, y.e) - greatest(x[1].s, y.s)) >= least(x[1].e - x[1].s, y.e - y.s)')} as kept from g),
    f as (select unnest(kept, recursive := true) from k)
    select s.ordinal, f.o is not null as kept from s left join f on s.ordinal = f.o""")
def q11_source_window_dedup(spark, d):
    return greedy.source_window_dedup(short_moments(spark, d)).select("ordinal", "kept")


@query(f"""with {_MOMENTS}, s as {_SHORT}, e as (select *, "end" - start >= 60 as fit from s),
    r as (select *, max(score) filter (fit) over (partition by person) as best, row_number() over (partition by person order by fit desc, score desc, ordinal) as place from e),
    j as (select *, coalesce(fit and (score >= 6 or (best >= 5 and best < 6 and place <= 2)), false) as good from r),
    g as (select person, list({{'o': ordinal, 's': start}} order by -score, ordinal) as rows from j where good group by 1),
    k as (select {_FOLD.format(meets='abs(x[1].s - y.s) < 20000')} as kept from g), f as (select unnest(kept, recursive := true) from k)
    select j.ordinal, f.o is not null as selected, case when not fit then 'fragment_shorter_than_min_event_sec' when not good then 'score_below_selection_threshold' when f.o is null then 'dedup_overlap_lower_score' end as discard_cause
    from j left join f on j.ordinal = f.o""")
def q12_selector_candidates(spark, d):
    return greedy.selector_candidates(short_moments(spark, d), ["person"], least_seconds=60, within=20000).select("ordinal", "selected", "discard_cause")


@query(f"""with {_MOMENTS}, s as (select *, case when ordinal % 7 > 0 then person * 1000 + start // 86400 end as fp from m),
    w as (select *, fp is not null and count(distinct source) over (partition by fp) > 1 as several, count(*) over (partition by fp) as n, row_number() over (partition by fp order by score desc, ordinal) as r from s)
    select ordinal, case when several then n else 1 end as group_rows, not several or r = 1 as kept from w""")
def q13_fingerprint_dedup(spark, d):
    m = moments(spark, d).withColumn("fp", F.when(F.col("ordinal") % 7 > 0, F.col("person") * 1000 + F.floor(F.col("start") / 86400)))
    return greedy.fingerprint_dedup(m, "fp", "source", F.col("score"), "ordinal").select("ordinal", F.col("group_rows").cast("long").alias("group_rows"), "kept")


@query("""with s as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) select o_custkey, o_orderkey, o_totalprice from s where r = 1""")
def q14_latest_per_key(spark, d):
    return timeline.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""select doc_id, first_value(doc_id) over (partition by sha256(text) order by doc_id desc) as canonical, doc_id <> first_value(doc_id) over (partition by sha256(text) order by doc_id desc) as superseded from documents""")
def q15_canonical_uploads(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return timeline.canonical_uploads(docs, "digest", [F.desc("doc_id")], "doc_id").select("doc_id", "canonical", "superseded")


@query(f"""with {_MOMENTS}, t as (select *, case when ordinal % 5 > 0 then person % 3 end as track from m),
    f as (select *, case when start <= lag("end") over o + 600 and coalesce(track = lag(track) over o, true) then 0 else 1 end as fresh from t window o as (partition by source order by start, ordinal)),
    r as (select *, sum(fresh) over (partition by source order by start, ordinal) as ride from f)
    select source, cast(ride as bigint) as ride, min(start) as start, max("end") as "end", count(*) as fragments, max(score) as score, arg_min(ordinal, -score * 100000000 + ordinal) as peak_ordinal, count(distinct track) as tracks from r group by 1, 2""")
def q16_gap_merge(spark, d):
    m = moments(spark, d).withColumn("outcome", F.lit(None).cast("long")).withColumn("track", F.when(F.col("ordinal") % 5 > 0, F.col("person") % 3))
    return timeline.merged_rides(m, ["source"], "track", 600).select("source", "ride", "start", "end", "fragments", "score", "peak_ordinal", F.size("tracks").cast("long").alias("tracks"))


@query(f"""with {_MOMENTS}, {_DETECTIONS}, w as (select ordinal as window_id, source, start, "end", ordinal % 3 as owner from m),
    d3 as (select *, track % 3 as k from d), h as (select w.*, d3.t, d3.k = w.owner as own from w join d3 on w.source = d3.source and d3.t between w.start and w."end" where w."end" - w.start >= 60),
    b as (select window_id, greatest(start, coalesce(max(t + 20) over (partition by window_id order by t rows between unbounded preceding and 1 preceding), start)) as low, t - 20 as high from h where not own),
    a as (select window_id, greatest(max(start), coalesce(max(t + 20) filter (not own), max(start))) as low, max("end") as high from h group by 1),
    f as (select * from b union all select * from a), g as (select * from f where high - low >= 60),
    c as (select g.window_id, low, high, min(t) as first, max(t) as last, count(*) as n, list(t) as ts from g join h on g.window_id = h.window_id and h.own and h.t between low and high group by 1, 2, 3),
    x as (select *, greatest(low, first - 200) as s, least(least(high, last + 200), greatest(low, first - 200) + 900) as e from c where n >= 1),
    y as (select *, len(list_filter(ts, lambda t: t between s and e)) as hits, row_number() over (partition by window_id order by e - s desc, len(list_filter(ts, lambda t: t between s and e)) desc, s) as r from x where e - s >= 60)
    select window_id, s as start, e as "end", cast(hits as int) as hits from y where r = 1""")
def q17_clean_subwindow(spark, d):
    w = moments(spark, d).select(F.col("ordinal").alias("window_id"), "source", "start", "end", (F.col("ordinal") % 3).alias("primary"))
    points = detections(spark, d).select("source", "t", (F.col("track") % 3).alias("track"))
    return timeline.clean_subwindows(w, points, ["source"], "window_id", "primary", 60, 900, 20, 200, 1)


@query("""with x as (select event_id, value, event_id % 60 / 100.0 + event_id % 30 as v from events)
    select event_id, case when floor(v + 1e-9) >= 0 and round((v - floor(v + 1e-9)) * 100) < 60 then cast(floor(v + 1e-9) * 60 + round((v - floor(v + 1e-9)) * 100) as bigint) end as seconds from x""")
def q18_minute_second(spark, d):
    v = (F.col("event_id") % 60) / 100.0 + F.col("event_id") % 30
    return table(spark, d, "events").select("event_id", intervals.minute_second(v).cast("long").alias("seconds"))


@query("""with e as (select event_type as source, cast(max(epoch(ts)) - min(epoch(ts)) as bigint) as seconds from events group by 1)
    select source, unnest(range(0, cast(ceil(seconds / 86400.0) as bigint))) as chunk_index, seconds from e""")
def q19_chunk_specs(spark, d):
    at = F.col("ts").cast("timestamp").cast("double")
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.rint(F.max(at) - F.min(at)).cast("long").alias("seconds"))
    specs = timeline.chunk_specs(e, "source", "seconds", 86400.0)
    return specs.join(e, "source").select("source", "chunk_index", "seconds")


@query(f"""with {_MOMENTS} select ordinal, cast(coalesce(sum(("end" - start) * 4 - 1) over (partition by source, person order by ordinal rows between unbounded preceding and 1 preceding), 0) as bigint) as quarter_start from m""")
def q20_rendered_timeline(spark, d):
    out = timeline.rendered_timeline(moments(spark, d).withColumn("reel", F.struct("source", "person")), "reel", 0.25)
    return out.select("ordinal", (F.col("rendered_start") * 4).cast("long").alias("quarter_start"))


@query(f"""with {_MOMENTS}, r as (select ordinal, row_number() over (partition by source, person order by score desc, ordinal) as k, count(*) over (partition by source, person) as n from m)
    select ordinal, cast(case when k = 1 then n when k = 2 then 1 else n - k + 2 end as int) as place from r""")
def q21_narrative_order(spark, d):
    return timeline.narrative_order(moments(spark, d).withColumn("reel", F.struct("source", "person")), "reel").select("ordinal", "place")


_LABELS = {"the": ["the "], "passion": ["passion", "mit license"], "rights": ["rights reserved"], "apache": ["apache"]}


@query("""select doc_id, concat_ws(',', case when contains(lower(text), 'the ') then 'the' end, case when contains(lower(text), 'passion') or contains(lower(text), 'mit license') then 'passion' end,
    case when contains(lower(text), 'rights reserved') then 'rights' end, case when contains(lower(text), 'apache') then 'apache' end) as labels from documents""")
def q22_value_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.labels(F.col("text"), _LABELS), ",").alias("labels"))


@query("""with t as (select item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) >= 3 and not list_contains(['and', 'the', 'with', 'for', 'from', 'player', 'athlete', 'person', 'surfer', 'wearing'], x)))) as w from benchmark),
    p as (select a.item_id as draft_id, b.item_id as candidate_id, len(list_intersect(a.w, b.w)) as n, len(a.w) as x, len(b.w) as y from t a, t b),
    s as (select *, n / (x + y - n) as similarity from p where n > 0), r as (select *, row_number() over (partition by draft_id order by similarity desc, candidate_id) as rank from s where similarity >= 0.05)
    select draft_id, candidate_id, similarity, cast(rank as int) as rank from r where rank <= 10""")
def q23_related_topk(spark, d):
    t = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("tokens"))
    return ledger.related(t.withColumnRenamed("item_id", "draft_id"), t.withColumnRenamed("item_id", "candidate_id"), 0.05)


@query("""select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all('bib ' || (event_id % 90) || ' and #' || (user_id % 40), '#\\s*([0-9]{1,3})', 1) || regexp_extract_all('bib ' || (event_id % 90) || ' and #' || (user_id % 40), '\\b(?:bib|player|jersey|number|no)\\s*#?\\s*([0-9]{1,3})\\b', 1))), ',') as numbers from events""".replace("\\\\", "\\"))
def q24_number_extract(spark, d):
    said = F.concat(F.lit("Bib "), (F.col("event_id") % 90).cast("string"), F.lit(" and #"), (F.col("user_id") % 40).cast("string"))
    return table(spark, d, "events").select("event_id", F.array_join(text.numbers(said), ",").alias("numbers"))


@query(f"""with {_DETECTIONS} select point_id, cast(greatest(0, least(x2, 1280) - x1) * greatest(0, least(y2, 720) - y1) as bigint) as inside, (x2 - x1) * (y2 - y1) as area,
    case when greatest(0, least(x2, 1280) - x1) * greatest(0, least(y2, 720) - y1) / ((x2 - x1) * (y2 - y1)) < 0.35 then 'low_visible_ratio' else 'ok' end as status from d""")
def q25_bbox_metrics(spark, d):
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    frame = (F.lit(0), F.lit(0), F.lit(1280), F.lit(720))
    return detections(spark, d).select("point_id", geometry.intersection(box, frame).cast("long").alias("inside"), geometry.area(box).alias("area"), geometry.crop_status(box, F.lit(1280), F.lit(720)).alias("status"))


@query(f"""with {_DETECTIONS}, p as (select a.point_id as a_id, b.point_id as b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as both_ from d a join d b on a.source = b.source and a.t // 1800 = b.t // 1800 and a.point_id < b.point_id)
    select a_id, b_id, cast(inter as bigint) as inter, cast(both_ - inter as bigint) as union_area from p where inter > 0""")
def q26_iou_pairs(spark, d):
    x = detections(spark, d).withColumn("slot", F.floor(F.col("t") / 1800))
    a, b = (x.select(*(F.col(c).alias(f"{p}_{c}") for c in x.columns)) for p in "ab")
    pairs = a.join(b, (F.col("a_source") == F.col("b_source")) & (F.col("a_slot") == F.col("b_slot")) & (F.col("a_point_id") < F.col("b_point_id")))
    box = lambda p: tuple(F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2"))
    both = geometry.intersection(box("a"), box("b"))
    return pairs.where(both > 0).select(F.col("a_point_id").alias("a_id"), F.col("b_point_id").alias("b_id"), both.cast("long").alias("inter"), (geometry.area(box("a")) + geometry.area(box("b")) - both).cast("long").alias("union_area"))


@query(f"""with {_MOMENTS} select l.ordinal as left_id, r.ordinal as right_id from m l join m r on l.source = r.source and abs(l.start - r.start) <= 120 and abs(l."end" - r."end") <= 120
    and (l.score % 3 = r.score % 3 or l.score % 3 = 0 or r.score % 3 = 0) where l.person % 5 = 0 and r.person % 5 <> 0""")
def q27_band_match(spark, d):
    kind = F.when(F.col("score") % 3 > 0, (F.col("score") % 3).cast("string"))
    m = moments(spark, d).select(F.col("ordinal").alias("id"), "source", "start", "end", kind.alias("event_type"), "person")
    return ledger.band_matches(m.where("person % 5 = 0"), m.where("person % 5 <> 0"), 120)  # the two sides: a fifth of the persons, and all others


_UNIT = """u as (select vec_id, vec_id % 10 as clip, list_transform(embedding, lambda x: cast(round(x * 1000) as bigint)) as v from embeddings)"""


@query(f"""with {_UNIT}, p as (select a.vec_id, b.vec_id as other, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) as s from u a join u b on a.clip <> b.clip),
    r as (select vec_id, other, row_number() over (partition by vec_id order by s desc, other) as rank from p) select vec_id, other, cast(rank as int) as rank from r where rank <= 2""")
def q28_knn_top2(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("clip"), F.lit(0).alias("block"), F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000)).alias("v"))
    return identity.best_two(e, "block", "clip", "v", "vec_id").select("vec_id", "other", "rank")


@query("""with recursive e as (select distinct o_custkey % 400 as a, o_orderkey % 397 + 1000 as b from orders),
    n as (select a, b from e union select b, a from e), r as (select a as node, a as reach from n union select r.node, n.b from r join n on r.reach = n.a) select node, min(reach) as comp from r group by 1""")
def q29_components(spark, d):
    shared_checkpoints(spark)
    edges = table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("a"), (F.col("o_orderkey") % 397 + 1000).alias("b")).distinct()
    return identity.connected(edges)


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir. Without one, and without any set, a cluster's session gets a ValueError, a
    local one, which is one process, a new temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


@query("""with c as (select l_orderkey as cluster, l_linenumber % 3 as clip, l_suppkey % 4 as n from lineitem), x as (select cluster, count(*) > count(distinct clip) as same_clip, count(distinct case when n > 0 then n end) > 1 as numbers from c group by 1)
    select cluster, same_clip, numbers from x""")
def q30_conflicts(spark, d):
    n = F.col("l_suppkey") % 4
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), (F.col("l_linenumber") % 3).alias("clip"), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<long>")).alias("numbers"))
    return identity.conflicts(m, "cluster", "clip", "numbers")


@query("""with p as (select l_orderkey as cluster, l_linenumber as app, count(distinct case when l_suppkey % 5 > 0 then l_partkey % 2 end) as n, max(case when l_suppkey % 5 > 0 then l_partkey % 2 end) as t from lineitem group by 1, 2),
    a as (select cluster, count(*) as appearances, bool_and(n = 1) as one, bool_or(n = 0) as none, count(distinct t) as tracks from p group by 1)
    select cluster, appearances, case when appearances = 1 then 'unchanged' when none then 'missing_track_evidence' when one and tracks = 1 then 'pass' else 'conflicting_track_ids' end as status from a""")
def q31_identity_gate(spark, d):
    t = table(spark, d, "lineitem").withColumn("track", F.when(F.col("l_suppkey") % 5 > 0, F.col("l_partkey") % 2))
    return identity.identity_gate(t.withColumnRenamed("l_orderkey", "cluster"), "cluster", "l_linenumber", "track")


@query("""select o_orderkey, case when o_custkey % 3 > 0 then 'ath_' || substr(sha1('strong:' || o_custkey), 1, 10) else 'ath_' || substr(sha1('weak:' || o_orderkey), 1, 10) end as athlete_id,
    case when o_custkey % 3 > 0 then 'merged_same_athlete' else 'weak_identity' end as "match" from orders""")
def q32_canonical_ids(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).alias("strong"))
    return identity.canonical_ids(o, "o_orderkey", "strong").select("o_orderkey", "athlete_id", "match")


_LEDGER = """b as (select *, cast(score % 4 as varchar) as event_type, start // 3600 * 3600 as h from m),
used as (select ordinal as used_id, case when ordinal % 6 > 0 then source end as source, event_type, h as start, h + 3600 as "end", h - 5 as os, h + 3595 as oe from b),
up as (select ordinal as candidate_id, source, event_type, case when ordinal % 2 = 0 then h else h - 5 end as start, case when ordinal % 2 = 0 then h + 3600 else h + 3595 end as "end", score, case when ordinal % 4 = 1 then 'low' end as discard_cause from b where score > 2)"""


@query(f"""with {_MOMENTS}, {_LEDGER}, k as (select used_id, source, event_type, 0 as tier, start, "end", start as h from used union all select used_id, source, event_type, 1, os, oe, start from used),
    e as (select used_id, candidate_id, event_type, h, min(tier * 2 + case when k.source = up.source then 0 else 1 end) as how from k join up using (event_type, start, "end") where k.source is null or k.source = up.source group by 1, 2, 3, 4),
    g as (select list({{'u': [used_id], 'c': [candidate_id]}} order by how, used_id, candidate_id) as rows from e group by event_type, h),
    f as (select list_reduce(rows, lambda acc, x: case when list_contains(acc.u, x.u[1]) or list_contains(acc.c, x.c[1]) then acc else {{'u': list_concat(acc.u, x.u), 'c': list_concat(acc.c, x.c)}} end) as t from g),
    best as (select unnest(t.u) as used_id, unnest(t.c) as candidate_id from f)
    select up.candidate_id, u.used_id, u.used_id is not null as selected, case when u.used_id is null then coalesce(discard_cause, 'not_in_any_draft') end as discard_cause,
    case when up.candidate_id is null then 'window_only' when u.used_id is not null then 'matched' else 'candidate_only' end as "match"
    from (select used.used_id, best.candidate_id from used left join best using (used_id)) u full outer join up on u.candidate_id = up.candidate_id""")
def q33_ledger_reconcile(spark, d):
    shared_checkpoints(spark)
    hour = F.floor(F.col("start") / 3600) * 3600
    m = moments(spark, d).withColumn("event_type", (F.col("score") % 4).cast("string")).withColumn("start", hour).withColumn("end", F.col("start") + 3600)
    o = F.col("ordinal")
    used = m.select(o.alias("used_id"), F.when(o % 6 > 0, F.col("source")).alias("source"), "event_type", "start", "end", (F.col("start") - 5).alias("original_start"), (F.col("end") - 5).alias("original_end"))
    shift = F.when(o % 2 == 0, 0).otherwise(5)
    upstream = m.where("score > 2").select(o.alias("candidate_id"), "source", "event_type", (F.col("start") - shift).alias("start"), (F.col("end") - shift).alias("end"), "score", F.when(o % 4 == 1, "low").alias("discard_cause"))
    return ledger.reconciled(used, upstream).select("candidate_id", "used_id", "selected", "discard_cause", "match")


_CANDIDATES = """c as (select ordinal, person as cluster, start, "end", score >= 8 as selected, case when score between 3 and 7 then 'cause_' || score % 3 end as discard_cause from m)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    cause = F.when(s.between(3, 7), F.concat(F.lit("cause_"), (s % 3).cast("string")))
    return moments(spark, sf_dir).select("ordinal", F.col("person").alias("cluster"), "start", "end", (s >= 8).alias("selected"), cause.alias("discard_cause"))


_COVERAGE = """b as (select cluster, count(*) as candidates, count(*) filter (selected) as selected, cast(sum("end" - start) as bigint) as candidate_seconds, cast(coalesce(sum("end" - start) filter (selected), 0) as bigint) as selected_seconds from c group by 1),
r as (select cluster, discard_cause, row_number() over (partition by cluster order by count(*) desc, min(ordinal)) as k from c where discard_cause is not null group by 1, 2),
v as (select b.*, case when selected > 0 then 'selected_for_render' else coalesce(r.discard_cause, 'unresolved_selection_path') end as outcome from b left join r on b.cluster = r.cluster and r.k = 1)"""


@query(f"with {_MOMENTS}, {_CANDIDATES}, {_COVERAGE} select * from v")
def q34_coverage_by_cluster(spark, d):
    return reports.coverage(candidates(spark, d), "cluster").select("cluster", "candidates", "selected", "candidate_seconds", "selected_seconds", "outcome")


@query(f"""with {_MOMENTS}, {_CANDIDATES}, {_COVERAGE} select count(*) as clusters, count(*) filter (selected > 0) as represented, count(*) filter (outcome <> 'unresolved_selection_path') as accounted,
    count(*) filter (outcome = 'unresolved_selection_path') as gaps, cast(sum(candidate_seconds) as bigint) as candidate_seconds, cast(sum(selected_seconds) as bigint) as selected_seconds from v""")
def q35_coverage_totals(spark, d):
    return reports.coverage_totals(reports.coverage(candidates(spark, d), "cluster"))


@query("""with s as (select l_suppkey as athlete, l_orderkey % 50 as draft, list_sort(list_distinct(list(l_linenumber))) as sources from lineitem group by 1, 2)
    select cast(athlete as varchar) as athlete, count(distinct sources) as source_sets, array_to_string(list_sort(list(draft)), ',') as drafts from s group by 1 having count(distinct sources) > 1""")
def q36_duplicate_athletes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("athlete"), (F.col("l_orderkey") % 50).alias("draft"), "l_linenumber")
    return reports.duplicate_athletes(rows, "athlete", "draft", "l_linenumber").withColumn("drafts", F.array_join(F.col("drafts").cast("array<string>"), ","))


_LIMITS = [("errors", 60.0, "hard_block"), ("clicks", 90.0, "inconclusive"), ("late", 1.0, "hard_block")]
_METRICS = """x as (select user_id as run, cast(count(*) filter (event_type = 'error') as double) as errors, cast(count(*) filter (event_type = 'click') as double) as clicks, cast(case when user_id % 9 = 0 then null else 0 end as double) as late from events group by 1),
a as (select run, case when errors > 60 then 2 else 0 end as e, case when clicks > 90 then 1 else 0 end as c, case when late is null then 1 when late > 1 then 2 else 0 end as l from x)"""


@query(f"""with {_METRICS} select run, cast((e > 0)::int + (c > 0)::int + (l > 0)::int as bigint) as alerts, case greatest(e, c, l) when 2 then 'hard_block' when 1 then 'inconclusive' else 'pass' end as status from a""")
def q37_alerts_status(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count_if(F.col("event_type") == "error").cast("double").alias("errors"), F.count_if(F.col("event_type") == "click").cast("double").alias("clicks"))
    return decisions.run_status(e.withColumn("late", F.when(F.col("run") % 9 > 0, F.lit(0.0))), "run", _LIMITS)


@query("""with p as (select l_orderkey as athlete, l_linenumber as part_index, 'f' || (l_partkey % 700) as file_name, l_quantity * 2 as seconds, 1000 + l_suppkey % 400 as height, l_returnflag <> 'R' as qa_passed, l_linestatus = 'O' as qa_recorded,
        l_quantity > 40 as has_audio, l_discount < 0.09 as published from lineitem),
    g as (select *, row_number() over (partition by athlete order by part_index) as want from p), c as (select athlete, count(*) as n from p group by 1), x as (select o_orderkey as athlete, 4 as expected from orders)
    select athlete, 'part_order' as rule, cast(part_index as varchar) as detail from g where part_index <> want
    union all select min(athlete), 'file_name_repeated', file_name from p group by file_name having count(*) > 1
    union all select coalesce(x.athlete, c.athlete), 'part_count', coalesce(n, 0) || '/' || coalesce(expected, 0) from x full outer join c on x.athlete = c.athlete where n is distinct from expected
    union all select athlete, 'too_long', file_name from p where seconds > 90 union all select athlete, 'qa_not_recorded', file_name from p where published and not qa_recorded
    union all select athlete, 'qa_not_passed', file_name from p where published and not qa_passed union all select athlete, 'audio', file_name from p where has_audio union all select athlete, 'height', file_name from p where height < 1280""")
def q38_manifest_violations(spark, d):
    p = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as athlete", "l_linenumber as part_index", "concat('f', l_partkey % 700) as file_name", "l_quantity * 2 as seconds", "1000 + l_suppkey % 400 as height", "l_returnflag <> 'R' as qa_passed",
        "l_linestatus = 'O' as qa_recorded", "l_quantity > 40 as has_audio", "l_discount < 0.09 as published",
    )
    expected = table(spark, d, "orders").selectExpr("o_orderkey as athlete", "4L as expected_parts")
    return reports.manifest_violations(p, expected)


@query("""with x as (select user_id, event_type, case when cast(floor(value) as bigint) % 2 = 0 then 1.0 else 0.5 end as w from events), s as (select user_id % 10 as sport, event_type as label, sum(w) as weight, count(*) as n from x group by 1, 2)
    select sport, label, cast(weight * 2 as bigint) as half_weight, n as "rows", cast(rank as int) as rank from (select *, row_number() over (partition by sport order by weight desc, label) as rank from s where n >= 3) where rank <= 3""")
def q39_decayed_labels(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("sport"), F.col("event_type").alias("label"), (F.floor("value") % 2 * 30).cast("double").alias("days"))
    out = reports.decayed_labels(e, ["sport"], "label", F.col("days"), k=3)
    return out.select("sport", "label", F.rint(F.col("weight") * 2).cast("long").alias("half_weight"), "rows", "rank")


@query("""with r as (select l_suppkey % 20 as sport, l_extendedprice as v, row_number() over (partition by l_suppkey % 20 order by l_extendedprice) as r, count(*) over (partition by l_suppkey % 20) as n from lineitem) select sport, v as suggested, n from r where r = greatest(1, floor(n * 0.25))""")
def q40_threshold_suggestion(spark, d):
    return reports.indexed_percentile(table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("sport"), "l_extendedprice"), ["sport"], "l_extendedprice", 0.25)


@query("""select user_id % 7 as sport, count(*) as approvals, median(cast(floor(value) as bigint)) as middle from events where event_type = 'purchase' group by 1""")
def q41_median_calibration(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("sport"), (F.col("event_type") == "purchase").alias("approved"), F.floor("value").alias("engagement"))
    return reports.calibration(e, ["sport"], "approved", "engagement")


@query("""select event_type, cast(coalesce(sum(v) filter (d = date '2024-01-20'), 0) as bigint) as today, cast(coalesce(sum(v) filter (d <= date '2024-01-20' and d > date '2024-01-13'), 0) as bigint) as last_7_days,
    cast(coalesce(sum(v) filter (date_trunc('month', d) = date '2024-01-01' and d <= date '2024-01-20'), 0) as bigint) as month, count(*) as "rows" from (select event_type, cast(ts as date) as d, cast(floor(value) as bigint) as v from events) group by 1""")
def q42_revenue_summary(spark, d):
    return reports.revenue(table(spark, d, "events").withColumn("v", F.floor("value")), ["event_type"], "ts", "v", "2024-01-20")


@query("""with p as (select user_id, bool_or(event_type = 'view') as a, bool_or(event_type = 'click') as b, bool_or(event_type = 'purchase') as c from events group by 1)
    select 'view' as step, count(*) filter (a) as users from p union all select 'click', count(*) filter (a and b) from p union all select 'purchase', count(*) filter (a and b and c) from p""")
def q43_funnel(spark, d):
    return reports.funnel(table(spark, d, "events"), "user_id", "event_type", ["view", "click", "purchase"])


@query("""select p_partkey, case p_brand when 'Brand#11' then 3100 when 'Brand#22' then 4200 else 2500 end as price from part""")
def q44_price_fallback(spark, d):
    prices = spark.createDataFrame([("Brand#11", 3100), ("Brand#22", 4200), ("default", 2500)], "kind string, price int")
    return ledger.price(table(spark, d, "part").select("p_partkey", "p_brand"), prices, "p_brand").select("p_partkey", "price")


@query("""select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 50 offset 100""")
def q45_page(spark, d):
    return timeline.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 100)[0].select("o_orderkey", "o_custkey")


@query("""select user_id, max(ts) as latest, epoch(timestamp '2024-01-31')::bigint - cast(floor(epoch(max(ts))) as bigint) as age, epoch(timestamp '2024-01-31')::bigint - cast(floor(epoch(max(ts))) as bigint) > 86400 as stale from events group by 1""")
def q46_stale_status(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = states.stale(e, ["user_id"], "at", F.lit("2024-01-31").cast("timestamp"), 86400)
    return out.select("user_id", F.col("latest").cast("timestamp_ntz").alias("latest"), "age", "stale")


_BATCH = """u as (select l_orderkey as batch_id, case when l_returnflag = 'R' and l_linenumber = 7 then 'failed' when l_linestatus = 'O' or l_quantity > 25 then 'verified' else 'pending' end as state, l_discount > 0.09 as cleanup, l_linenumber as n from lineitem),
p as (select batch_id, count(*) as actual, count(*) filter (state = 'verified') as verified, count(*) filter (state = 'failed') as failed, count(*) filter (cleanup) as cleanup_pending from u group by 1)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as batch_id", "concat(l_orderkey, '-', l_linenumber) as upload_id", "case when l_returnflag = 'R' and l_linenumber = 7 then 'failed' when l_linestatus = 'O' or l_quantity > 25 then 'verified' else 'pending' end as state",
        "l_discount > 0.09 as cleanup_pending", "cast(l_quantity as long) as size",
    )


@query(f"""with {_BATCH}, b as (select o_orderkey as batch_id, o_orderkey % 3 + 1 as expected from orders), j as (select b.*, coalesce(actual, 0) as actual, coalesce(verified, 0) as verified, coalesce(failed, 0) as failed, coalesce(cleanup_pending, 0) as cleanup_pending from b left join p using (batch_id))
    select *, case when failed > 0 then 'failed' when actual = expected and verified = expected and cleanup_pending = 0 then 'ready' when actual = 0 then 'empty' else 'uploading' end as state from j""")
def q47_batch_state(spark, d):
    b = table(spark, d, "orders").selectExpr("o_orderkey as batch_id", "o_orderkey % 3 + 1 as expected")
    return states.batch_states(b, uploads(spark, d)).drop("manifest")


@query("""with u as (select o_orderkey as upload_id, case when o_orderstatus = 'F' then 'superseded' else 'pending' end as state, case when o_orderkey % 5 > 0 then o_orderkey % 100 end as size, case when o_orderkey % 2 = 0 then 'single_put' else 'multipart' end as kind from orders),
    c as (select o_orderkey as upload_id, o_orderkey % 100 + case when o_orderkey % 7 = 0 then 1 else 0 end as size from orders where o_orderpriority <> '5-LOW'),
    j as (select u.*, c.size as got, c.upload_id is not null as asked, coalesce(u.size, case when kind = 'single_put' then c.size end) as use from u left join c using (upload_id))
    select upload_id, case when asked and state <> 'superseded' and coalesce(use = got, false) then 'verified' else state end as state, case when asked and state <> 'superseded' and coalesce(use = got, false) then use else size end as size from j""")
def q48_verify_upload(spark, d):
    o = table(spark, d, "orders")
    u = o.selectExpr("o_orderkey as upload_id", "case when o_orderstatus = 'F' then 'superseded' else 'pending' end as state", "case when o_orderkey % 5 > 0 then o_orderkey % 100 end as size", "case when o_orderkey % 2 = 0 then 'single_put' else 'multipart' end as kind", "cast(null as timestamp) as verified_at")
    c = o.where("o_orderpriority <> '5-LOW'").selectExpr("o_orderkey as upload_id", "o_orderkey as seq", "o_orderkey % 100 + case when o_orderkey % 7 = 0 then 1 else 0 end as size", "timestamp '2024-01-01' as at")
    return states.verify_uploads(u, c)[0].select("upload_id", "state", "size")


@query("""with p as (select o_orderkey as upload_id, o_orderkey % 500 + 1 as size, cast(ceil((o_orderkey % 500 + 1) / 100.0) as bigint) as expected_parts from orders), g as (select l_orderkey as upload_id, count(*) as received_parts, sum(cast(l_quantity as bigint)) as received_bytes from lineitem group by 1)
    select upload_id, expected_parts, coalesce(received_parts, 0) as received_parts, cast(coalesce(received_bytes, 0) as bigint) as received_bytes, coalesce(received_parts, 0) = expected_parts and coalesce(received_bytes, 0) = size as complete from p left join g using (upload_id)""")
def q49_part_completeness(spark, d):
    plan = states.multipart_plan(table(spark, d, "orders").selectExpr("o_orderkey as upload_id", "o_orderkey % 500 + 1 as size", "100L as part_size"), 100)
    parts = table(spark, d, "lineitem").selectExpr("l_orderkey as upload_id", "l_linenumber as part", "cast(l_quantity as long) as size")
    return states.part_completeness(plan, parts).select("upload_id", "expected_parts", "received_parts", "received_bytes", "complete")


@query("""with r as (select o_orderkey as draft_id, case when o_orderstatus = 'O' then 'pending' else 'done' end as state, cast(o_orderkey % 5 as int) as attempts from orders), k as (select distinct l_orderkey as draft_id from lineitem where l_quantity > 30)
    select draft_id, case when state = 'pending' and attempts >= 3 then 'exhausted' when state = 'pending' and k.draft_id is not null then 'queued' when state = 'pending' then 'source_not_found' else state end as state,
    case when state = 'pending' and attempts < 3 then attempts + 1 else attempts end as attempts from r left join k using (draft_id)""")
def q50_reprocess(spark, d):
    r = table(spark, d, "orders").selectExpr("o_orderkey as draft_id", "case when o_orderstatus = 'O' then 'pending' else 'done' end as state", "cast(o_orderkey % 5 as int) as attempts")
    return states.reprocess(r, table(spark, d, "lineitem").where("l_quantity > 30").selectExpr("l_orderkey as draft_id"))


@query("""with b as (select event_id as ordinal, row_number() over (partition by user_id % 30 order by event_id) as n, user_id % 30 as k from events where value >= 30), c as (select user_id % 30 as k, row_number() over (partition by user_id % 30 order by event_id) as n from events where not value >= 30)
    select ordinal, c.n is not null as matched from b left join c using (k, n)""")
def q51_multiset_trace(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), (F.col("user_id") % 30).alias("k"), "value")
    return timeline.multiset_matches(e.where("value >= 30").drop("value"), e.where("not value >= 30").drop("value"), ["k"], "ordinal").select("ordinal", "matched")


@query("""with e as (select user_id, cast(floor(epoch(ts)) as bigint) as s from events), f as (select *, case when s - lag(s) over (partition by user_id order by s) < 7200 then 0 else 1 end as fresh from e), g as (select *, sum(fresh) over (partition by user_id order by s range between unbounded preceding and current row) as session from f)
    select user_id, cast(session as bigint) as session, min(s) as first_s, max(s) as last_s, count(*) as "rows" from g group by 1, 2""")
def q52_session_debounce(spark, d):
    return timeline.sessions(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("long").alias("s")), ["user_id"], "s", 7200)


@query("""with e as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as s from events), c as (select event_id, count(*) over (partition by user_id order by s range between 86399 preceding and current row) as in_window from e) select event_id, in_window, in_window <= 3 as allowed from c""")
def q53_sliding_rate_limit(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("long").alias("s"))
    return timeline.rate_limited(e, ["user_id"], "s", 3, 86400).select("event_id", "in_window", "allowed")


@query("""select event_type, cast(floor(epoch(ts)) as bigint) // 480 * 480 as start, count(*) as "rows" from events group by 1, 2""")
def q54_tumbling_counts(spark, d):
    from tidemark.streaming import live

    out = live.tumbling_counts(live.event_time(table(spark, d, "events")), ["event_type"])
    return out.select("event_type", F.col("start").cast("long").alias("start"), "rows")


@query("""select user_id, min(event_id) as event_id from events group by 1""")
def q55_first_once(spark, d):
    return timeline.latest(table(spark, d, "events"), ["user_id"], [F.asc("event_id")]).select("user_id", "event_id")


@query(f"""with {_MOMENTS}, s as (select source, person, start // 3600 as hour, cast(sum(score) as bigint) as v from m group by 1, 2, 3), w as (select source, person, hour, sum(v) over (partition by source, person order by hour rows between current row and 2 following) as t, count(v) over (partition by source, person order by hour rows between current row and 2 following) as n from s),
    r as (select *, row_number() over (partition by source, person order by t desc, hour) as k from w where n = 3) select source, person, hour, cast(t as bigint) as window_sum from r where k = 1""")
def q56_moving_peak(spark, d):
    m = moments(spark, d).groupBy("source", "person", F.floor(F.col("start") / 3600).alias("hour")).agg(F.sum("score").alias("v"))
    return timeline.moving_peak(m, ["source", "person"], "hour", "v", 3)


@query("""select ordinal, case when k = 1 then name else name || '_' || printf('%02d', k) || '.mp4' end as unique_name from (select event_id as ordinal, 'draft ' || event_type || ' ' || user_id as name, row_number() over (partition by event_type, user_id order by event_id) as k from events)""")
def q57_unique_names(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.concat(F.lit("draft "), F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("name"))
    return timeline.unique_names(e, "name", "ordinal").select("ordinal", "unique_name")


@query("""with e as (select user_id as draft_id, count(*) as candidates, count(*) filter (event_type = 'error') as dropped from events group by 1)
    select event_id, f.user_id as draft_id, candidates, coalesce(dropped, 0) as dropped, candidates is not null as has_ledger from events f left join e on f.user_id = e.draft_id where event_type = 'signup'""")
def q58_missed_moments(spark, d):
    e = table(spark, d, "events")
    feedback = e.select("event_id", F.col("user_id").alias("draft_id"), F.when(F.col("event_type") == "signup", "MISSING_GOOD_MOMENT").otherwise("APPROVE").alias("feedback_event"))
    rows = e.select(F.col("user_id").alias("draft_id"), F.col("event_id").alias("candidate_id"), (F.col("event_type") != "error").alias("selected"))
    return ledger.missed_moments(feedback, rows).select("event_id", "draft_id", "candidates", "dropped", "has_ledger")


@query("""select event_type, user_id % 5 as k, count(*) as n, min(cast(floor(value) as bigint)) as least, max(cast(floor(value) as bigint)) as most, cast(sum(cast(floor(value) as bigint)) as bigint) as total from events group by 1, 2""")
def q59_distribution(spark, d):
    return reports.distribution(table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("k"), F.floor("value").alias("v")), "v", ["event_type", "k"])


@query(f"""with {_DETECTIONS}, p as (select *, track || '-' || (t // 86400) as raw from d),
    s as (select source, raw, min(t) as f, max(t) as l, arg_min(struct_pack(x1, y1, x2, y2), (t, point_id)) as a, arg_max(struct_pack(x1, y1, x2, y2), (t, point_id)) as z from p group by 1, 2),
    j as (select b.source, a.raw as early, b.raw as late, (b.f, b.l, b.raw) as turn, (a.f, a.l, a.raw) as own, b.f - a.l as gap,
        greatest(0, least(a.z.x2, b.a.x2) - greatest(a.z.x1, b.a.x1)) * greatest(0, least(a.z.y2, b.a.y2) - greatest(a.z.y1, b.a.y1)) as inter, (a.z.x2 - a.z.x1) * (a.z.y2 - a.z.y1) as sa, (b.a.x2 - b.a.x1) * (b.a.y2 - b.a.y1) as sb,
        sqrt(power((a.z.x1 + a.z.x2 - b.a.x1 - b.a.x2) / 2.0, 2) + power((a.z.y1 + a.z.y2 - b.a.y1 - b.a.y2) / 2.0, 2)) / sqrt(1920 * 1920 + 1080 * 1080) as away
        from s a join s b on a.source = b.source and b.f - a.l between 0 and 86400 and (a.f, a.l, a.raw) < (b.f, b.l, b.raw)),
    e as (select * from j where (inter / (sa + sb - inter) >= 0.05 or away <= 0.5) and least(sa, sb) / greatest(sa, sb) >= 0.15),
    g as (select source, list({{'e': [early], 'l': [late]}} order by turn, round(away, 12), gap, -inter / (sa + sb - inter), own) as rows from e group by 1),
    f as (select source, len(list_reduce(rows, lambda acc, x: case when list_contains(acc.e, x.e[1]) or list_contains(acc.l, x.l[1]) then acc else {{'e': list_concat(acc.e, x.e), 'l': list_concat(acc.l, x.l)}} end).e) as joined from g)
    select source, count(*) as raw_tracks, count(*) - coalesce(max(joined), 0) as tracks, coalesce(max(joined), 0) as joined from s left join f using (source) group by 1""")
def q60_stitched_tracks(spark, d):
    p = detections(spark, d).select("source", F.lit("person").alias("class"), F.concat_ws("-", "track", F.floor(F.col("t") / 86400)).alias("raw"), "t", F.col("point_id").alias("frame"), "x1", "y1", "x2", "y2", F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return sequential.stitch_summary(sequential.stitched_tracks(p, 86400, 0.5), ["source"])


@query(f"""with {_MOMENTS}, g as (select person, list({{'o': ordinal, 'c': source, 's': start, 'e': "end", 'q': score}} order by ordinal) as rows from m group by 1),
    k as (select list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: case
        when len(list_filter(acc, lambda y: y.c = x[1].c and least(x[1].e, y.e) - greatest(x[1].s, y.s) >= 0.55 * least(x[1].e - x[1].s, y.e - y.s))) = 0 then list_concat(acc, x)
        else list_transform(acc, lambda y: case when y.o = list_filter(acc, lambda z: z.c = x[1].c and least(x[1].e, z.e) - greatest(x[1].s, z.s) >= 0.55 * least(x[1].e - x[1].s, z.e - z.s))[1].o and x[1].q > y.q then x[1] else y end) end) as kept from g),
    f as (select unnest(kept, recursive := true) from k)
    select m.ordinal, f.o is not null as kept, case when f.o is null then 'same_source_time_overlap' end as reason from m left join f on m.ordinal = f.o""")
def q61_final_guard(spark, d):
    m = moments(spark, d).select("ordinal", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("event_id"), "source", F.lit(None).cast("string").alias("track"), "start", "end", F.col("score").cast("double").alias("quality"), F.lit(False).alias("teaser"), "person")
    return sequential.final_guard(m, ["person"]).select("ordinal", "kept", "reason")


@query(f"""with {_MOMENTS}, s as (select ordinal, person, start, 20 + score * 12 as q, min(ordinal) over (partition by person, source) as seen from m),
    g as (select person, list({{'o': ordinal, 'p': 0, 't': q}} order by seen, start, ordinal) as rows from s group by 1),
    k as (select person, list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: list_concat(acc, [case when acc[-1].t + x[1].t - 1 <= 345 then {{'o': x[1].o, 'p': acc[-1].p, 't': acc[-1].t + x[1].t - 1}} else {{'o': x[1].o, 'p': acc[-1].p + 1, 't': x[1].t}} end])) as r from g),
    f as (select person, unnest(r, recursive := true) from k)
    select o as ordinal, cast(p as int) as part, cast(max(t) over (partition by person, p) as bigint) as quarter_seconds from f""")
def q62_packed_parts(spark, d):
    shared_checkpoints(spark)
    m = short_moments(spark, d).withColumn("end", F.col("start") + 5 + F.col("score") * 3)
    return sequential.packed_parts(m, "person").select("ordinal", "part", F.rint(F.col("seconds") * 4).cast("long").alias("quarter_seconds"))


@query(f"""with {_MOMENTS} select ordinal, greatest(0, start - 10) as start, case when score % 2 = 0 then "end" + 3 else "end" end as "end" from m""")
def q63_window_guards(spark, d):
    m = moments(spark, d).withColumn("outcome", F.when(F.col("score") % 2 > 0, F.col("end")))
    whole = intervals.complete_action(F.col("start"), F.col("end"), F.col("start") - 10, F.col("outcome"))
    return m.withColumn("w", whole).select("ordinal", F.col("w.start").alias("start"), intervals.tail_guard(F.col("w.end"), F.col("outcome"), F.lit(1 << 40), 3).cast("long").alias("end"))


@query("""select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as key_name, substr(sha1(p_name || chr(10) || p_brand), 1, 16) as digest from part""")
def q64_text_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", text.key(F.col("p_name")).alias("key_name"), text.short_digest(F.col("p_name"), F.col("p_brand")).alias("digest"))


@query("""with s as (select event_id, cast(1 + event_id % 10 as int) as score, max(cast(1 + event_id % 10 as int)) over (partition by user_id) as peak from events) select event_id, cast(round_even(least(10, score * 10.0 / peak), 0) as int) as score from s""")
def q65_normalised_score(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (1 + F.col("event_id") % 10).cast("int").alias("score"))
    peak = F.max("score").over(timeline.Window.partitionBy("user_id"))
    return e.withColumn("peak", peak).select("event_id", scores.normalised_score(F.col("score"), F.col("peak")).alias("score"))


@query("""select event_id, case when contains(event_type || ' ' || user_id, 'error 1') then 'first' when contains(event_type || ' ' || user_id, 'e') then 'any e' when contains(event_type || ' ' || user_id, 'signup') then 'sign' end as label from events""")
def q66_first_pattern(spark, d):
    patterns = spark.createDataFrame([(3, "SIGNUP", "sign"), (1, "Error 1", "first"), (2, "e", "any e")], "ordinal int, pattern string, label string")
    rows = table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("said"))
    return lookups.first_pattern(rows, "said", patterns, "event_id").select("event_id", "label")


@query(f"""with {_MOMENTS}, t as (select *, coalesce(sum("end" - start) over (partition by person order by ordinal rows between unbounded preceding and 1 preceding), 0) as rs from m),
    f as (select event_id as defect_id, user_id as reel, case when event_id % 4 = 0 then event_id end as wanted, event_id % 5000 as at from events),
    a as (select defect_id, min(ordinal) as a from f join t on f.reel = t.person and f.wanted = t.ordinal group by 1), b as (select defect_id, min(ordinal) as b from f join t on f.reel = t.person and f.at between rs and rs + ("end" - start) group by 1)
    select defect_id, coalesce(a, b) as ordinal from f left join a using (defect_id) left join b using (defect_id)""")
def q67_defect_events(spark, d):
    e = timeline.rendered_timeline(moments(spark, d), "person", 0.0).select(F.col("person").alias("reel"), "ordinal", F.col("ordinal").alias("event_id"), "rendered_start", "rendered_end")
    o = F.col("event_id")
    defects = table(spark, d, "events").select(o.alias("defect_id"), F.col("user_id").alias("reel"), (o % 5000).alias("at_seconds"), F.when(o % 4 == 0, o).alias("event_id"))
    return lookups.defect_events(defects, e)


@query("""with s as (select l_orderkey as id, list_sort(list_distinct(list(l_suppkey % 7))) as k from lineitem group by 1), r as (select k, count(*) as n, min(id) as one from s where id % 7 > 0 group by 1)
    select s.id as left_id, coalesce(n, 0) as matches, case when n = 1 then one end as right_id from s left join r using (k)""")
def q68_matching_sets(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_suppkey") % 7).alias("ids"))
    return lookups.matching_sets(s, s.withColumn("ids", F.when(F.col("id") % 7 > 0, F.col("ids"))))  # every seventh set on the right is unknown


@query(f"""with {_MOMENTS}, g as (select source, person % 8 as who, list({{'p': -score, 'o': ordinal, 's': start + 480 * (ordinal % 3)}} order by -score, ordinal) as rows from m group by 1, 2),
    k as (select {_FOLD.format(meets='abs(x[1].s - y.s) < 5000')} as kept from g), f as (select unnest(kept, recursive := true) from k)
    select m.ordinal, f.o is not null as kept from m left join f on m.ordinal = f.o""")
def q69_chunks_merged(spark, d):
    m = moments(spark, d).withColumn("chunk_offset", F.col("ordinal") % 3 * 480).withColumn("description", F.concat(F.lit("Person "), (F.col("person") % 8).cast("string")))
    return lookups.chunks_merged(m, 5000).select("ordinal", "kept")


@query("""with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events where event_type not in ('view', 'click') group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, f) as k from c)
    select u.user_id, coalesce(event_type, 'none') as dominant from (select distinct user_id from events) u left join r on u.user_id = r.user_id and k = 1""")
def q70_dominant_activity(spark, d):
    return lookups.dominant(table(spark, d, "events"), ["user_id"], "event_type", "event_id", ["view", "click"], F.lit("none"))


@query("""select user_id % 10 as k, sum(1 + event_id % 3)::bigint as total, count(distinct event_type) as names from events group by 1""")
def q71_counters_merged(spark, d):
    p = table(spark, d, "events").select((F.col("user_id") % 10).alias("k"), F.create_map("event_type", 1 + F.col("event_id") % 3).alias("counts"))
    out = lookups.counters_merged(p, ["k"], "counts")
    return out.select("k", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size("counts").cast("long").alias("names"))


@query("""with s as (select user_id % 40 as g, event_id % 2 as track, event_id % 300 / 1024.0 + 0.25 as x1, event_id % 300 / 1024.0 + 0.375 as x2 from events), m as (select g, median((x1 + x2) / 2) as c from s group by 1)
    select g, count(*) as samples, count(distinct track) as tracks, bool_and(x1 >= c - 0.25 + 0.015625 and x2 <= c + 0.25 - 0.015625) and count(*) >= 2 and count(distinct track) = 1 as fits from s join m using (g) group by 1""")
def q72_fits_in_crop(spark, d):
    o = F.col("event_id")
    s = table(spark, d, "events").select((F.col("user_id") % 40).alias("g"), (o % 2).alias("track"), (o % 300 / 1024.0 + 0.25).alias("x1"), (o % 300 / 1024.0 + 0.375).alias("x2"), F.lit(0.5).alias("crop"))
    return lookups.fits_in_crop(s, ["g"], 0.015625)


@query("""select user_id, case when max(value) > 400 then 'long' when count(*) = 1 then 'single' else 'multi' end as mode from events group by 1""")
def q73_input_mode(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    return e.select("user_id", scores.input_mode(F.col("n"), F.col("largest") * 250_000).alias("mode"))


@query("""select event_id, case when event_id % 3 = 0 then 'strong0:' || user_id when event_id % 5 = 0 then 'trajectory1:' || event_type when value >= 50 then 'medium:' || substr(sha1(cast(event_id // 4 as varchar) || ':' || (event_id % 20)), 1, 16) end as fingerprint from events""")
def q74_event_fingerprint(spark, d):
    o = F.col("event_id")
    print_ = scores.event_fingerprint([F.when(o % 3 == 0, F.col("user_id"))], [F.lit(None).cast("string"), F.when(o % 5 == 0, F.col("event_type"))], F.floor(o / 4) * 1.5, o % 20, F.col("value") / 100, F.lit(1.0))
    return table(spark, d, "events").select("event_id", print_.alias("fingerprint"))


@query("""with t as (select o_custkey as draft_id, o_orderkey as task_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderstatus <> 'F'), a as (select l_suppkey as draft_id, bool_and(l_quantity > 2) as p from lineitem group by 1)
    select c_custkey as draft_id, task_id, coalesce(p, false) as publishable, p is not null as authority_known from customer left join t on c_custkey = t.draft_id and r = 1 left join a on c_custkey = a.draft_id""")
def q75_drafts_enriched(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("state"))
    authority = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("draft_id"), (F.col("l_quantity") > 2).alias("publishable"))
    return lookups.with_tasks(table(spark, d, "customer").select(F.col("c_custkey").alias("draft_id")), tasks, authority).select("draft_id", "task_id", "publishable", "authority_known")


@query("""select point_id, case when samples < 2 then 'too_few_samples' when confidence < 60 then 'low_confidence' when x1 % 7 = 0 then 'subject_at_edge' else 'stable_track_trajectory' end as reason
    from (select event_id as point_id, event_id % 5 as samples, value as confidence, event_id * 37 % 1600 as x1 from events)""")
def q76_framing(spark, d):
    p = detections(spark, d)
    f = scores.framing(F.col("point_id") % 5, F.col("confidence") / 100, F.lit(0.9), F.lit(0.2), F.lit(0.02), F.when(F.col("x1") % 7 == 0, 0.01).otherwise(0.5), F.lit(True))
    return p.select("point_id", f["reason"].alias("reason"))


@query("""select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ', ') as reasons from events group by 1""")
def q77_issue_reasons(spark, d):
    return reports.issue_reasons(table(spark, d, "events"), ["user_id"], "event_type")


@query("""select cast(cast(ts as date) as varchar) as day, event_type, min(event_id) as first, string_agg(cast(user_id as varchar), ',' order by event_id) as items from events group by 1, 2""")
def q78_session_groups(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", "event_id", "user_id")
    return reports.grouped_reels(e, ["day", "event_type"], "event_id", "user_id").withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query(f"""with {_MOMENTS} select person as draft, min(start) as start, max("end") as "end", count(*) as windows, array_to_string(list_sort(list_distinct(list(source))), ',') as sources, bool_and(ordinal % 97 > 0) as lineage_complete, max(score) as score from m group by 1""")
def q79_draft_trace(spark, d):
    m = moments(spark, d).withColumn("athlete", F.when(F.col("ordinal") % 97 > 0, F.col("person")))
    return reports.draft_trace(m.withColumnRenamed("person", "draft"), "draft").withColumn("sources", F.array_join("sources", ","))


@query("""with r as (select l_orderkey as run, l_suppkey % 30 as athlete, l_quantity > 4 as accounted from lineitem), s as (select o_orderkey as run, 4 as athletes, 4 as accounted from orders),
    o as (select run, count(distinct athlete) as n, count(*) filter (accounted) as k from r group by 1)
    select run, rule from (select distinct run, 'athlete_repeated' as rule from (select run, athlete from r group by 1, 2 having count(*) > 1)) union all select distinct run, 'athlete_unaccounted' from r where not accounted
    union all select coalesce(o.run, s.run), 'summary_differs' from o full outer join s on o.run = s.run where n is distinct from athletes or k is distinct from s.accounted""")
def q80_coverage_violations(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as run", "l_suppkey % 30 as athlete", "l_quantity > 4 as accounted")
    summary = table(spark, d, "orders").selectExpr("o_orderkey as run", "4L as athletes", "4L as accounted")
    return reports.coverage_violations(rows, summary, "run")


@query("""select c_custkey, unnest(list_filter([case when not regexp_matches(c_name, '^Customer#[0-9]*[02468]$') then 'name' end, case when not c_acctbal >= 0 then 'balance' end, case when not c_mktsegment in ('BUILDING', 'MACHINERY') then 'segment' end], lambda x: x is not null)) as rule from customer""")
def q81_constraint_violations(spark, d):
    rules = {"name": F.rlike("c_name", F.lit("^Customer#[0-9]*[02468]$")), "balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return reports.constraint_violations(table(spark, d, "customer"), "c_custkey", rules)


from tidemark import queries_chains, queries_edits, queries_orders, queries_rules  # noqa: E402, F401  register their queries with those above
