"""Queries of the value, policy, report and state rules, over whole tables, and their SQL. What the rules read (flags, states, sizes) is made from the tables'
columns, on both sides alike; numbers are kept to halves and eighths, so that both engines' doubles are the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geometry, intervals, scores, text
from tidemark.operators import greedy, identity, ledger, lookups, overlap, policies, reports, sequential, states, timeline
from tidemark.plans import sessions
from tidemark.queries import _DETECTIONS, _MOMENTS, _PAIRS, _WINDOWS, detections, moments, query, shared_checkpoints, table, windows
from tidemark.sources import sinks


def events(spark, d):
    return table(spark, d, "events")


def joined(column):
    return F.array_join(column.cast("array<string>"), ",")


@query("""with x as (select event_id, case event_id % 6 when 0 then 'none' when 1 then '' when 2 then 'nan' else cast(event_id // 3 as varchar) end as t from events)
    select event_id, case when event_id % 6 > 2 then try_cast(t as double) end as number, cast(greatest(10, least(500, coalesce(case when event_id % 6 > 2 then try_cast(t as double) end, 5))) as double) as clamped,
    cast(case when event_id % 4 = 0 then 7 else greatest(0, event_id % 9 - event_id % 5) end as bigint) as seconds, event_id % 9 > event_id % 5 and event_id % 7 > 0 as valid from x""")
def q82_numbers_and_windows(spark, d):
    e_id = F.col("event_id")
    said = F.when(e_id % 6 == 0, "none").when(e_id % 6 == 1, "").when(e_id % 6 == 2, "nan").otherwise(F.floor(e_id / 3).cast("string"))
    number = intervals.optional_number(said)
    source = F.when(e_id % 7 > 0, "clip").otherwise(" ")
    seconds = intervals.duration(e_id % 5, e_id % 9, F.when(e_id % 4 == 0, F.lit(7)))
    return events(spark, d).select("event_id", number.alias("number"), intervals.clamp(F.coalesce(number, F.lit(5.0)), 10.0, 500.0).alias("clamped"), seconds.cast("long").alias("seconds"), intervals.valid_window(e_id % 5, e_id % 9, source).alias("valid"))


@query("""with x as (select event_id, event_id % 30 + event_id % 8 / 8.0 as s, event_id % 30 + event_id % 8 / 8.0 + event_id % 16 / 4.0 as e from events),
    y as (select *, case when round_even((s - floor(s + 1e-9)) * 100, 0) < 60 then floor(s + 1e-9) * 60 + round_even((s - floor(s + 1e-9)) * 100, 0) end as ms, case when round_even((e - floor(e + 1e-9)) * 100, 0) < 60 then floor(e + 1e-9) * 60 + round_even((e - floor(e + 1e-9)) * 100, 0) end as me from x),
    z as (select *, coalesce(e - s < 5 and me - ms >= 5, false) as use from y) select event_id, cast(8 * case when use then ms else s end as bigint) as start8, cast(8 * case when use then me else e end as bigint) as end8, case when use then 'minute_second' else 'decimal_seconds' end as encoding from z""")
def q83_recovered_windows(spark, d):
    e_id = F.col("event_id")
    s = (e_id % 30).cast("double") + (e_id % 8) / 8
    r = intervals.recovered(s, s + (e_id % 16) / 4)
    return events(spark, d).withColumn("r", r).select("event_id", F.rint(F.col("r.start") * 8).cast("long").alias("start8"), F.rint(F.col("r.end") * 8).cast("long").alias("end8"), F.col("r.encoding").alias("encoding"))


@query("""with x as (select event_id, event_id % 12 as a, event_id % 12 + event_id % 7 as b, event_id % 20 as c, case when event_id % 5 > 0 then event_id % 20 + event_id % 4 end as d from events)
    select event_id, case when d is not null then greatest(0, c - b, a - d) end as gap, case when d is not null then 8 * greatest(0, least(b, d) - greatest(a, c)) // nullif(case when least(b - a, d - c) > 0 then least(b - a, d - c) end, 0) end as share8 from x""")
def q84_gaps(spark, d):
    e_id = F.col("event_id")
    a, b, c = e_id % 12, e_id % 12 + e_id % 7, e_id % 20
    end = F.when(e_id % 5 > 0, c + e_id % 4)
    shorter = F.least(b - a, end - c)
    share = F.when(end.isNotNull() & (shorter > 0), F.floor(intervals.overlap_ratio(a, b, c, end) * 8 + 1e-9))
    return events(spark, d).select("event_id", intervals.gap_seconds(a, b, c, end).alias("gap"), share.alias("share8"))


_TOKENS = """list_sort(list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: len(x) >= 3 and not list_contains(['and', 'the', 'with', 'for', 'from', 'player', 'athlete', 'person', 'surfer', 'wearing'], x))))"""


@query(f"""with x as (select p_partkey, p_name as a, p_type || ' ' || substr(p_name, 1, cast(p_partkey % 9 as bigint)) as b, substr(p_name, 1, cast(p_partkey % 9 as bigint)) as c from part), t as (select *, {_TOKENS.format('a')} as ta, {_TOKENS.format('b')} as tb from x)
    select p_partkey, case when len(ta) = 0 or len(tb) = 0 then 0 else 1000 * len(list_intersect(ta, tb)) // len(list_distinct(ta || tb)) end as jaccard, case when len(c) > 0 then 1000 * len(c) // len(a) else 0 end as prefix,
    array_to_string(list_sort(list_intersect(list_intersect(ta, tb), ['red', 'blue', 'small', 'bolt'])), ',') as shared from t""")
def q85_text_similarity(spark, d):
    cut = F.substring("p_name", F.lit(1), (F.col("p_partkey") % 9).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat_ws(" ", "p_type", cut).alias("b"), cut.alias("c"))
    ta, tb = text.tokens(F.col("a")), text.tokens(F.col("b"))
    thousandths = lambda c: F.floor(c * 1000 + 1e-9).cast("long")
    return p.select("p_partkey", thousandths(text.jaccard(ta, tb)).alias("jaccard"), thousandths(text.prefix_similarity(F.col("a"), F.col("c"))).alias("prefix"), joined(text.vocabulary_overlap(ta, tb, ["red", "blue", "small", "bolt"])).alias("shared"))


@query("""with x as (select event_id, event_id % 11 as score, case when event_id % 5 > 0 then event_id % 10 / 8.0 end as v, case when event_id % 3 > 0 then event_id % 9 / 8.0 end as c, event_id % 20 as s, event_id % 2 = 0 as box, event_id % 7 < 3 as track from events)
    select event_id, cast(round_even(1000 * (score * 10 + coalesce(v, 0) * 4 + coalesce(c, 0) * 4 + least(s, 12.0) * 0.1 + case when box then 0.25 else 0 end + case when track then 0.15 else 0 end), 0) as bigint) as dedup,
    cast(round_even(1000 * (score * 0.75 + greatest(0, least(1, coalesce(v, 1))) * 1.5 + greatest(0, least(1, coalesce(c, 1)))), 0) as bigint) as guard,
    cast(round_even(1000 * (score * 10 + event_id % 4 * 3 - greatest(0, s - 8) * 0.7 - case when box then 8 else 0 end), 0) as bigint) as impact from x""")
def q86_qualities(spark, d):
    e_id = F.col("event_id")
    score, v, c = e_id % 11, F.when(e_id % 5 > 0, (e_id % 10) / 8), F.when(e_id % 3 > 0, (e_id % 9) / 8)
    whole = lambda x: F.rint(x * 1000).cast("long")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return events(spark, d).select(
        "event_id", whole(scores.dedup_quality(score, zero(v), zero(c), (e_id % 20).cast("double"), e_id % 2 == 0, e_id % 7 < 3)).alias("dedup"), whole(scores.guard_quality(score.cast("double"), v, c)).alias("guard"),
        whole(scores.impact(score, e_id % 4, (e_id % 20).cast("double"), e_id % 2 == 0)).alias("impact"),
    )


@query("""select event_id, 2 * (event_id % 2) + 3 * (event_id % 3 // 2) + 4 * (event_id % 5 // 4) + case when event_id % 5 = 4 and event_id % 40 <= 25 then 1 else 0 end as tenths,
    case when least(event_id % 3000, event_id % 2900 + 1) = 0 then 'unknown' when least(event_id % 3000, event_id % 2900 + 1) >= 2160 then '4k' when least(event_id % 3000, event_id % 2900 + 1) >= 1440 then '1440p' when least(event_id % 3000, event_id % 2900 + 1) >= 1080 then '1080p' when least(event_id % 3000, event_id % 2900 + 1) >= 720 then '720p' else 'low' end as tier,
    event_id % 11 >= 6 or (event_type = 'view' and event_id % 13 > 0) as admitted, case when event_id % 4 = 3 and event_id % 6 <> 4 then 'slide' else ['cut', 'fade', 'slide', 'zoom'][event_id % 4 + 1] end as transition from events""")
def q87_completion_tier_admission(spark, d):
    e_id = F.col("event_id")
    part = scores.wave_completion(F.when(e_id % 2 == 1, e_id), F.when(e_id % 3 == 2, e_id), F.when(e_id % 5 == 4, e_id % 40), F.lit(25))
    failed = scores.failed_takeoff(F.when(e_id % 13 == 0, "Missed the wave again").otherwise("fine"), F.lit(None).cast("string"))
    wanted = F.element_at(F.array(*(F.lit(x) for x in ("cut", "fade", "slide", "zoom"))), (e_id % 4 + 1).cast("int"))
    return events(spark, d).select(
        "event_id", F.rint(part * 10).cast("long").alias("tenths"), scores.render_tier(e_id % 3000, e_id % 2900 + 1).alias("tier"), scores.admitted(e_id % 11, F.col("event_type") == "view", failed).alias("admitted"),
        scores.transitions(e_id % 6, F.lit(5), wanted).alias("transition"),
    )


@query("""select p_partkey, substr(sha256(p_name || chr(10) || p_brand || chr(10) || coalesce(case when p_partkey % 3 > 0 then p_type end, '')), 1, 16) as athlete, substr(trim(regexp_replace('-' || p_name || '/' || p_brand || '-', '[^A-Za-z0-9_-]+', '_', 'g'), '_'), 1, 80) as batch,
    case when trim(case when p_partkey % 2 = 0 then ' ' else p_name end) <> '' then case when p_partkey % 2 = 0 then ' ' else p_name end else p_brand end as label, case when p_partkey % 4 > 1 then 'chunk_' || lpad(cast(p_partkey % 100 as varchar), 2, '0') || ':' || p_brand else p_brand end as spaced,
    case when p_partkey % 3 = 0 then p_name else p_name || ' b' end as draft from part""")
def q88_keys_and_labels(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("-"), "p_name", F.lit("/"), "p_brand", F.lit("-"))
    named = F.concat(F.lit("DRAFT_"), "p_name", F.when(k % 3 == 0, F.lit(" part 2")).otherwise(F.lit(" b 2024-01-05")))
    return table(spark, d, "part").select(
        "p_partkey", text.athlete_key(F.col("p_name"), F.col("p_brand"), F.when(k % 3 > 0, F.col("p_type"))).alias("athlete"), text.batch_id(raw).alias("batch"),
        text.first_truthy(F.when(k % 2 == 0, " ").otherwise(F.col("p_name")), F.col("p_brand")).alias("label"), intervals.namespaced((k % 100).cast("int"), k % 4, F.col("p_brand")).alias("spaced"), text.draft_label(named).alias("draft"),
    )


@query("""select event_id, case when event_id % 5 = 0 then event_id % 7 > 0 else event_id % 5 = 1 and event_id % 3 = 0 end as blocking, case when event_id % 3 > 0 and event_id % 100 >= 60 and event_id % 4 = 0 then 'PASS' else 'FAIL' end as verdict,
    array_to_string(list_filter([case when event_id % 120 = 0 then 'missing_duration' end, case when event_id % 120 > 90 then 'too_long' end, case when event_id % 2000 + 1 < 1280 then 'low_resolution' end,
        case when abs((event_id % 1100) / (event_id % 2000 + 1) - 9.0 / 16) > 0.02 then 'wrong_aspect' end, case when event_id % 3 = 0 then 'audio_unknown' end, case when event_id % 3 = 1 then 'audio_present' end], lambda x: x is not null), ',') as issues from events""")
def q89_qa_rules(spark, d):
    e_id = F.col("event_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("DUPLICATE_MOMENT", "SHAKY", "DARK", "BLUR", "OTHER"))), (e_id % 5 + 1).cast("int"))
    blocking = scores.blocking(F.when((e_id % 5 == 0) & (e_id % 7 == 0), "OTHER").otherwise(kind), F.when(e_id % 3 == 0, "Critical").otherwise("minor"), ["DUPLICATE_MOMENT"], ["SHAKY"])
    audio = F.when(e_id % 3 == 1, True).when(e_id % 3 == 2, False)
    return events(spark, d).select("event_id", blocking.alias("blocking"), scores.verdict(e_id % 3 > 0, e_id % 100, e_id % 4).alias("verdict"), joined(scores.output_issues(e_id % 1100, e_id % 2000 + 1, e_id % 120, audio)).alias("issues"))


_NARRATIVE = """n as (select event_id, event_type, user_id, event_id % 11 as score, case when event_id % 5 > 0 then event_id % 10 / 8.0 end as v, case when event_id % 3 > 0 then event_id % 9 / 8.0 end as c, ['valid', 'adjusted', 'rejected', 'odd'][event_id % 4 + 1] as w,
    event_id % 17 > 0 and event_id % 6 > 0 as known, list_filter([case when event_id % 2 = 0 then 'FULL_RIDE' end, case when event_id % 3 = 0 then 'FALL' end, case when event_id % 5 = 0 then 'BORING' end, case when event_id % 7 = 0 then 'BAD_CROP' end, 'HERO'], lambda x: x is not null) as labels from events),
k as (select *, coalesce(v, 1) >= 0.35 and coalesce(c, 1) >= 0.25 and w <> 'rejected' and known as evidence from n),
b as (select *, score * 0.6 + greatest(0, least(1, coalesce(v, 1))) * 1.6 + greatest(0, least(1, coalesce(c, 1))) + case when event_id % 2 = 0 then 0.6 else 0 end + case when event_id % 3 = 0 then 0.6 else 0 end
    + case when w in ('valid', 'adjusted') then 0.4 else -2 end + case when known then 0.4 else -3 end + case when evidence then 0 else -3 end as base from k)"""


def narrative(spark, d):
    e_id = F.col("event_id")
    v, c = F.when(e_id % 5 > 0, (e_id % 10) / 8), F.when(e_id % 3 > 0, (e_id % 9) / 8)
    status = F.element_at(F.array(*(F.lit(x) for x in ("valid", "adjusted", "rejected", "odd"))), (e_id % 4 + 1).cast("int"))
    known = policies.identity_known(F.when(e_id % 6 == 0, "Low"), F.when(e_id % 17 == 0, True))
    labels = F.array_compact(F.array(F.when(e_id % 2 == 0, "FULL_RIDE"), F.when(e_id % 3 == 0, "FALL"), F.when(e_id % 5 == 0, "BORING"), F.when(e_id % 7 == 0, "BAD_CROP"), F.lit("HERO")))
    return events(spark, d).select("event_id", "event_type", "user_id", policies.quality_evidence(v, c, status, known).alias("evidence"), policies.narrative_quality((e_id % 11).cast("double"), v, c, e_id % 2 == 0, e_id % 3 == 0, status, known).alias("base"), labels.alias("labels"))


@query(f"""with {_NARRATIVE} select event_id, evidence, cast(round(base * 1000) as bigint) as base1000, cast(round(1000 * (base + len(list_intersect(labels, ['FULL_RIDE', 'FALL'])) - 1.5 * len(list_intersect(labels, ['BORING', 'BAD_CROP'])))) as bigint) as value1000,
    array_to_string(list_filter([case when event_id % 3 = 0 then 'fall_recovery' end, case when event_id % 2 = 0 then 'long_ride' end], lambda x: x is not null), ',') as categories from b""")
def q90_editorial_value(spark, d):
    n = narrative(spark, d).withColumn("e", policies.editorial_value(F.col("base"), F.col("labels")))
    return n.select("event_id", "evidence", F.rint(F.col("base") * 1000).cast("long").alias("base1000"), F.rint(F.col("e.value") * 1000).cast("long").alias("value1000"), joined(F.col("e.categories")).alias("categories"))


@query("""with m as (select event_id as ordinal, event_id // 4 as draft, event_id % 9 = 0 as teaser, event_id % 11 as score, case when event_id % 5 = 0 then 'fp' || user_id end as fp, case when event_id % 7 > 0 then event_type end as src, event_id % 3 as s, event_id % 3 + user_id % 2 as e from events),
    w as (select draft, score + 2 as q, case when fp is not null then 'fp|' || fp when src is not null then 'window|' || src || '|' || 2 * s || '|' || 2 * e || '|' else 'event|' || ordinal || '|' || 2 * s || '|' || 2 * e end as k from m where not teaser),
    g as (select draft, array_to_string(list_sort(list(k)), chr(10)) as k, sum(q) as q from w group by 1), a as (select distinct event_id // 4 as draft from events),
    r as (select draft, k, q, first_value(draft) over (partition by k order by q desc, draft) as best from g)
    select a.draft, cast(coalesce(q, 0) as bigint) as quality, coalesce(best = a.draft, true) as kept, case when best <> a.draft then best end as rival from a left join r using (draft)""")
def q91_draft_duplicates(spark, d):
    e_id = F.col("event_id")
    m = events(spark, d).select(
        e_id.alias("ordinal"), F.floor(e_id / 4).alias("draft"), (e_id % 9 == 0).alias("teaser"), (e_id % 11).alias("score"), F.when(e_id % 5 == 0, F.concat(F.lit("fp"), F.col("user_id").cast("string"))).alias("fingerprint"), F.when(e_id % 7 > 0, F.col("event_type")).alias("source"),
        (e_id % 3).cast("double").alias("start"), (e_id % 3 + F.col("user_id") % 2).cast("double").alias("end"), F.lit(None).cast("string").alias("track"), F.lit(None).cast("double").alias("visible"), F.lit(None).cast("double").alias("confidence"),
    )
    drafts = m.select("draft", F.col("draft").alias("o")).distinct().withColumnRenamed("o", "ordinal")
    return greedy.draft_fingerprint_dedup(drafts, m).select("draft", F.rint("quality").cast("long").alias("quality"), "kept", "rival")


_STAGES = ["selector", "long_video_pre_qa_prefilter", "single_athlete_selection_policy", "render_or_upload_not_emitted_after_prefilter", "post_selector_not_emitted", "other"]
_DECIDED = f"""c as (select event_id, event_id % 3 = 0 as selected, event_id % 2 = 0 as pre, {_STAGES}[event_id % 6 + 1] as stage, case when event_id % 5 > 0 then 'cause_' || event_id % 5 end as cause, case when user_id % 50 > 0 then user_id end as person, event_id % 11 as score from events)"""


def decided(spark, d):
    e_id = F.col("event_id")
    stage = F.element_at(F.array(*(F.lit(x) for x in _STAGES)), (e_id % 6 + 1).cast("int"))
    cause = F.when(e_id % 5 > 0, F.concat(F.lit("cause_"), (e_id % 5).cast("string")))
    return events(spark, d).select("event_id", (e_id % 3 == 0).alias("selected"), (e_id % 2 == 0).alias("pre"), stage.alias("stage"), cause.alias("cause"), F.when(F.col("user_id") % 50 > 0, F.col("user_id").cast("string")).alias("person"), (e_id % 11).alias("score"))


@query(f"""with {_DECIDED} select event_id, case when selected and pre then 'analyzer_selected,prefilter_passed,draft_uploaded' when selected then 'analyzer_selected,draft_uploaded' when stage = 'selector' then 'selector,' || coalesce(cause, 'None')
    when stage = 'long_video_pre_qa_prefilter' then 'analyzer_selected,prefilter_failed,' || coalesce(cause, 'None') when stage = 'single_athlete_selection_policy' then 'analyzer_selected,selection_policy_rejected,' || coalesce(cause, 'None')
    when stage = 'render_or_upload_not_emitted_after_prefilter' then 'analyzer_selected,prefilter_passed,render_or_upload_not_emitted,' || coalesce(cause, 'None') when stage = 'post_selector_not_emitted' then 'analyzer_selected,prefilter_unknown,not_emitted,' || coalesce(cause, 'None')
    else 'analyzer_selected,stage_unknown,' || coalesce(cause, 'None') end as path from c""")
def q92_decision_paths(spark, d):
    return decided(spark, d).select("event_id", joined(policies.decision_path(F.col("selected"), F.col("pre"), F.col("stage"), F.col("cause"))).alias("path"))


@query(f"""with {_DECIDED}, p as (select coalesce(cast(person as varchar), 'unknown') as person, selected, score, case when selected then 'selected' else stage end as stage, case when selected then 'selected' else coalesce(cause, 'selected') end as cause from c),
    s as (select person, string_agg(stage || '=' || n, ',' order by stage) as stages from (select person, stage, count(*) as n from p group by 1, 2) group by 1), q as (select person, string_agg(cause || '=' || n, ',' order by cause) as causes from (select person, cause, count(*) as n from p group by 1, 2) group by 1)
    select person, count(*) as candidates, count(*) filter (selected) as selected, count(*) filter (not selected) as discarded, max(score) as score_max, any_value(stages) as stages, any_value(causes) as causes from p join s using (person) join q using (person) group by 1""")
def q93_person_summary(spark, d):
    rows = decided(spark, d).withColumn("discarded", ~F.col("selected"))
    rows = rows.withColumn("discard_stage", F.when(F.col("discarded"), F.col("stage"))).withColumn("discard_cause", F.when(F.col("discarded"), F.col("cause")))
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return reports.person_summary(rows, F.col("person")).withColumn("stages", flat("stages")).withColumn("causes", flat("causes"))


@query(f"""with {_NARRATIVE}, x as (select user_id as draft, case when event_id % 4 > 0 then event_type end as decision, labels from n), l as (select draft, string_agg(label || '=' || k, ',' order by label) as labels from (select draft, label, count(*) as k from (select draft, unnest(labels) as label from x) group by 1, 2) group by 1),
    q as (select draft, string_agg(decision || '=' || k, ',' order by decision) as decisions, sum(k)::bigint as entries from (select draft, coalesce(decision, 'unknown') as decision, count(*) as k from x group by 1, 2) group by 1) select draft, entries, decisions, labels from q left join l using (draft)""")
def q94_ledger_summary(spark, d):
    e_id = F.col("event_id")
    rows = narrative(spark, d).select(F.col("user_id").alias("draft"), F.when(e_id % 4 > 0, F.col("event_type")).alias("decision"), "labels")
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return reports.ledger_summary(rows, "draft").withColumn("decisions", flat("decisions")).withColumn("labels", flat("labels"))


_ACTOR = """x as (
    select *, case event_id % 8 when 3 then 'occluded' when 4 then 'identity_switch' when 5 then 'drifting' else 'stable' end as state, case when event_id % 23 = 0 then false when event_id % 4 = 0 then true end as clear,
        case when event_id % 16 < 3 then (event_id % 16 + 1) / 8.0 when event_id % 16 <> 9 then 0.75 end as sure, case when event_id % 3 > 0 then user_id end as actor from events),
y as (select *, event_id % 5 = 0 and not coalesce(state = 'stable' and actor is not null and clear and sure >= 0.55, false) as open from x),
a as (
    select event_id, list_filter([
        case when event_id % 13 = 0 then 'identity_switch' end, case when event_id % 19 = 0 then 'target_lost' end, case when state in ('occluded', 'identity_switch') then 'primary_actor_status:' || state end,
        case when not clear then 'primary_actor_clear:false' end, case when event_id % 16 < 3 then 'primary_actor_confidence:' || ['0.125', '0.250', '0.375'][event_id % 16 + 1] end,
        case when open and actor is null then 'primary_actor_id:missing' end, case when open and not coalesce(clear, false) then 'primary_actor_clear:not_proven' end,
        case when open and state <> 'stable' then 'identity_continuity:not_proven_stable' end, case when open and sure is null then 'primary_actor_confidence:missing' end,
        case when open then 'multiple_active_subjects' end, case when event_id % 29 = 0 then 'focused_subwindow_validation_required' end,
        case when event_id % 31 = 0 and event_id % 7 > 0 then 'target_lost_description' end], lambda x: x is not null) as reasons,
        actor, clear, case when event_id % 6 > 0 then event_id % 8 / 8.0 end as continuity, event_id % 4 as visible, event_id % 29 = 0 as pending
    from y),
w as (select *, pending and actor is not null and coalesce(continuity >= 0.5, false) as waits from a),
l as (select *, list_filter(reasons, lambda x: not (waits and x = 'focused_subwindow_validation_required')) || case when continuity < 0.5 then ['primary_continuity_ratio:' || ['0.000', '0.125', '0.250', '0.375'][event_id % 8 + 1]] else [] end as told from w),
p as (select *, len(told) > 0 as blocked, actor is not null or coalesce(clear, false) or waits or coalesce(continuity >= 0.5, false) as sure from l),
g as (select *, case when blocked then 'review_required' when sure then 'allowed_primary_actor_clear' when visible <= 1 then 'allowed_single_visible_subject' else 'review_required' end as decision from p)"""


def actors(spark, d):
    e_id = F.col("event_id")
    e = events(spark, d)
    reasons = policies.ambiguity_reasons(
        {"identity_switch": F.when(e_id % 13 == 0, True), "target_lost": e_id % 19 == 0},
        {"primary_actor_status": F.when(e_id % 8 == 3, "Occluded").when(e_id % 8 == 4, " Identity Switch").when(e_id % 8 == 5, "drifting").otherwise("stable")},
        F.when(e_id % 23 == 0, False).when(e_id % 4 == 0, True), F.when(e_id % 16 < 3, (e_id % 16 + 1) / 8).when(e_id % 16 != 9, 0.75), {"multiple_active_subjects": e_id % 5 == 0},
        F.when(e_id % 3 > 0, F.col("user_id")), e_id % 29 == 0, F.when(e_id % 31 == 0, "The camera loses track of the target"), e_id % 7 == 0,
    )
    e = e.withColumn("reasons", reasons)
    continuity = F.when(e_id % 6 > 0, (e_id % 8) / 8)
    actor = policies.primary_actor(F.col("reasons"), F.when(e_id % 3 > 0, F.col("user_id")), F.when(e_id % 23 == 0, False).when(e_id % 4 == 0, True), continuity, e_id % 4, e_id % 29 == 0)
    return e.withColumn("actor", actor)


@query(f"""with {_ACTOR} select event_id, array_to_string(reasons, ',') as reasons, decision, case when blocked then case when array_to_string(told, ' ') like '%switch%' then 'IDENTITY_SWITCH' when array_to_string(told, ' ') like '%occlu%' then 'PRIMARY_ACTOR_OCCLUDED' else 'PRIMARY_ACTOR_UNCLEAR' end when not sure and visible > 1 then 'PRIMARY_ACTOR_UNCLEAR' end as defect,
    not blocked and sure and visible > 1 as others_allowed, case when blocked then array_to_string(told, ',') when not sure and visible > 1 then 'primary_actor_unknown' else '' end as shown from g""")
def q95_primary_actor(spark, d):
    a = F.col("actor")
    return actors(spark, d).select("event_id", joined(F.col("reasons")).alias("reasons"), a["decision"].alias("decision"), a["defect"].alias("defect"), a["others_allowed"].alias("others_allowed"), joined(a["reasons"]).alias("shown"))


@query(f"""with {_ACTOR}, s as (select g.*, event_id % 37 = 0 or event_id % 41 = 0 or event_id % 43 = 0 or event_id % 47 = 0 as social from g)
    select event_id, case when social then 'allowed_social_moment' else decision end as decision, social, 1 + cast(event_id % 3 > 0 as int) + cast(event_id % 3 > 1 as int) as visible from s""")
def q96_multi_person_gate(spark, d):
    e_id = F.col("event_id")
    a = actors(spark, d)
    ids = F.array(F.lit("a"), F.when(e_id % 3 > 0, "b"), F.when(e_id % 3 > 1, "c"), F.lit("a"))
    gate = policies.multi_person_gate(F.col("actor.decision"), ids, F.when(e_id % 37 == 0, True), F.when(e_id % 41 == 0, F.array(F.lit("HIGH_FIVE"))), F.when(e_id % 43 == 0, "Team-Interaction"), F.when(e_id % 47 == 0, "a High Five"))
    return a.withColumn("g", gate).select("event_id", F.col("g.decision").alias("decision"), F.col("g.social").alias("social"), F.col("g.visible").alias("visible"))


@query(f"""with {_ACTOR} select event_id, len(reasons) > 0 as focused, case when len(reasons) > 0 then event_id + 2 else event_id end as start, case when len(reasons) > 0 then event_id + 2 + event_id % 12 else event_id + 20 end as "end" from a where len(reasons) = 0 or (event_id % 5 > 0 and event_id % 12 >= 6)""")
def q97_focused_or_dropped(spark, d):
    e_id = F.col("event_id")
    a = actors(spark, d).withColumns({"start": e_id, "end": e_id + 20, "focused_start": e_id + 2, "focused_end": F.when(e_id % 5 > 0, e_id + 2 + e_id % 12)})
    return policies.focused_or_dropped(a, F.col("reasons")).select("event_id", "focused", "start", "end")


@query("""with c as (select event_id, event_id + 3 as s, event_id + 11 as t from events where event_type in ('view', 'click'))
    select e.event_id, case when e.event_id % 4 > 0 then 'not_needed' when c.event_id is not null then 'clean_subwindow_rescued' else 'no_clean_subwindow_found' end as rescue, case when e.event_id % 4 = 0 and c.event_id is not null then s else e.event_id end as start, case when e.event_id % 4 = 0 and c.event_id is not null then t else e.event_id + 30 end as "end",
    case when e.event_id % 4 = 0 and c.event_id is not null then user_id else user_id % 7 end as track, case when e.event_id % 4 > 0 or c.event_id is null then user_id % 5 end as athlete from events e left join c using (event_id)""")
def q98_rescued(spark, d):
    e_id = F.col("event_id")
    u = F.col("user_id")
    e = events(spark, d).select("event_id", e_id.alias("start"), (e_id + 30).alias("end"), (e_id % 4 == 0).alias("defect"), u.alias("primary"), (u % 7).alias("track"), (u % 5).alias("athlete"))
    clean = events(spark, d).where(F.col("event_type").isin("view", "click")).select("event_id", (e_id + 3).alias("start"), (e_id + 11).alias("end"))
    return policies.rescued(e, clean, "event_id", "defect", "primary", ["athlete"]).select("event_id", "rescue", "start", "end", "track", "athlete")


@query("""select l_orderkey as cluster, bool_and(ok) as evidence from (select l_orderkey, l_linenumber % 3 as app, bool_or(l_quantity > 5 and l_discount < 0.095 and l_tax >= 0.015) as ok from lineitem group by 1, 2) group by 1""")
def q99_cluster_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), (F.col("l_linenumber") % 3).alias("app"), (F.col("l_quantity") > 5).alias("box"), F.when(F.col("l_discount") >= 0.095, False).alias("usable"), F.when(F.col("l_tax") >= 0.015, 0.5).alias("visible"))
    return policies.cluster_evidence(rows, "cluster", "app", "box", "usable", "visible")


@query(f"""with {_MOMENTS}, {_DETECTIONS}, {_PAIRS}, {_WINDOWS},
    f as (select source, count(distinct track) as tracks, count(*) filter (k < 2600000) as short from (select source, track, max(t) - min(t) as k from d group by 1, 2) group by 1),
    x as (select count(*) as n, count(*) filter (score > 1) as w, count(*) filter (score = 10) as dup, count(*) filter (score <> 2) as told from m),
    y as (
        select count(*) as c, count(distinct case when point_id % 9 > 0 then track end) as u, count(*) filter (point_id % 9 = 0) as no_track, count(*) filter (x2 > 1700) as boxes,
            count(*) filter (point_id % 100 = 0) as times, min(confidence) as lo, max(confidence) as hi from d),
    z as (select sum(tracks) as tracks, sum(short) as short from f), s as (select count(*) as k from customer where c_acctbal >= 0), r as (select count(*) as k from customer where c_acctbal < 0),
    o as (select count(*) as k from q), t as (select window_id, track, count(*) as n from h group by all),
    v as (select count(*) as k from (select window_id from t group by 1 having sum(n) >= 4 and count(*) >= 2 and max(n) <= sum(n) * 0.7))
    select n as draft_count, told as draft_metadata_count, s.k as sidecar_count, c as detection_count, u as unique_track_count, o.k as overlap_pairs, v.k as mixed_windows, cast(short as bigint) as short_track_count,
        lo as least_confidence, hi as most_confidence, w / n as window_rate, o.k / (n * (n - 1) / 2) as overlap_rate, v.k / n as mixed_rate, dup as duplicate_drafts, dup / n as duplicate_rate,
        short / tracks as short_rate, short / tracks as fragmentation_rate, r.k / (s.k + r.k) as error_rate, no_track / c as untracked_rate, boxes / c as box_rate, times / c as time_rate, c / 40 as per_video,
        cast(0 as double) as trace_missing_rate, cast(1 as double) as upload_missing_rate, cast(0 as double) as without_drafts_rate, 3 as exit_code
    from x, y, z, s, r, o, v""")
def q100_run_metrics(spark, d):
    m, p, c = moments(spark, d), detections(spark, d), table(spark, d, "customer")
    drafts = m.select((F.col("score") > 1).alias("has_window"), (F.col("score") == 10).alias("duplicate"), (F.col("score") != 2).alias("in_trace"))
    points = p.select(F.when(F.col("point_id") % 9 > 0, F.col("track")).alias("track"), (F.col("x2") <= 1700).alias("box_valid"), (F.col("point_id") % 100 > 0).alias("time_valid"), "confidence")
    pairs = overlap.overlapping_pairs(m, ["source"], "ordinal", differ="person")
    mixed = reports.mixed_windows(overlap.points_in_intervals(p, windows(spark, d), ["source"]), "window_id", "track")
    sidecars = c.select((F.col("c_acctbal") >= 0).alias("valid"))
    out = reports.run_metrics(drafts, sidecars, points, pairs, mixed, reports.fragmentation(p, "source", "track", short=2_600_000), 40, exit_code=3, summary_found=False)
    named = {
        "overlap_pairs": "source_window_overlap_pair_count", "mixed_windows": "mixed_subject_likely_window_count", "window_rate": "draft_source_window_coverage_rate", "overlap_rate": "source_window_overlap_duplicate_rate",
        "mixed_rate": "mixed_subject_violation_rate", "duplicate_drafts": "duplicate_athlete_likely_draft_count", "duplicate_rate": "duplicate_athlete_violation_rate", "short_rate": "short_track_rate",
        "fragmentation_rate": "track_fragmentation_rate", "error_rate": "sidecar_schema_error_rate", "untracked_rate": "track_id_missing_rate", "box_rate": "bbox_out_of_bounds_rate",
        "time_rate": "invalid_time_window_rate", "per_video": "detections_per_video", "trace_missing_rate": "draft_without_decision_trace_rate", "upload_missing_rate": "artifact_upload_missing_rate",
        "without_drafts_rate": "no_drafts_with_candidates_rate",
    }
    plain = ["draft_count", "draft_metadata_count", "sidecar_count", "detection_count", "unique_track_count", "short_track_count", "least_confidence", "most_confidence", "exit_code"]
    return out.select(*plain, *(F.col(v).alias(k) for k, v in named.items()))


@query("""with w as (select user_id as run, count(*) as evaluated, count(*) filter (event_id % 7 > 0) as explicit, count(*) filter (event_id % 7 > 0 and event_type = 'error' and user_id % 3 = 0) as violations, count(*) filter (event_id % 4 = 0) as others_allowed from events group by 1),
    x as (select c_custkey as run, greatest(coalesce(case when c_custkey % 2 = 0 then c_custkey % 90 end, 0), c_custkey % 70, 1) as expected from customer), b as (select run, expected, coalesce(evaluated, 0) as evaluated, coalesce(explicit, 0) as explicit, coalesce(violations, 0) as violations, coalesce(others_allowed, 0) as others_allowed from x left join w using (run))
    select *, greatest(expected - evaluated, 0) as unevaluated, round(explicit / greatest(expected, evaluated), 3) as evidence_rate, case when evaluated > 0 then round(violations / evaluated, 3) else 0 end as violation_rate,
    case when violations > 0 then 'hard_block' when explicit < evaluated or expected > evaluated then 'inconclusive' else 'pass' end as status from b""")
def q101_policy_rollup(spark, d):
    e_id = F.col("event_id")
    bad = (F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)
    w = events(spark, d).select(F.col("user_id").alias("run"), F.when(e_id % 7 > 0, F.when(bad, "review_required").otherwise("allowed")).alias("decision"), (e_id % 4 == 0).alias("others_allowed"))
    k = F.col("c_custkey")
    expected = table(spark, d, "customer").select(k.alias("run"), F.when(k % 2 == 0, k % 90).alias("traced"), (k % 70).alias("drafts"), F.lit(1).cast("long").alias("reported"))
    return reports.policy_rollup(w, "run", expected)


@query("""with l as (select user_id as run, event_id as place, case event_id % 6 when 0 then 'uploaded ' || event_id % 8 || ' drafts' when 1 then 'defect BAD_CROP and CUT_TOO_EARLY' when 2 then 'uploading FLAGGED draft' when 3 then 'name QA-FLAGGED x' when 4 then 'QA still failing' else 'WRONG_ATHLETE seen' end as line from events),
    g as (select run, 2 * count(*) filter (place % 6 = 1) + count(*) filter (place % 6 = 5) as defects, count(*) filter (place % 6 = 5) as critical, count(*) filter (place % 6 = 4) as still_failing, greatest(count(*) filter (place % 6 = 3), count(*) filter (place % 6 = 2)) as flagged, coalesce(arg_max(place % 8, place) filter (place % 6 = 0), 0) as uploaded from l group by 1)
    select run, defects, critical, still_failing, cast(uploaded as int) as uploaded, coalesce(c_custkey % 9, 0) as draft_count, flagged, greatest(uploaded - flagged, 0) as unflagged, critical > 0 and uploaded > flagged as bypass,
    case when uploaded > 0 and coalesce(c_custkey % 9, 0) > 0 then abs(uploaded - c_custkey % 9) else 0 end as mismatch from g left join customer on c_custkey = run""")
def q102_qa_log(spark, d):
    e_id = F.col("event_id")
    line = F.when(e_id % 6 == 0, F.concat(F.lit("uploaded "), (e_id % 8).cast("string"), F.lit(" drafts"))).when(e_id % 6 == 1, "defect BAD_CROP and CUT_TOO_EARLY").when(e_id % 6 == 2, "uploading FLAGGED draft").when(e_id % 6 == 3, "name QA-FLAGGED x").when(e_id % 6 == 4, "QA still failing").otherwise("WRONG_ATHLETE seen")
    drafts = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), (F.col("c_custkey") % 9).alias("draft_count"))
    return reports.qa_log(events(spark, d).select(F.col("user_id").alias("run"), e_id.alias("place"), line.alias("line")), "run", drafts, critical=["WRONG_ATHLETE"])


@query("""with d as (select o_orderkey as draft, o_custkey % 50 as run, case o_orderkey % 4 when 0 then 'pass' when 1 then 'blocked' when 2 then 'odd' end as decision, o_orderkey % 4 = 1 or o_orderkey % 8 = 2 as blocked, cast(o_orderkey % 3 as int) as critical, case when o_orderkey % 5 > 0 then cast(o_orderkey % 4 as int) end as retries, o_orderkey % 6 = 0 as multi from orders),
    w as (select l_orderkey as draft, count(*) filter (l_quantity > 45) as marked from lineitem group by 1), j as (select d.*, case when coalesce(marked, 0) = 0 and multi then 1 else coalesce(marked, 0) end as marked from d left join w using (draft))
    select run, count(*) as drafts, count(*) filter (blocked) as blocked, count(*) filter (decision in ('pass', 'blocked')) as explicit, sum(critical)::bigint as blocking_defects, coalesce(sum(retries), 0)::bigint as retries, sum(marked)::bigint as marked, coalesce(sum(marked) filter (blocked), 0)::bigint as marked_blocked,
    coalesce(sum(marked) filter (not blocked), 0)::bigint as marked_open, bool_and(coalesce(decision in ('pass', 'blocked'), false) or (blocked and critical > 0)) as policy_explicit from j group by 1""")
def q103_qa_trace(spark, d):
    k = F.col("o_orderkey")
    drafts = table(spark, d, "orders").select(
        k.alias("draft"), (F.col("o_custkey") % 50).alias("run"), F.when(k % 4 == 0, "pass").when(k % 4 == 1, "blocked").when(k % 4 == 2, "odd").alias("decision"), ((k % 4 == 1) | (k % 8 == 2)).alias("blocked"), (k % 3).cast("int").alias("critical"),
        F.when(k % 5 > 0, (k % 4).cast("int")).alias("retries"), (k % 6 == 0).alias("multi_person"),
    )
    windows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft"), (F.col("l_quantity") > 45).alias("review_required"))
    return reports.qa_trace(drafts, windows, "run", ["pass", "blocked"])


@query("""with p as (select l_orderkey as session, case when l_linenumber % 6 = 5 then ' ' else 'p' || l_suppkey % 9 end as person, l_quantity - 2 as s, case when l_discount > 0.09 then null else l_quantity + l_tax * 100 - 3 end as e, cast(l_partkey % 12 as int) as score, case when l_returnflag = 'R' and l_linenumber = 3 then '' else 'ride' end as kind from lineitem)
    select session, 'person_without_id' as rule, count(*) as n from p where trim(person) = '' group by 1 union all select session, 'duplicate_person_id', count(*) from (select session, person from p where trim(person) <> '' group by 1, 2 having count(*) > 1) group by 1
    union all select session, 'invalid_time_window', count(*) from p where not coalesce(s >= 0 and e > s, false) group by 1 union all select session, 'score_outside_1_to_10', count(*) from p where not score between 1 and 10 group by 1 union all select session, 'missing_type', count(*) from p where kind = '' group by 1""")
def q104_session_violations(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as session", "case when l_linenumber % 6 = 5 then ' ' else concat('p', l_suppkey % 9) end as person", "l_quantity - 2 as start", "case when l_discount > 0.09 then null else l_quantity + l_tax * 100 - 3 end as end", "cast(l_partkey % 12 as int) as score",
        "case when l_returnflag = 'R' and l_linenumber = 3 then '' else 'ride' end as event_type",
    )
    return reports.session_violations(rows, rows, "session")


_UPLOADS = """u as (select o_orderkey as upload_id, ['uploading', 'paused', 'verified', 'completing', 'superseded', 'aborted'][o_orderkey % 6 + 1] as state, o_orderkey % 5 as wanted, o_orderkey % 7 > 0 as multi, o_orderkey % 11 > 0 as session from orders),
p as (select l_orderkey as upload_id, count(*) as n, sum(cast(l_quantity as bigint)) as b from lineitem group by 1)"""


def upload_rows(spark, d):
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*(F.lit(x) for x in ("uploading", "paused", "verified", "completing", "superseded", "aborted"))), (k % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("upload_id"), state.alias("state"), F.when(k % 7 > 0, "multipart").otherwise("single_put").alias("protocol"), F.when(k % 11 > 0, "s").alias("session"), (k % 5).alias("expected_parts"), F.lit(0).cast("long").alias("completed_parts"),
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("aborted_at"), (k % 2 == 0).alias("cleanup_required"), F.lit("pending").alias("cleanup"), F.lit(None).cast("string").alias("cleanup_error"),
    )


@query(f"""with {_UPLOADS}, j as (select u.*, coalesce(n, 0) as n, coalesce(b, 0) as b, case when upload_id % 13 = 0 then 1 else coalesce(b, 0) end as size from u left join p using (upload_id)),
    w as (select *, case when not multi or not session then 'no_multipart_session' when state not in ('uploading', 'paused', 'completing') then 'wrong_state' when n <> wanted then 'parts_missing' when b <> size then 'byte_total_differs' end as why from j)
    select upload_id, case when why is null then 'completing' else state end as state, case when why is null then n else 0 end as completed_parts, why as reason from w""")
def q105_begin_completion(spark, d):
    u, parts = upload_rows(spark, d), table(spark, d, "lineitem").selectExpr("l_orderkey as upload_id", "cast(l_quantity as long) as size")
    sizes = parts.groupBy(F.col("upload_id").alias("_i")).agg(F.sum("size").alias("_s"))
    u = u.join(sizes, F.col("upload_id") == F.col("_i"), "left").withColumn("size", F.when(F.col("upload_id") % 13 == 0, 1).otherwise(F.coalesce("_s", F.lit(0)))).drop("_i", "_s")
    new, rejects = states.begin_completion(u, u.select("upload_id", F.lit(1).alias("seq")), parts)
    return new.select("upload_id", "state", "completed_parts").join(rejects.select("upload_id", "reason"), "upload_id", "left")


@query(f"""with {_UPLOADS} select upload_id, case when state in ('verified', 'superseded', 'aborted') then state when state = 'completing' then 'uploading' else state end as failed_state, case when state not in ('verified', 'superseded', 'aborted') then coalesce(case when upload_id % 2 = 0 then 'broken' end, 'multipart operation failed') end as last_error,
    case when state in ('verified', 'superseded') then state else 'aborted' end as aborted_state, case when upload_id % 4 = 0 then 'pending' when upload_id % 4 = 1 then case when state = 'verified' then 'confirmed' else 'pending' end when upload_id % 4 = 2 then 'pending' else 'not_required' end as cleanup,
    case when upload_id % 4 = 0 then 'error_missing' when upload_id % 4 = 1 and state <> 'verified' then 'not_verified' when upload_id % 4 = 2 then 'cleanup_is_required' end as cleanup_reason from u""")
def q106_upload_failures(spark, d):
    u = upload_rows(spark, d)
    k = F.col("upload_id")
    command = u.select(k, F.lit(1).alias("seq"), F.when(k % 2 == 0, "broken").alias("error"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    cleanup = u.select(k, F.lit(1).alias("seq"), F.when(k % 4 == 0, "failed").when(k % 4 == 1, " Confirmed").otherwise("not_required").alias("status"), F.lit(" ").alias("error"))
    failed = states.recoverable_error(u, command)[0].select("upload_id", F.col("state").alias("failed_state"), "last_error")
    gone = states.aborted(u, command)[0].select("upload_id", F.col("state").alias("aborted_state"))
    told, rejects = states.local_cleanup(u, cleanup)
    return failed.join(gone, "upload_id").join(told.select("upload_id", "cleanup"), "upload_id").join(rejects.select("upload_id", F.col("reason").alias("cleanup_reason")), "upload_id", "left")


@query("""select o_custkey as owner, case when count(*) filter (f) = 1 then min(o_orderkey) filter (f) end as batch_id, case when count(*) filter (f) = 0 then 'none_active' when count(*) filter (f) > 1 then 'several_active' end as reason from (select *, o_orderstatus in ('O', 'P') and o_orderkey % 3 > 0 as f from orders) group by 1""")
def q107_only_active_batch(spark, d):
    k = F.col("o_orderkey")
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), k.alias("batch_id"), F.col("o_orderstatus").alias("state"), F.when(k % 3 == 0, "taken").alias("run_id"))
    return states.only_active(b, ["O", "P"], ["owner"])


@query("""with b as (select o_orderkey as batch_id, o_orderkey % 900 as expected, 'web' as kind from orders where o_orderstatus <> 'F'), c as (select l_orderkey as batch_id, sum(l_suppkey * 3) as add, count(distinct l_linestatus) as kinds, min(l_linestatus) as kind from lineitem group by 1),
    j as (select batch_id, coalesce(expected, 0) + coalesce(add, 0) as total, expected, add, kinds, b.kind as was, c.kind as now from b full outer join c using (batch_id))
    select batch_id, cast(case when total <= 1000 then total else expected end as bigint) as expected, case when total > 1000 then was when add is null then was when kinds > 1 or was <> now then 'mixed' else now end as kind, case when total > 1000 then 'too_many_uploads' end as reason from j""")
def q108_register_batches(spark, d):
    batches = table(spark, d, "orders").where("o_orderstatus <> 'F'").selectExpr("o_orderkey as batch_id", "o_orderkey % 900 as expected", "'web' as kind")
    commands = table(spark, d, "lineitem").selectExpr("l_orderkey as batch_id", "l_suppkey * 3 as add", "l_linestatus as kind")
    new, rejects = states.register_batches(batches, commands)
    return new.join(rejects, "batch_id", "full_outer").select("batch_id", "expected", "kind", "reason")


@query("""select case when o_orderkey % 5 = 0 then 'r' else 'w' end as side, o_orderkey as batch_id, 'batch_' || o_orderpriority as reason from orders where o_orderpriority <> '1-URGENT' and o_orderkey % 5 = 0 union all select 'w', o_orderkey, 'running' from orders where o_orderpriority = '1-URGENT' and o_orderkey % 5 > 0
    union all select 'r', o_orderkey, 'running' from orders where o_orderpriority = '1-URGENT' and o_orderkey % 5 = 0 union all select 'w', o_orderkey, 'batch_' || o_orderpriority from orders where o_orderpriority <> '1-URGENT' and o_orderkey % 5 > 0""")
def q109_batches_run(spark, d):
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "ready").otherwise(F.col("o_orderpriority")).alias("state"))
    ready, rejected = states.ready_or_rejected(b)
    side = F.when(F.col("batch_id") % 5 == 0, "r").otherwise("w").alias("side")
    return ready.select(side, "batch_id", F.col("state").alias("reason")).unionByName(rejected.select(side, "batch_id", "reason"))


@query("""with o as (select o_orderkey as k, o_orderkey % 6 as n from orders), u as (select l_orderkey as k, count(distinct l_partkey % 50) as m from lineitem group by 1), f as (select l_suppkey as key, count(*) as failures from lineitem where l_quantity > 40 group by 1)
    select 'surplus' as what, k as id, cast(greatest(coalesce(m, 0) - n, 0) as bigint) as n from o left join u using (k) union all select 'blocked', key, failures from f where failures >= 30""")
def q110_surplus_and_blocked(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey as batch_id", "o_orderkey % 6 as expected")
    lines = table(spark, d, "lineitem")
    surplus = states.membership(o, lines.selectExpr("l_orderkey as batch_id", "l_partkey % 50 as upload_id"))
    blocked = states.blocked_ids(lines.where("l_quantity > 40"), "l_suppkey", 30)
    return surplus.selectExpr("'surplus' as what", "batch_id as id", "surplus as n").unionByName(blocked.selectExpr("'blocked' as what", "l_suppkey as id", "failures as n"))


@query("""with t as (select o_custkey as draft_id, o_orderstatus as state from orders where o_orderpriority in ('1-URGENT', '2-HIGH')), b as (select distinct c_custkey as draft_id from customer where c_acctbal < 3000)
    select draft_id, case state when 'F' then 'done' when 'O' then 'pending' else 'running' end as state, count(*) as n from t group by 1, 2 union all select draft_id, 'pending (new)', 1 from b where draft_id not in (select draft_id from t where state <> 'F')""")
def q111_reedit_tasks(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    tasks = table(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_custkey").alias("draft_id"), state.alias("state"), F.lit("old").alias("reason"))
    blocked = table(spark, d, "customer").where("c_acctbal < 3000").select(F.col("c_custkey").alias("draft_id"), F.lit("qa").alias("reason"))
    out = states.reedit_tasks(tasks, blocked).withColumn("state", F.when(F.col("reason") == "qa", "pending (new)").otherwise(F.col("state")))
    return out.groupBy("draft_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, case when user_id % 9 = 0 then 'no_input' when event_id % 7 = 0 then 'failed' when event_id % 4 = 0 then 'no_reviewable_drafts' else 'succeeded' end as status, case when event_id % 3 = 0 and event_type = 'view' then ts + interval 7 days when event_id % 3 > 0 then timestamp '2024-06-01' end as expires, case when event_type = 'click' then timestamp '2024-03-01' else ts end as updated_at from events""")
def q112_run_and_row_times(spark, d):
    e_id = F.col("event_id")
    e = events(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withColumns({"inputs": F.col("user_id") % 9, "exit_code": F.when(e_id % 7 == 0, 1).otherwise(0), "reviewable": e_id % 4, "expires": F.when(e_id % 3 > 0, F.lit("2024-06-01").cast("timestamp")), "updated_at": F.col("ts").cast("timestamp")})
    e = states.touched(states.expiries(states.terminal_status(e), F.col("event_type") == "view", "at", "expires"), F.col("event_type") == "click", F.lit("2024-03-01").cast("timestamp"))
    return e.select("event_id", "status", F.col("expires").cast("timestamp_ntz").alias("expires"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""with p as (select l_orderkey, l_linenumber, 'f' || l_partkey as path, l_tax > 0.07 as issue from lineitem), e as (select 'f' || p_partkey as path, p_size > 20 as pass, p_size % 3 as critical from part where p_brand < 'Brand#2')
    select l_orderkey, l_linenumber, e.path is not null as qa_recorded, case when e.path is not null then pass and critical = 0 end as qa_passed, coalesce(pass and critical = 0, false) and not issue as publishable from p left join e using (path)""")
def q113_qa_evidence(spark, d):
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path"), F.when(F.col("l_tax") > 0.07, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("technical_issues"))
    evidence = table(spark, d, "part").where("p_brand < 'Brand#2'").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_size") > 20, "PASS").otherwise("FAIL").alias("verdict"), (F.col("p_size") % 3).alias("critical"))
    return states.qa_applied(parts, evidence).select("l_orderkey", "l_linenumber", "qa_recorded", "qa_passed", "publishable")


@query("""with c as (select o_custkey as k, o_orderkey % 5 as parts, o_orderkey % 4 as up, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderpriority = '1-URGENT'), a as (select c_custkey as k, 2 as parts, 2 as up from customer)
    select coalesce(c.k, a.k) as athlete_key, coalesce(c.parts, a.parts) as parts, coalesce(c.up, a.up) as uploaded, coalesce(c.parts, a.parts) > 0 and coalesce(c.parts, a.parts) = coalesce(c.up, a.up) as publishable from (select * from c where r = 1) c full outer join a on c.k = a.k""")
def q114_manifest_upserts(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey as athlete_key", "2L as parts", "2L as uploaded", "named_struct('d', timestamp_ntz '1990-01-01', 'k', 0L) as revision")
    new = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as athlete_key", "o_orderkey % 5 as parts", "o_orderkey % 4 as uploaded", "named_struct('d', cast(o_orderdate as timestamp_ntz), 'k', o_orderkey) as revision")
    return states.manifest_upserts(old, new).drop("revision")


@query("""select l_orderkey as upload_id, l_linenumber as part, cast(l_quantity as bigint) as size from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc) as r from lineitem) where r = 1""")
def q115_parts_recorded(spark, d):
    line = table(spark, d, "lineitem").selectExpr("l_orderkey as upload_id", "l_linenumber as part", "cast(l_quantity as long) as size", "struct(l_partkey, l_suppkey, l_quantity) as seq")
    return states.record_parts(line.limit(0).drop("seq"), line)


@query(f"""with {_MOMENTS}, r as (select *, "end" - start as len from (select ordinal, source, score, start % 1000 as start, start % 1000 + 3 + ordinal % 20 as "end" from m)) select ordinal, start, greatest("end", start + 6) as "end" from r where len >= 5""")
def q116_padded(spark, d):
    m = moments(spark, d).withColumn("start", F.col("start") % 1000).withColumn("end", F.col("start") + 3 + F.col("ordinal") % 20)
    return sessions.padded(m, 5, 6).select("ordinal", "start", F.col("end").cast("long").alias("end"))


@query("""select event_id, case when event_id % 2 = 0 and event_id % 3 > 0 then event_id + 1 else event_id end as start, case when event_id % 2 = 0 and event_id % 3 > 0 then event_id + 9 else event_id + 20 end as "end", greatest(event_id, event_id + 20 - case when event_id % 5 = 0 then 15 else 11 end) as cut_start,
    case when event_id % 4 > 0 then event_id + greatest(20 - event_id % 25, 0) else event_id end as cap_start, case when event_id % 4 > 0 then event_id + 20 else event_id + least(20, event_id % 25) end as cap_end from events""")
def q117_cut_windows(spark, d):
    e_id = F.col("event_id")
    final = [F.when(e_id % 2 == 0, e_id + 1), F.when(e_id % 3 > 0, e_id + 9)]
    w = sessions.effective(final, [e_id, e_id + 20])
    cut = intervals.effective_cut(e_id, e_id + 20, e_id % 5 == 0, F.lit(None))
    cap = intervals.capped(e_id, e_id + 20, (e_id % 25).cast("double"), e_id % 4 > 0)
    whole = lambda c: c.cast("long")
    return events(spark, d).select("event_id", w["start"].alias("start"), w["end"].alias("end"), whole(cut["start"]).alias("cut_start"), whole(cap["start"]).alias("cap_start"), whole(cap["end"]).alias("cap_end"))


_RIDES = """list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda y: least(x[1].e, y.e) - greatest(x[1].s, y.s) > {} * least(x[1].e - x[1].s, y.e - y.s))) > 0 then acc else list_concat(acc, x) end)"""


@query(f"""with {_MOMENTS}, s as (select ordinal, source, score, start, least(start + 100 + ordinal % 300, 1705500000) as "end" from m), f as (select * from s where "end" - start >= 4),
    g as (select source, list({{'o': ordinal, 's': start, 'e': "end"}} order by -score, ordinal) as rows from f group by 1), k as (select {_RIDES.format('0.4')} as kept from g), u as (select unnest(kept, recursive := true) from k)
    select f.ordinal, u.o is not null as kept from f left join u on f.ordinal = u.o""")
def q118_editor_dedup(spark, d):
    m = moments(spark, d).withColumn("end", F.col("start") + 100 + F.col("ordinal") % 300)
    return greedy.editor_dedup(m, m.select("source").distinct().withColumn("source_duration", F.lit(1_705_500_000))).select("ordinal", "kept")


@query(f"""with {_MOMENTS}, s as (select ordinal, source, score, start, start + 100 + ordinal % 300 as "end" from m),
    g as (select source, list({{'o': ordinal, 's': start, 'e': "end"}} order by -score, start - "end", ordinal) as rows from s group by 1), k as (select {_RIDES.format('0.35')} as kept from g), u as (select unnest(kept, recursive := true) from k)
    select s.ordinal, u.o is not null as kept from s left join u on s.ordinal = u.o""")
def q119_render_dedup(spark, d):
    m = moments(spark, d).withColumn("end", F.col("start") + 100 + F.col("ordinal") % 300)
    return greedy.render_dedup(m).select("ordinal", "kept")


@query(f"""with {_MOMENTS}, g as (select person, list({{'o': ordinal, 'p': 0, 't': 20 + score * 12}} order by score desc, ordinal) as rows from m group by 1),
    k as (select person, list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: list_concat(acc, [case when acc[-1].t + x[1].t - 1 <= 340 then {{'o': x[1].o, 'p': acc[-1].p, 't': acc[-1].t + x[1].t - 1}} else {{'o': x[1].o, 'p': acc[-1].p + 1, 't': x[1].t}} end])) as r from g), f as (select unnest(r, recursive := true) from k)
    select o as ordinal, cast(p as int) as part from f""")
def q120_scored_parts(spark, d):
    shared_checkpoints(spark)
    m = moments(spark, d).withColumn("end", F.col("start") + 5 + F.col("score") * 3)
    return sequential.scored_parts(m, "person").select("ordinal", "part")


@query(f"""with {_MOMENTS}, r as (select ordinal, score, row_number() over (partition by person order by ordinal) as k, count(*) over (partition by person) as n, ordinal % 5 = 0 as slow, ordinal % 9 = 0 as blocking, ordinal % 10 = 1 as teaser, person, start, "end" from m),
    b as (select *, count(*) filter (not teaser) over (partition by person) as real, count(*) filter (blocking and not teaser) over (partition by person order by ordinal) as falling from r)
    select ordinal, slow and k = n and score >= 8 as single_slow, not blocking or (not teaser and falling = real) as kept from b""")
def q121_slow_and_dropped(spark, d):
    o = F.col("ordinal")
    m = moments(spark, d).withColumns({"slow": o % 5 == 0, "blocking": o % 9 == 0, "teaser": o % 10 == 1})
    m = timeline.single_slow(m, "person", "ordinal")
    return sequential.dropped_by_defects(m, "person").select("ordinal", F.col("slow_final").alias("single_slow"), "kept")


@query("""with c as (select l_orderkey as cluster, l_linenumber % 3 as clip, l_suppkey % 4 as n from lineitem), x as (select cluster, count(*) > count(distinct clip) or count(distinct case when n > 0 then n end) > 1 as bad from c group by 1)
    select l_orderkey as cluster, l_linenumber as line, case when bad then 'single_' || (l_orderkey * 10 + l_linenumber) else 'group_' || l_orderkey end as final_cluster, l_partkey from lineitem join x on cluster = l_orderkey""")
def q122_split_conflicts(spark, d):
    n = F.col("l_suppkey") % 4
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 3).alias("clip"), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<long>")).alias("numbers"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ident"), "l_partkey")
    return identity.split_conflicts(m, "cluster", "clip", "numbers", "ident").select("cluster", "line", "final_cluster", "l_partkey")


@query("""with p as (select p_partkey as k, case when p_partkey % 10 > 0 then p_name end as description, list_sort(list_distinct([p_size % 6, p_partkey % 5])) as clips from part), g as (select description, list({'k': k, 'c': clips} order by k) as rows from p where description is not null group by 1),
    f as (select list_reduce(list_transform(rows, lambda x: {'held': x.c, 'took': [x.k], 'first': x.k}), lambda acc, x: case when len(list_intersect(acc.held, x.held)) = 0 then {'held': list_concat(acc.held, x.held), 'took': list_concat(acc.took, x.took), 'first': acc.first} else acc end) as s from g), t as (select unnest(s.took) as k, s.first as f from f)
    select p.k as cluster, coalesce(t.f, p.k) as merged_into from p left join t using (k)""")
def q123_merged_descriptions(spark, d):
    shared_checkpoints(spark)
    p = table(spark, d, "part")
    clusters = p.select(F.col("p_partkey").alias("cluster"), F.when(F.col("p_partkey") % 10 > 0, F.col("p_name")).otherwise("").alias("description"))
    members = p.select(F.col("p_partkey").alias("cluster"), (F.col("p_size") % 6).cast("long").alias("clip")).unionByName(p.select(F.col("p_partkey").alias("cluster"), (F.col("p_partkey") % 5).alias("clip")))
    return identity.merge_by_description(clusters, members)


@query("""select o_orderkey as k, o_orderkey % 4 = 0 and o_orderkey % 3 = 0 as empty, o_orderstatus = 'O' and o_orderkey % 5 > 0 and o_orderpriority <> '5-LOW' and o_orderkey % 7 > 0 as publishable from orders""")
def q124_manifest_and_authority(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("k"), (k % 2 == 0).alias("readable"), (k % 4).alias("rows"), (k % 3).alias("summary_count"), "o_orderstatus", "o_orderpriority")
    granted = policies.publishable(F.lit(3), F.when(F.col("k") % 5 > 0, 3), F.col("o_orderstatus") == "O", F.when(F.col("k") % 7 == 0, True), F.col("o_orderpriority") != "5-LOW")
    return o.withColumn("publishable", granted).join(lookups.empty_manifest(o, "k"), "k").select("k", "empty", "publishable")


@query("""with r as (select event_type as g, event_id, user_id % 10 as s, row_number() over (partition by event_type order by user_id % 10 desc, event_id) as k from events) select g, min(s) as least_score, count(*) as n from r where k <= 3 group by 1""")
def q125_best_of_three(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("g"), "event_id", (F.col("user_id") % 10).alias("s"))
    best = timeline.top(e, ["g"], [F.desc("s"), F.asc("event_id")], 3)
    picked = lookups.best_music(e, ["g"], "s", "event_id")
    return best.join(picked.select("g", F.col("event_id").alias("picked")), "g").groupBy("g").agg(F.min("s").alias("least_score"), F.count_if(F.lit(True)).alias("n"), F.bool_or(F.col("event_id") == F.col("picked")).alias("ok")).where("ok").drop("ok")


@query("""select event_type as g, user_id % 5 as k, string_agg(s || '=' || n, ',' order by s) as counts from (select event_type, user_id, event_id % 4 as s, count(*) over (partition by event_type, user_id % 5, event_id % 4) as n, row_number() over (partition by event_type, user_id % 5, event_id % 4 order by event_id) as r from events) where r = 1 group by 1, 2""")
def q126_counts_by(spark, d):
    e_id = F.col("event_id")
    e = events(spark, d).select(F.col("event_type").alias("g"), (F.col("user_id") % 5).alias("k"), (e_id % 4).cast("string").alias("s"))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return reports.counts_by(e, ["g", "k"], "s").select("g", "k", flat.alias("counts"))


@query(f"""with {_DETECTIONS} select point_id, cast(round_even((x1 + x2) / 2.0 / 1920 * 20, 0) as int) as bx, cast(round_even((y1 + y2) / 2.0 / 1080 * 20, 0) as int) as by_, case when x2 * 16 > y2 * 9 then cast(floor(1000 * (y2 * 9.0) / (x2 * 16)) as bigint) else 1000 end as crop_width, (x2 > x1 + 150 and confidence >= 30 and (track % 3 > 0 or track % 2 = 0)) as evidence from d""")
def q127_boxes(spark, d):
    p = detections(spark, d)
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    at = geometry.centre_bucket(box, F.lit(1920), F.lit(1080))
    crop = geometry.base_crop(F.col("x2"), F.col("y2"))
    tracks = F.when(F.col("track") % 3 > 0, F.array(F.col("track"))).otherwise(F.array(F.col("track") * F.when(F.col("track") % 2 == 0, 1).otherwise(-1) - F.when(F.col("track") % 2 == 0, 0).otherwise(1), F.lit(-99).cast("long")))
    ok = scores.required_evidence(F.col("x2") > F.col("x1") + 150, F.col("confidence") / 100 + 0.05, F.col("track"), tracks)
    return p.select("point_id", at["x"].alias("bx"), at["y"].alias("by_"), F.floor(crop["width"] * 1000).cast("long").alias("crop_width"), ok.alias("evidence"))


@query("""with o as (select o_orderkey as k, o_orderkey % 5 as attempts from orders), r as (select o_orderkey as k, o_orderstatus = 'O' as ok from orders where o_orderpriority <> '5-LOW')
    select k, attempts + case when ok = false then 1 else 0 end as attempts from o left join r using (k) where not coalesce(ok, false) and attempts + case when ok = false then 1 else 0 end < 5""")
def q128_retry_queue(spark, d):
    o = table(spark, d, "orders")
    return sinks.retry_queue(o.selectExpr("o_orderkey as key", "o_orderkey % 5 as attempts"), o.where("o_orderpriority <> '5-LOW'").selectExpr("o_orderkey as key", "o_orderstatus = 'O' as ok")).withColumnRenamed("key", "k")


@query("""with s as (select c_custkey as k, c_name as v from customer), n as (select o_custkey as k, min(o_orderpriority) as v from orders group by 1)
    select k, v from s union all select k + 100000, v from n union all select k, v from n where k not in (select k from s)""")
def q129_seed_and_moved(spark, d):
    s = table(spark, d, "customer").selectExpr("c_custkey as k", "c_name as v")
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("v"))
    seeded = sinks.insert_missing(s, n, ["k"])
    moved = sinks.moved_keys(n.select(F.concat(F.lit("a/"), F.col("k").cast("string")).alias("key"), "v"), "key", "a/", "b/")
    back = moved.select((F.substring("key", 3, 20).cast("long") + 100000).alias("k"), "v")
    return seeded.unionByName(back)


@query(f"""with {_MOMENTS}, s as (select ordinal, source, person, start, start + ordinal % 40 as "end", substr('note ' || source || ' x', 1, 120) as note, ordinal % 3 = 0 as more from m)
    select ordinal, case when more then 25 else 0 end as extension, more as extended, case when more and "end" + 25 - start > 30 then "end" + 25 - 30 else start end as start from s""")
def q130_extended(spark, d):
    m = moments(spark, d).withColumns({"end": F.col("start") + F.col("ordinal") % 40, "description": F.concat(F.lit("note "), "source", F.lit(" x "), F.col("ordinal").cast("string")), "event_type": F.col("person").cast("string")})
    after = m.withColumn("end", F.col("end") + F.when(F.col("ordinal") % 3 == 0, 25).otherwise(0))
    return policies.extended(after, m).select("ordinal", F.col("extension").cast("int").alias("extension"), "extended", F.col("start").cast("long").alias("start"))


@query("""select event_id, 'p' || user_id as person, case when event_id % 3 > 0 then 'ride' else 'highlight' end as kind, cast(event_id % 50 as double) as start, cast(case when event_id % 4 > 0 then event_id % 50 + 7 else event_id % 50 + 10 end as double) as "end", cast(greatest(1, least(10, event_id % 14)) as int) as score,
    cast(greatest(1, least(2, event_id % 4)) as double) as zoom, case when event_id % 2 = 0 then 'fade' else 'slide' end as transition from events where event_id % 11 > 0 and event_id % 13 > 0""")
def q131_reply_events(spark, d):
    e_id = F.col("event_id")
    e = e_id.cast("string")
    kind = F.when(e_id % 3 > 0, '"type": "ride", ').otherwise("")
    end = F.when(e_id % 4 > 0, F.concat(F.lit('"end": '), (e_id % 50 + 7).cast("string"), F.lit(", "))).otherwise(F.lit(""))
    start = F.when(e_id % 13 > 0, (e_id % 50).cast("string")).otherwise('"soon"')
    edit = F.concat(F.lit('"edit": {"zoom": '), (e_id % 4).cast("string"), F.lit(', "transition_out": "'), F.when(e_id % 2 == 0, "Fade").otherwise("swirl"), F.lit('"}'))
    one = F.concat(F.lit("{"), kind, F.lit('"start": '), start, F.lit(", "), end, F.lit('"score": '), (e_id % 14).cast("string"), F.lit(", "), edit, F.lit("}"))
    raw = F.concat(F.lit('```json\n{"activity": "surf", "persons": [{"id": "p'), F.col("user_id").cast("string"), F.lit('", "events": ['), one, F.lit("]}]}\n```"))
    replies = events(spark, d).select("event_id", F.when(e_id % 11 > 0, raw).otherwise(F.concat(F.lit("no reply "), e)).alias("raw"))
    return sessions.events_of(replies)[0].select("event_id", "person", F.col("event_type").alias("kind"), "start", "end", "score", "zoom", "transition")


@query("""with x as (select event_id, event_id % 3 as k, 5 + event_id % 466 + case when event_id % 2 = 0 then 480 * (event_id % 3) else 0 end as s, event_id % 60 as n from events)
    select event_id, case when k = 0 or event_id % 2 = 1 then 'chunk_local' else 'source_global' end as basis, cast(480 * k + 5 + event_id % 466 as double) as start, cast(480 * k + least(480, 5 + event_id % 466 + 10 + n) as double) as "end", 5 + event_id % 466 + 10 + n > 480 as clamped, 'chunk_' || lpad(cast(k as varchar), 2, '0') || ':A' as person from x""")
def q132_on_source_time(spark, d):
    e_id = F.col("event_id")
    k, local = e_id % 3, 5 + e_id % 466
    shift = F.when(e_id % 2 == 0, 480 * k).otherwise(0)
    e = events(spark, d).select("event_id", F.lit("v").alias("source"), k.alias("chunk_index"), F.lit("A").alias("person"), (local + shift).cast("double").alias("start"), (local + shift + 10 + e_id % 60).cast("double").alias("end"))
    chunks = timeline.chunk_specs(spark.createDataFrame([("v", 1440.0)], "source string, seconds double"), "source", "seconds", 480.0)
    return sessions.on_source_time(e, chunks)[0].select("event_id", "basis", "start", "end", "clamped", "person")


@query("""with w as (select user_id as k, list({'i': event_id, 'e': event_id * 7 % 1000} order by event_id) as ws from events where value >= 30 group by 1), o as (select user_id as k, list({'i': event_id, 'e': event_id * 11 % 1000} order by event_id) as os from events where not value >= 30 group by 1),
    s as (select list_concat([{'w': {'i': cast(null as bigint), 'e': cast(null as bigint)}, 'free': os, 'out': cast([] as struct(w bigint, o bigint)[])}], list_transform(ws, lambda x: {'w': x, 'free': os, 'out': cast([] as struct(w bigint, o bigint)[])})) as rows from w join o using (k)),
    f as (select list_reduce(rows, lambda acc, x: case when len(acc.free) = 0 then acc else {'w': x.w, 'free': list_filter(acc.free, lambda y: y.i <> list_sort(list_transform(acc.free, lambda z: {'d': abs(z.e - x.w.e), 'i': z.i}))[1].i),
        'out': list_append(acc.out, {'w': x.w.i, 'o': list_sort(list_transform(acc.free, lambda z: {'d': abs(z.e - x.w.e), 'i': z.i}))[1].i})} end).out as out from s), u as (select unnest(out) as p from f) select p.w as wanted_id, p.o as offer_id from u""")
def q133_consuming_matches(spark, d):
    e_id = F.col("event_id")
    e = events(spark, d).select(F.col("user_id").alias("k"), "event_id", "value")
    wanted = e.where("value >= 30").select("k", F.col("event_id").alias("wanted_id"), (e_id * 7 % 1000).alias("end"))
    offered = e.where("not value >= 30").select("k", F.col("event_id").alias("offer_id"), (e_id * 11 % 1000).alias("end"))
    return sequential.consuming_matches(wanted, offered, ["k"])


@query(f"""with {_MOMENTS}, t as (select person, ordinal, start, "end", false as teaser from m), l as (select person, ordinal, cast(start as double) as start, cast("end" as double) as "end", row_number() over (partition by person order by ordinal desc) as r, count(*) over (partition by person) as n from m),
    x as (select *, case when n > 1 then greatest(start, least(start + ("end" - start) * 0.65 - 1.25, "end" - 2.5)) else start + least("end" - start, 15) - 2.5 end as s from l where r = 1 and "end" - start > 4.5)
    select person, ordinal, cast(start as double) as start, cast("end" as double) as "end", teaser from t union all select person, ordinal, s, s + 2.5, true from x""")
def q134_teasers(spark, d):
    m = moments(spark, d).withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double"), "place": F.col("ordinal")})
    return timeline.teasers(m, "person").select("person", "ordinal", "start", "end", "teaser")


@query("""with f as (select l_orderkey as g, l_linenumber * 1000000 + l_partkey as n, 'f' || l_partkey as file, case when l_suppkey % 3 = 0 then null else l_suppkey % 3 = 1 end as audio, l_quantity > 40 as bad from lineitem),
    a as (select g, arg_min(file, n) filter (audio = false and not bad) as file, bool_and(coalesce(audio, false)) as loud, bool_and(audio is null) as unknown from f group by 1) select g as "group", file, case when file is not null then null when unknown then 'audio_unknown' when loud then 'no_silent_variant' else 'technical_issues' end as failure from a""")
def q135_silent_variants(spark, d):
    s = F.col("l_suppkey") % 3
    f = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("group"), F.struct("l_linenumber", "l_partkey").alias("ordinal"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file"), F.when(s == 1, True).when(s == 2, False).alias("has_audio"),
        F.when(F.col("l_quantity") > 40, F.array(F.lit("dark"))).otherwise(F.array().cast("array<string>")).alias("issues"),
    )
    f = f.withColumn("ordinal", F.col("ordinal.l_linenumber") * 1000000 + F.col("ordinal.l_partkey"))
    return lookups.silent_variants(f)


@query(f"""with {_MOMENTS}, s as (select ordinal, person, source, start, score, 20 + score * 12 as q, min(ordinal) over (partition by person, source) as seen from m), g as (select person, list({{'o': ordinal, 'p': 0, 't': q}} order by seen, start, ordinal) as rows from s group by 1),
    k as (select person, list_reduce(list_transform(rows, lambda x: [x]), lambda acc, x: list_concat(acc, [case when acc[-1].t + x[1].t - 1 <= 345 then {{'o': x[1].o, 'p': acc[-1].p, 't': acc[-1].t + x[1].t - 1}} else {{'o': x[1].o, 'p': acc[-1].p + 1, 't': x[1].t}} end])) as r from g),
    f as (select person, unnest(r, recursive := true) from k), z as (select f.person, s.ordinal, p, seen, start from f join s on f.o = s.ordinal)
    select ordinal, cast(p + 1 as int) as part_number, cast(max(p) over (partition by person) + 1 as int) as part_count, cast(row_number() over (partition by person, p order by seen, start, ordinal) as int) as place_in_part, count(*) over (partition by person, p) as events_in_part,
    cast(row_number() over (partition by person order by p, seen, start, ordinal) as int) as place_in_reel from z""")
def q136_part_annotations(spark, d):
    shared_checkpoints(spark)
    m = moments(spark, d).withColumn("end", F.col("start") + 5 + F.col("score") * 3)
    return sequential.part_annotations(sequential.packed_parts(m, "person"), "person").select("ordinal", "part_number", "part_count", "place_in_part", "events_in_part", "place_in_reel")


@query("""with n as (select l_orderkey as cluster, l_linenumber % 4 as clip, l_suppkey % 20 as person, l_orderkey * 10 + l_linenumber as ordinal, l_partkey from lineitem), k as (select distinct c_custkey % 4 as clip, c_custkey % 20 as person from customer where c_nationkey > 0),
    r as (select n.*, row_number() over (partition by clip, person order by ordinal, l_partkey) as r from n join k using (clip, person)) select clip, person, min(ordinal) as ordinal from r where r = 1 group by 1, 2""")
def q137_resolved_appearances(spark, d):
    named = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), (F.col("l_linenumber") % 4).cast("long").alias("clip"), (F.col("l_suppkey") % 20).alias("person"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    known = table(spark, d, "customer").select((F.col("c_custkey") % 4).alias("clip"), (F.col("c_custkey") % 20).alias("person"), F.col("c_nationkey").alias("events"))
    return lookups.resolved_appearances(named, known).select("clip", "person", "ordinal")


@query("""with v as (select vec_id, vec_id % 10 as clip, list_transform(embedding, lambda x: cast(round(x * 1000) as bigint)) as v from embeddings),
    p as (select a.vec_id as a, b.vec_id as b, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) as s from v a join v b on a.clip <> b.clip), r as (select *, row_number() over (partition by a order by s desc, b) as k from p),
    t as (select a, max(b) filter (k = 1) as b, max(s) filter (k = 1) as s1, max(s) filter (k = 2) as s2 from r where k <= 2 group by 1), g as (select * from t where s1 >= 0.2 and s1 - coalesce(s2, -1) >= 0.001) select x.a, x.b from g x join g y on x.b = y.a and y.b = x.a where x.a < x.b""")
def q138_mutual_nearest(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("clip"), F.lit(0).alias("block"), F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000)).alias("v"))
    return identity.mutual_edges(identity.best_two(e, "block", "clip", "v", "vec_id"), "vec_id", 0.2, 0.001)


@query(f"""with x as (select p_partkey as id, p_size % 10 as s, {_TOKENS.format("p_name || ' ' || p_type")} as tk from part), p as (select a.id as l, b.id as r, case when len(a.tk) = 0 or len(b.tk) = 0 then 0 else len(list_intersect(a.tk, b.tk)) / len(list_distinct(a.tk || b.tk)) end as similarity from x a join x b on a.s = b.s and a.id % 2 = 0 and b.id % 2 = 1),
    r as (select *, row_number() over (partition by l order by similarity desc, r) as k from p where similarity >= 0.6) select l as left_id, r as right_id, similarity from r where k = 1""")
def q139_best_text_match(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("s"), text.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    left, right = p.where("id % 2 = 0"), p.where("id % 2 = 1")  # the two sides: even and odd parts
    return ledger.best_text_match_within(left, right, ["s"], 0.6)


@query("""select o_orderkey as k, o_custkey as owner, p.c_nationkey as sport, 10 + case when p.c_nationkey % 2 = 0 then p.c_nationkey else -10 end + case when o_orderstatus = 'O' then 3 else 0 end as contrast, o_orderstatus = 'F' or o_custkey = 7 as visible from orders join customer p on c_custkey = o_custkey""")
def q140_graded_and_visible(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("owner"), F.col("c_nationkey").alias("sport"), F.col("o_orderstatus").alias("event_type"), F.when(F.col("o_orderstatus") == "F", "t").alias("token"))
    base = table(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("sport"), (F.col("c_nationkey") + 10).alias("contrast")).distinct()
    graded = lookups.graded(o, base, spark.createDataFrame([("O", 3)], "event_type string, extra int"))
    seen = sessions.visible_to(graded, "owner", "token", F.lit(7)).select("k", F.lit(True).alias("visible"))
    return graded.join(seen, "k", "left").select("k", "owner", "sport", "contrast", F.coalesce("visible", F.lit(False)).alias("visible"))


@query("""select count(*) filter (o_orderdate > timestamp '1995-01-01' and o_orderkey % 4 > 0) as active, count(*) filter (o_orderdate <= timestamp '1995-01-01' and o_orderkey % 4 > 0) as expired, count(*) filter (o_orderkey % 4 = 0) as missing from orders""")
def q141_expiry_counts(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate").cast("timestamp")).alias("expires"))
    return sessions.expiry_counts(o, "expires", F.lit("1995-01-01").cast("timestamp"))


@query("""select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def q142_missing_members(spark, d):
    everyone = table(spark, d, "customer").select("c_custkey")
    return identity.missing_members(everyone, table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""select event_id, case when event_id % 20 - 8 between 0 and 6 then 'inside' when event_id % 20 - 8 in (-1, 7) then 'clamped' else 'outside_chunk_bounds' end as place, cast(case when event_id % 20 - 8 = -1 then 0 when event_id % 20 - 8 = 7 then 6 else event_id % 20 - 8 end as double) as at from events""")
def q143_late_rows(spark, d):
    e_id = F.col("event_id")
    from tidemark.streaming import live

    e = events(spark, d).select("event_id", (e_id % 20 - 8).cast("double").alias("at"), F.lit(0.0).alias("low"), F.lit(6.0).alias("high"))
    return live.late_rows(e, "at", "low", "high").select("event_id", "place", "at")


@query("""with f as (select event_id as k, case event_id % 3 when 0 then 'a' when 1 then 'b' end as kind from events), t as (select event_id as k from events where event_type = 'view'), r as (select event_id as k from events where event_type = 'view' and user_id % 5 = 0)
    select f.k, coalesce(kind, 'c') as kind from f where k not in (select k from t) or k in (select k from r)""")
def q144_unprocessed(spark, d):
    e_id = F.col("event_id")
    from tidemark.sources import readers

    e = events(spark, d)
    files = e.select(e_id.alias("key"), F.when(e_id % 3 == 0, "a").when(e_id % 3 == 1, "b").otherwise("c").alias("kind"))
    done = e.where("event_type = 'view'").select(e_id.alias("key"))
    again = e.where("event_type = 'view' and user_id % 5 = 0").select(e_id.alias("key"))
    return readers.unprocessed(files, done, again).withColumnRenamed("key", "k")


@query("""with d as (select event_id as k, user_id as track, [event_id % 40, 5, event_id % 40 + user_id % 3, 9] as box, case when event_id % 7 > 0 then 'person' end as class, case when event_id % 11 > 0 then 'x' end as t, event_id % 100 / 100.0 as c from events)
    select k, case when class is null then 'missing_class' when t is null then 'missing_track' when track % 3 = 0 then 'invalid_box' when k % 13 = 0 then 'invalid_time' end as reason from d where k % 100 >= 25""")
def q145_normalised_detections(spark, d):
    e_id = F.col("event_id")
    from tidemark.sources import readers

    rows = events(spark, d).select(
        e_id.alias("k"), F.when(e_id % 7 > 0, "person").alias("class_name"), F.when(e_id % 11 > 0, "x").alias("track_id"), F.array(*(c.cast("double") for c in (e_id % 40, F.lit(5), e_id % 40 + F.col("user_id") % 3, F.lit(9)))).alias("bbox_xyxy"),
        F.when(e_id % 13 == 0, -1.0).otherwise(1.0).alias("time_sec"), ((e_id % 100) / 100).alias("confidence"),
    )
    good, bad = readers.normalised_detections(rows, 0.25)
    return good.select("k", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("k", "reason"))


@query("""select event_id // 4 as video, min(event_id % 3) as priority, 'p' || min(case when event_id % 3 = m then event_id end) as path from (select *, min(event_id % 3) over (partition by event_id // 4) as m from events) group by 1""")
def q146_preferred_sidecars(spark, d):
    e_id = F.col("event_id")
    from tidemark.sources import readers

    e = events(spark, d).select(F.floor(e_id / 4).alias("video"), (e_id % 3).alias("priority"), e_id.alias("path"))
    return readers.preferred_sidecars(e).withColumn("path", F.concat(F.lit("p"), F.col("path").cast("string")))


@query("""select event_id as frame_index, cast(n as int) as place, event_id / 30.0 as time_sec, case n when 0 then 'a' else 'b' end as class_name, event_id % 5 + n as track_id from events, (values (0), (1)) v(n)""")
def q147_columnar_detections(spark, d):
    e_id = F.col("event_id")
    from tidemark.sources import readers

    rows = events(spark, d).select(
        F.lit("v").alias("source_video"), e_id.alias("frame_index"), F.lit(30.0).alias("fps"), F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))).alias("boxes"), F.array(F.lit(0.5), F.lit(0.6)).alias("confidences"),
        F.array(F.lit("a"), F.lit("b")).alias("classes"), F.array(e_id % 5, e_id % 5 + 1).alias("tracks"),
    )
    return readers.columnar_detections(rows).select("frame_index", "place", "time_sec", "class_name", "track_id")
