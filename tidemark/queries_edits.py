"""Queries of what cuts may do, orders by quality, clients, canonical JSON, judged candidates, thresholds, reasons of reviews and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import edits, scores, text
from tidemark.operators import lookups, reports, timeline
from tidemark.plans import sessions
from tidemark.queries import _MOMENTS, moments, query, table

_KINDS = ["aerial", "tackle", "wipeout", "walk", "ride"]


def kinds(number):
    return F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (number % 5 + 1).cast("int"))


@query(f"""
with e as (
    select event_id, {_KINDS}[cast(event_id % 5 as int) + 1] as kind, case when event_id % 7 > 0 then cast(1 + event_id % 7 / 8.0 as double) end as requested,
        cast(1 + event_id % 9 / 8.0 as double) as head, case event_id % 4 when 0 then 1080 when 1 then 1440 when 2 then 2160 end as height, event_id % 3 = 0 as asked,
        case event_id % 11 when 0 then null else event_id % 11 > 5 end as native, 20 + event_id % 12 as rate, 5 + event_id % 16 as seconds from events),
z as (
    select *, coalesce(height, 1080) >= 1440 as tall,
        case kind when 'aerial' then cast(1.3 as double) when 'tackle' then cast(1.1 as double) end as floor, case kind when 'wipeout' then cast(1.05 as double) when 'walk' then cast(1.05 as double) end as ceiling from e),
y as (select *, case when head >= 1.15 and tall then greatest(1, least(coalesce(requested, 1), head * cast(0.9 as double))) else 1 end as capped from z),
x as (select *, case when floor is not null and head >= 1.15 and tall then greatest(capped, least(floor, head * cast(0.9 as double))) else capped end as raised from y),
s as (select *, coalesce(native, true) as has, asked and (coalesce(native, true) or (rate >= 24 and tall)) and kind <> 'wipeout' as slow from x)
select event_id, cast(round(least(raised, coalesce(ceiling, raised)) * 10000) as bigint) as zoom, slow, slow and not has as made, cast(case when slow and not has then 15 when slow then 20 else 10 end as int) as tenths,
    cast(case when slow then round(least(0.3, 2.5 / seconds), 3) * 1000 else 400 end as bigint) as share from s""")
def q151_edit_limits(spark, d):
    e = F.col("event_id")
    native = F.when(e % 11 > 0, e % 11 > 5)
    height = F.when(e % 4 == 0, 1080).when(e % 4 == 1, 1440).when(e % 4 == 2, 2160)
    zoom = edits.applied_zoom(F.when(e % 7 > 0, 1 + e % 7 / 8), 1 + e % 9 / 8, height, kinds(e))
    slow = edits.slow_motion(e % 3 == 0, native, 20 + e % 12, height, kinds(e), 5 + e % 16, interpolate=True)
    out = table(spark, d, "events").select("event_id", F.round(zoom * 10000).cast("long").alias("zoom"), slow.alias("s"))
    return out.select("event_id", "zoom", F.col("s.slow").alias("slow"), F.col("s.interpolated").alias("made"), F.round(F.col("s.factor") * 10).cast("int").alias("tenths"), F.round(F.col("s.share") * 1000).cast("long").alias("share"))


@query(f"""
with {_MOMENTS},
q as (select *, ordinal * 37 % 80 / 8.0 as quality, ordinal % 3 > 0 as evidence from m),
f as (select *, row_number() over (partition by source, person order by evidence and quality >= 6.5 desc, quality desc, ordinal) = 1 and evidence and quality >= 6.5 as climax from q),
c as (select *, bool_or(climax) over r as found, count(*) over r as n, row_number() over (partition by source, person, climax order by quality desc, ordinal) as down from f window r as (partition by source, person)),
o as (select *, found and not climax and down = 1 as opens from c),
u as (select *, row_number() over (partition by source, person, climax, opens order by quality, ordinal) as up from o)
select ordinal, climax, cast(case when climax then n when opens then 1 when found then up + 1 else up end as int) as place from u""")
def q152_quality_order(spark, d):
    m = moments(spark, d).withColumns({"reel": F.struct("source", "person"), "quality": F.col("ordinal") * 37 % 80 / 8, "evidence": F.col("ordinal") % 3 > 0})
    return timeline.quality_order(m, "reel").select("ordinal", "climax", "place")


@query("""
with said as (
    select o_orderkey, lower(case o_orderkey % 6 when 0 then 'Player #' || o_custkey % 60 || ' in red' when 1 then 'Number ' || o_custkey % 60 || ' runs' when 2 then 'seen: NO. ' || o_custkey % 60 || '!' when 3 then
        'the ' || o_custkey % 60 || ' rider' when 4 then 'rider ' || o_custkey % 60 when 5 then o_orderpriority || ' today' end) as said from orders),
clients as (
    select s_suppkey as ordinal, s_name as client, case when s_suppkey % 3 > 0 then cast(s_suppkey as varchar) when s_suppkey % 9 = 0 then ' ' end as jersey,
        case when s_suppkey % 13 = 0 then 'Urgent' when s_suppkey % 11 = 0 then '-s' when s_suppkey % 7 = 0 then '' end as pattern from supplier),
texts as (select distinct said from said),
hits as (
    select said, min(ordinal) as ordinal from texts, clients
    where (trim(jersey) <> '' and (contains(said, '#' || jersey) or contains(said, 'number ' || jersey) or contains(said, 'no. ' || jersey) or contains(said, ' ' || jersey || ' ') or said like '% ' || jersey))
        or (pattern <> '' and contains(said, lower(pattern))) group by 1)
select o_orderkey, client from said left join hits using (said) left join clients using (ordinal)""")
def q153_clients(spark, d):
    key, shirt = F.col("o_orderkey"), (F.col("o_custkey") % 60).cast("string")
    forms = [("Player #", " in red"), ("Number ", " runs"), ("seen: NO. ", "!"), ("the ", " rider"), ("rider ", "")]
    said = F.concat("o_orderpriority", F.lit(" today"))
    for k, (before, after) in enumerate(forms):
        said = F.when(key % 6 == k, F.concat(F.lit(before), shirt, F.lit(after))).otherwise(said)
    s = F.col("s_suppkey")
    jersey = F.when(s % 3 > 0, s.cast("string")).when(s % 9 == 0, " ")
    pattern = F.when(s % 13 == 0, "Urgent").when(s % 11 == 0, "-s").when(s % 7 == 0, "")
    clients = table(spark, d, "supplier").select(s.alias("ordinal"), F.col("s_name").alias("client"), jersey.alias("jersey"), pattern.alias("pattern"))
    return lookups.clients_of(table(spark, d, "orders").select("o_orderkey", said.alias("said")), "said", clients).select("o_orderkey", F.col("label").alias("client"))


@query("""
with o as (
    select o_orderkey, '{"clerk":"' || o_orderpriority || '","dated":"' || strftime(o_orderdate, '%Y-%m-%d') || '","nested":[{"a":' || o_custkey || ',"b":null},true],"status":"' || o_orderstatus || '"}' as told from orders)
select o_orderkey, told as cleaned, substr(sha1(lower(told)), 1, 16) as digest, substr(sha1(lower(told)), 1, 16) as shuffled_digest, substr(sha1('no json: ' || o_orderkey), 1, 16) as text_digest from o""")
def q154_canonical_json(spark, d):
    o = table(spark, d, "orders")
    inner = F.array(F.to_variant_object(F.struct(F.col("o_custkey").alias("a"), F.lit(None).cast("string").alias("b"))), F.lit(True).cast("variant"))
    row = F.struct(F.col("o_orderstatus").alias("status"), inner.alias("nested"), F.col("o_orderdate").cast("date").alias("dated"), F.col("o_orderpriority").alias("clerk"))
    parts = [F.format_string('"status" : "%s"', "o_orderstatus"), F.format_string('"nested":[ {"b":null,"a":%d},true]', "o_custkey"), F.format_string('"clerk":"%s"', "o_orderpriority"), F.format_string('"dated":\n"%s"', F.date_format("o_orderdate", "yyyy-MM-dd"))]
    shuffled = F.concat(F.lit("{ "), F.concat_ws(", ", *parts), F.lit(" }"))
    cleaned = text.cleaned_json(row)
    return o.select("o_orderkey", cleaned.alias("cleaned"), text.json_digest(cleaned).alias("digest"), text.json_digest(shuffled).alias("shuffled_digest"), text.json_digest(F.concat(F.lit("No JSON:  "), F.col("o_orderkey").cast("string"))).alias("text_digest"))


_CANDIDATES = """
x as (
    select event_id, event_type as source, event_id % 3 as k, 5 + event_id % 466 as local, event_id % 60 as n, event_id % 10 > 6 as chosen, event_id % 14 = 0 as broken from events),
j as (
    select *, not broken and least(480, local + 10 + n) - local >= 4 as valid, case when k = 0 or event_id % 2 = 1 then 'chunk_local' else 'source_global' end as basis, local + 10 + n > 480 as clamped from x)"""


def candidates(spark, d):
    e = F.col("event_id")
    k, local = e % 3, 5 + e % 466
    start = (local + F.when(e % 2 == 0, 480 * k).otherwise(0)).cast("double")
    end = F.when(e % 14 == 0, start - 1).otherwise(start + 10 + e % 60)
    chosen = e % 10 > 6
    c = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("source"), k.alias("chunk_index"), F.lit("A").alias("person"), start.alias("start"), end.alias("end"), chosen.alias("selected"),
        (~chosen).alias("discarded"), F.when(chosen, "score").alias("selection_reason"), F.when(~chosen, "low_score").alias("discard_cause"),
    )
    lengths = table(spark, d, "events").select(F.col("event_type").alias("source")).distinct().withColumn("seconds", F.lit(1440.0))
    return sessions.judged_candidates(c, timeline.chunk_specs(lengths, "source", "seconds", 480.0))


@query(f"""with {_CANDIDATES}
select event_id, valid, valid and chosen as selected, not (valid and chosen) as discarded, case when valid and chosen then 'score' end as selection_reason,
    case when not valid then case when broken then 'invalid_numeric_window' else 'insufficient_time_inside_chunk' end when not chosen then 'low_score' end as discard_cause,
    cast(case when valid then 480 * k + local else local + case when event_id % 2 = 0 then 480 * k else 0 end end as double) as start, 'chunk_' || lpad(cast(k as varchar), 2, '0') || ':A' as person from j""")
def q155_judged_candidates(spark, d):
    return candidates(spark, d).select("event_id", "valid", "selected", "discarded", "selection_reason", "discard_cause", "start", "person")


@query(f"""with {_CANDIDATES}
select source, count(*) as candidates, count(*) filter (valid and chosen) as selected, count(*) filter (not (valid and chosen)) as discarded, count(*) filter (not valid) as invalid,
    count(*) filter (valid and clamped) as clamped, cast(0 as bigint) as recovered, count(*) filter (valid) as decimal_seconds, count(*) filter (valid and basis = 'chunk_local') as local,
    count(*) filter (valid and basis = 'source_global') as global, true as causes_available from j group by 1""")
def q156_candidate_counters(spark, d):
    out = sessions.candidate_counters(candidates(spark, d), ["source"])
    plain = ["source", "candidates", "selected", "discarded", "invalid", "clamped", "recovered", "causes_available"]
    return out.select(*plain, F.col("encoding_decimal_seconds").alias("decimal_seconds"), F.col("basis_chunk_local").alias("local"), F.col("basis_source_global").alias("global"))


@query("""
with l as (select l_suppkey % 20 as sport, l_partkey % 2 = 0 and l_suppkey % 4 > 1 as labelled, l_suppkey % 4 = 1 as guessed, l_extendedprice as v from lineitem),
r as (select sport, labelled, v, row_number() over w as r, count(*) over (partition by sport, labelled) as n from l where labelled or guessed window w as (partition by sport, labelled order by v)),
p as (select sport, labelled, v from r where n >= 5 and r = greatest(1, floor(n * case when labelled then 0.25 else 0.4 end)))
select s.sport, coalesce(a.v, b.v, 60) as threshold, case when a.v is not null then 'labelled' when b.v is not null then 'provisional' else 'current' end as basis
from (select distinct sport from l) s left join p a on a.sport = s.sport and a.labelled left join p b on b.sport = s.sport and not b.labelled""")
def q157_threshold_basis(spark, d):
    s = F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select((s % 20).alias("sport"), ((F.col("l_partkey") % 2 == 0) & (s % 4 > 1)).alias("labelled"), (s % 4 == 1).alias("guessed"), F.col("l_extendedprice").cast("double").alias("v"))
    return reports.threshold_suggestion(rows.where("labelled"), rows.where("guessed and not labelled"), ["sport"], "v", 60.0, everyone=rows.select("sport"))


@query("""select event_id, array_to_string(list_filter([case when event_id % 3 = 0 then 'blocking_defect' end, case when value < 10 then 'low_engagement' end,
    case when event_id % 7 = 0 then 'identity_unproven' end], lambda x: x is not null), ',') as reasons, event_id % 3 = 0 or value < 10 or event_id % 7 = 0 as blocked from events""")
def q158_review_reasons(spark, d):
    e = F.col("event_id")
    reasons = scores.review_reasons(blocking_defect=e % 3 == 0, low_engagement=F.col("value") < 10, identity_unproven=e % 7 == 0)
    return table(spark, d, "events").select("event_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("blocked"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where (o_orderdate, o_orderkey) < (select (o_orderdate, o_orderkey) from (select min(o_orderdate) + interval 900 day as o_orderdate, 1000 as o_orderkey from orders))
    order by o_orderdate desc, o_orderkey desc limit 50""")
def q159_page_after(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.date_add(F.min("o_orderdate").cast("date"), 900).alias("day")).first().day
    return timeline.page_after(o, [("o_orderdate", True), ("o_orderkey", True)], (first, 1000), 50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
