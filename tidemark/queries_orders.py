"""Queries of orders within a reel, and of windows resolved from their phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import impact_order, sequential
from tidemark.queries import _MOMENTS, moments, query

KINDS = ["snap", "carve", "Paddle", "aerial", "snap", "pass", "wipeout"]


@query(f"""
with recursive {_MOMENTS},
k as (
    select ordinal, {{'source': source, 'person': person}} as reel, start, score, 4 + ordinal % 9 as seconds, lower(list_extract({KINDS}, cast(1 + ordinal % 7 as int))) as kind from m),
w as (
    select *, case kind when 'snap' then 5 when 'carve' then 4 when 'paddle' then 0 when 'aerial' then 6 when 'wipeout' then 1 else 2 end as weight, kind in ('paddle', 'wipeout') as low from k),
i as (
    select *, score * 10 + weight * 3 - greatest(0, seconds - 8) * cast(0.7 as double) - case when low then 8 else 0 end as impact, count(*) over r as n,
        count(*) filter (kind <> 'pass') over r as rides from w window r as (partition by reel)),
c as (
    select *, n > 2 and rides >= greatest(1, n // 2) as arranged, row_number() over (partition by reel order by impact desc, ordinal) = 1 as climax from i),
h as (
    select *, not climax and row_number() over (partition by reel order by climax, not climax and not low and seconds <= 10 desc, impact desc, ordinal) = 1 as hook from c),
b as (
    select reel, list({{'o': ordinal, 'k': kind}} order by impact, start, ordinal) as l from h where arranged and not climax and not hook group by reel),
s as (
    select reel, 1 as pos, l from b
    union all
    select reel, pos + 1, case when l[pos + 1].k = l[pos].k and j is not null then l[:pos] || [l[j]] || l[pos + 2:j - 1] || [l[pos + 1]] || l[j + 1:] else l end
    from (select *, list_filter(range(pos + 2, len(l) + 1), lambda x: l[x].k <> l[pos + 1].k)[1] as j from s where pos < len(l))),
p as (
    select reel, unnest(l).o as ordinal, generate_subscripts(l, 1) + 1 as place from s where pos = len(l))
select h.ordinal, cast(case when not arranged then row_number() over (partition by h.reel order by h.ordinal) when climax then n when hook then 1 else p.place end as int) as place
from h left join p on p.ordinal = h.ordinal""")
def q160_impact_order(spark, d):
    o = F.col("ordinal")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (1 + o % 7).cast("int"))
    m = moments(spark, d).withColumns({"reel": F.struct("source", "person"), "kind": kind, "end": F.col("start") + 4 + o % 9})
    return impact_order.impact_order(m, "reel").select("ordinal", "place")


@query(f"""
with recursive {_MOMENTS},
b as (select {{'source': source, 'person': person}} as reel, list({{'o': ordinal, 's': ordinal % 3 > 0}} order by ordinal) as l from m group by source, person),
s as (
    select reel, 1 as pos, l from b
    union all
    select reel, pos + 1, case when l[pos].s and l[pos + 1].s and pos + 1 < len(l) and j is not null then l[:pos] || [l[j]] || l[pos + 2:j - 1] || [l[pos + 1]] || l[j + 1:] else l end
    from (select *, list_filter(range(pos + 2, len(l)), lambda x: not l[x].s)[1] as j from s where pos < len(l)))
select unnest(l).o as ordinal, cast(generate_subscripts(l, 1) - 1 as int) as place from s where pos = len(l)""")
def q161_slow_runs_broken(spark, d):
    m = moments(spark, d).withColumns({"reel": F.struct("source", "person"), "slow": F.col("ordinal") % 3 > 0})
    return sequential.slow_runs_broken(m, "reel").select("ordinal", "place")
