"""Queries of operators that go through several steps or indexes: the chain of cluster steps, relatedness, names, teasers, transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.operators import chain, ledger, timeline
from tidemark.queries import _MOMENTS, moments, query, shared_checkpoints, table

_SHIRT = """list_distinct(regexp_extract_all(lower(coalesce(own, '')), '(?:#|number\\s+|no\\.\\s*|bib\\s+|jersey\\s+)([0-9]{1,3})', 1)
        || regexp_extract_all(lower(coalesce(own, '')), '\\bplayer\\s+([0-9]{1,3})\\b', 1))"""


def _split(out: str, into: str) -> str:
    """SQL of one splitting step: `out` from the members `into`."""
    return f"""
{out}_said as (select cluster, place, unnest({_SHIRT}) as number from {into}),
{out}_first as (select cluster, number, min(place) as first from {out}_said group by all),
{out}_each as (select cluster, place, min(first) = place as fresh from {out}_said join {out}_first using (cluster, number) group by cluster, place),
{out}_numbers as (select cluster, count(*) filter (fresh) > 1 as numbers from {out}_each group by cluster),
{out}_clips as (select cluster, count(*) > count(distinct clip) as same_clip from {into} group by cluster),
{out} as (
    select case when bad then cluster || '/' || ident else cluster end as cluster, case when bad then turn || place else turn end as turn,
        case when not bad then description when coalesce(own, '') <> '' then own else coalesce(description, 'unknown athlete') end as description,
        case when bad then [0::bigint] else place end as place, ident, clip, own,
        case when bad then lineage || [case when same_clip then 'split:same_clip' else 'split:numbers' end] else lineage end as lineage
    from (select m.*, same_clip, same_clip or coalesce(numbers, false) as bad from {into} m join {out}_clips using (cluster) left join {out}_numbers using (cluster)))"""


@query(f"""
with people as (
    select o_orderkey as position, 'o' || o_orderkey as ident, 'c' || (o_custkey % 40) as clip,
        case o_orderkey % 6 when 0 then 'Player ' || (o_custkey % 3) when 1 then 'blue, #' || (o_custkey % 2 + 7) when 2 then '' when 3 then 'Red shirt' end as own, o_custkey
    from orders),
members as (
    select cast(o_custkey as varchar) as cluster, [o_custkey] as turn, case when o_custkey % 7 > 0 then 'Surfer in Red-' || (o_custkey % 29) end as description, [position] as place,
        ident, clip, own, []::varchar[] as lineage
    from people where position % 11 > 0),
e as (
    select * from members union all
    select 'new/' || ident, [4611686018427387904, position], case when coalesce(own, '') <> '' then own else 'unknown athlete' end, [0::bigint], ident, clip, own, ['added']
    from people where position % 11 = 0),
{_split("s", "e")},
heads as (select trim(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9 ]', '', 'g')) as key, cluster, min(turn) as turn, list(distinct clip) as clips from s group by 1, 2),
folded as (
    select key, list_reduce(list(struct_pack(held := clips, taken := [cluster]) order by turn),
        lambda a, x: case when list_has_any(a.held, x.held) then a else struct_pack(held := a.held || x.held, taken := a.taken || x.taken) end).taken as taken
    from heads where key <> '' group by key having count(*) > 1),
into_ as (select unnest(taken) as cluster, taken[1] as head, len(taken) > 1 as grows from folded),
said as (select cluster, any_value(description) as description, any_value(turn) as turn from s group by cluster),
m as (
    select coalesce(i.head, s.cluster) as cluster, coalesce(h.turn, s.turn) as turn, case when i.head is not null then h.description else s.description end as description,
        case when i.cluster is not null then s.turn || s.place else s.place end as place, ident, clip, own,
        case when i.head <> i.cluster then lineage || ['merged:' || s.cluster] else lineage end as lineage
    from s left join into_ i on i.cluster = s.cluster left join said h on h.cluster = i.head),
{_split("t", "m")},
verdicts as (select cast(o_custkey as varchar) as cluster, o_custkey % 3 > 0 as same_person, list(ident) filter (position % 5 = 0) as bad from people group by o_custkey),
sizes as (select cluster, count(*) as n, count(*) filter (list_contains(coalesce(bad, []), ident)) as hits from t left join verdicts using (cluster) group by cluster),
judged as (
    select t.*, coalesce(n > 1 and (not same_person or hits > 0), false) as doubted, hits = 0 or hits = n as whole, list_contains(coalesce(bad, []), ident) as named
    from t join sizes using (cluster) left join verdicts using (cluster)),
v as (
    select case when out then cluster || '/' || ident else cluster end as cluster, case when out then turn || place else turn end as turn,
        case when not out then description when coalesce(own, '') <> '' then own else coalesce(description, 'unknown athlete') || case when whole then '' else ' (separated)' end end as description,
        case when out then [0::bigint] else place end as place, ident, clip, own,
        case when out then lineage || [case when whole then 'split:unverified' else 'verified_out' end] else lineage end as lineage
    from (select *, doubted and (whole or named) as out from judged)),
{_split("z", "v")}
select ident, cluster, description, array_to_string(lineage, ',') as lineage from z""")
def q148_cluster_chain(spark, d):
    shared_checkpoints(spark)
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    own = F.when(key % 6 == 0, F.concat(F.lit("Player "), (customer % 3).cast("string"))).when(key % 6 == 1, F.concat(F.lit("blue, #"), (customer % 2 + 7).cast("string")))
    people = table(spark, d, "orders").select(
        key.alias("position"), F.concat(F.lit("o"), key.cast("string")).alias("ident"), F.concat(F.lit("c"), (customer % 40).cast("string")).alias("clip"),
        own.when(key % 6 == 2, "").when(key % 6 == 3, "Red shirt").alias("own"), customer.alias("cluster"),
    )
    clusters = people.where("position % 11 > 0").withColumn("description", F.when(F.col("cluster") % 7 > 0, F.concat(F.lit("Surfer in Red-"), (F.col("cluster") % 29).cast("string"))))
    verdicts = people.groupBy("cluster").agg((F.max("cluster") % 3 > 0).alias("same_person"), F.collect_list(F.when(F.col("position") % 5 == 0, F.col("ident"))).alias("bad"))
    out = chain.post_processed(chain.members_of(clusters), people.drop("cluster"), verdicts)
    return out.select("ident", "cluster", "description", F.array_join("lineage", ",").alias("lineage"))


_WORDS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: len(w) > 2 and not list_contains({1}, w))))"
_TOKENS = lambda column: _WORDS.format(column, text.STOPWORDS)


@query(f"""
with c as (
    select p_partkey as candidate_id, case when p_size % 3 > 0 then p_brand end as draft_name, {_TOKENS("p_name || ' ' || p_type || case when p_size % 2 = 0 then ' black wetsuit' else '' end")} as words,
        cast(p_partkey * 7 % 3600 as double) as start, cast(p_partkey * 7 % 3600 + 10 + p_size as double) as "end", p_size % 10 as score, p_size % 9 = 0 as selected from part),
d as (
    select cast(regexp_extract(p_brand, '[0-9]+') as bigint) as draft_id, p_brand as name, {_TOKENS("min(p_name) || ' ' || max(p_name) || ' ' || min(p_type) || case when min(p_partkey) % 2 = 0 then ' black' else '' end")} as label
    from part group by p_brand),
a as (
    select d.draft_id, arg_min(c.words, c.candidate_id) as anchor, arg_min(c.start, c.candidate_id) as s, arg_min(c."end", c.candidate_id) as e
    from d join c on c.selected and (c.draft_name = d.name or c.draft_name is null) group by d.draft_id),
x as (
    select d.draft_id, candidate_id, score, not selected as discarded, list_intersect(list_intersect(words, label), {text.COLORS_AND_EQUIPMENT}) as shared,
        case when len(words) = 0 or len(label) = 0 then 0 else cast(round(len(list_intersect(words, label)) / len(list_distinct(words || label)) * 1000) as bigint) end as to_label,
        case when len(words) = 0 or len(coalesce(anchor, [])) = 0 then 0 else cast(round(len(list_intersect(words, anchor)) / len(list_distinct(words || anchor)) * 1000) as bigint) end as to_anchor,
        round(greatest(0, s - c."end", c.start - e), 2) as gap
    from d left join a using (draft_id) cross join c where not (selected and coalesce(draft_name = name, false))),
r as (select *, (2 * to_label + 300 * len(shared) + to_anchor + case when gap <= 60 then 500 else 0 end + 1) // 2 as relatedness from x),
f as (select *, discarded and (relatedness >= 900 or len(shared) >= 2) as fragment from r where relatedness >= 450),
o as (select *, row_number() over (partition by draft_id order by fragment desc, score desc, relatedness desc, candidate_id) as rank from f)
select draft_id, candidate_id, cast(relatedness as bigint) as thousandths, array_to_string(list_sort(shared), ',') as shared, gap, fragment, cast(rank as int) as rank from o where rank <= 10""")
def q149_relatedness(spark, d):
    p, size, at = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey") * 7 % 3600
    said = F.concat("p_name", F.lit(" "), "p_type", F.when(size % 2 == 0, " black wetsuit").otherwise(""))
    candidates = p.select(
        F.col("p_partkey").alias("candidate_id"), F.when(size % 3 > 0, F.col("p_brand")).alias("draft_name"), text.tokens(said).alias("tokens"), at.cast("double").alias("start"),
        (at + 10 + size).cast("double").alias("end"), (size % 10).alias("score"), (size % 9 == 0).alias("selected"), (size % 9 != 0).alias("discarded"),
    )
    label = F.concat(F.min("p_name"), F.lit(" "), F.max("p_name"), F.lit(" "), F.min("p_type"), F.when(F.min("p_partkey") % 2 == 0, " black").otherwise(""))
    drafts = p.groupBy("p_brand").agg(label.alias("label")).select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("draft_id"), F.col("p_brand").alias("name"), text.tokens(F.col("label")).alias("tokens"))
    out = ledger.relatedness(drafts, candidates)
    return out.select("draft_id", "candidate_id", F.round(F.col("relatedness") * 1000).cast("long").alias("thousandths"), "shared", "gap", "fragment", "rank")


@query(f"""with {_MOMENTS}, r as (select *, case ordinal % 4 when 0 then 'cut' when 1 then 'fade' when 2 then 'slide' else 'zoom' end as wanted, start // 7200 as slot from m),
    o as (select *, row_number() over w as place, count(*) over v as n, bool_or(wanted = 'zoom') over v as zooms from r
        window v as (partition by person, slot), w as (partition by person, slot order by score, ordinal))
    select ordinal, case when zooms and n >= 3 and place = n - 1 then 'zoom' when wanted = 'zoom' and place <> n - 1 then 'slide' else wanted end as transition,
        cast(case when n = 1 then least("end", start + 15) else "end" end as bigint) as shown_until from o""")
def q150_reel_transitions(spark, d):
    e = F.col("ordinal") % 4
    m = moments(spark, d).withColumn("slot", F.floor(F.col("start") / 7200)).withColumn("wanted", F.when(e == 0, "cut").when(e == 1, "fade").when(e == 2, "slide").otherwise("zoom"))
    w = Window.partitionBy("person", "slot")
    m = m.withColumns({"place": F.row_number().over(w.orderBy("score", "ordinal")), "n": F.count(F.lit(1)).over(w), "zooms": F.bool_or(F.col("wanted") == "zoom").over(w)})
    return timeline.single_capped(m, "n").select("ordinal", scores.transitions(F.col("place"), F.col("n"), F.col("wanted"), F.col("zooms")).alias("transition"), F.col("shown_until").cast("long").alias("shown_until"))
