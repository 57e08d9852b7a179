"""One query for each operator of this subpackage over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, decontaminate, langid, lexical, licenses, lloyd, neardup, pieces, shards, tokencounts, topk, toxicity, warc
from tidemark.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    model = langid.fit(docs.where(~held))
    told = langid.identify(docs, model)
    return told.withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous")


@query
def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    return toxicity.score(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted", "lang_told")


@query
def op4_superminhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_superminhash_groups"] = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
flat as (select doc_id, len(s) as n, unnest(s) as e from sets),
pairs as (
    select a.doc_id as x, b.doc_id as y, count(*) as both_, any_value(a.n) as nx, any_value(b.n) as ny
    from flat a join flat b on a.e = b.e and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs where 100 * both_ >= 75 * (nx + ny - both_)),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on r.y = l.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.y) as component_id, s.doc_id = min(r.y) as kept
from sets s join reach r on r.x = s.doc_id group by s.doc_id, len(s.s)
"""


@query
def op9_suffix_automaton_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op9_suffix_automaton_leaks"] = r"""
with dw as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
bw as (
    select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where item_id is not null and text is not null),
windows as (
    select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
    from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from bw where len(w) > 0)),
sizes as (select distinct k from windows),
grams as (
    select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, sizes where len(w) >= k)),
found as (select doc_id, x.k, i, item_id from grams x join windows y on x.k = y.k and x.g = y.g),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from found group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from dw d left join hit using (doc_id) left join items using (doc_id)
"""


@query
def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_GRAMS = ",\n    ".join(f"('{label}', {base}, {k}, {grams}, {j}, '{' '.join(words)}')" for label, base, k, grams, j, words in licenses.template_rows())
ORACLES["op10_license_diagonals"] = rf"""
with t(label, base, k, grams, j, g) as (values {_GRAMS}),
dw as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
grams as (
    select doc_id, k, i - 1 as i, array_to_string(w[i:i + k - 1], ' ') as g
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, (select distinct k from t) where len(w) >= k)),
votes as (
    select doc_id, label, base, t.k, grams, i - j as diagonal, list(distinct j) as js, min(i) as first
    from grams d join t on d.k = t.k and d.g = t.g group by all),
marked as (
    select *, case when coalesce(diagonal - lag(diagonal) over o > case when k = {licenses.LONG} then {licenses.SLACK} else 0 end, true) then 1 else 0 end as fresh
    from votes window o as (partition by doc_id, label order by diagonal)),
runs as (select *, sum(fresh) over (partition by doc_id, label order by diagonal) as run from marked),
spans as (
    select doc_id, label, base, k, run, min(first) as first, len(list_distinct(flatten(list(js)))) / grams as coverage
    from runs group by doc_id, label, base, k, grams, run),
judged as (select *, (k = {licenses.LONG} and coverage >= {licenses.LEAST}) or coverage = 1 as counts from spans),
found as (
    select doc_id, count(*) filter (counts and base) as n_base, min(first) filter (counts and base) as first_word, max(first) filter (counts and base) as last_word,
        string_agg(distinct label, ',' order by label) filter (counts and base) as base_labels, string_agg(distinct label, ',' order by label) filter (counts) as labels,
        max(coverage) filter (counts or k = {licenses.LONG}) as score
    from judged group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
    coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from dw d left join found using (doc_id)
"""


@query
def op3_sorted_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op3_sorted_list_topk"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""


@query
def op5_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query
def op6_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


@query
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.built(table(spark, sf_dir, "pages"))
    shown = F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"]))
    return records.withColumn("headers", F.array_join(shown, "\n")).withColumn("block", F.col("block").cast("string"))


@query
def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


_LLOYD_ROUND = """
a{r} as materialized (
    select id, owner, d from (
        select v.id, c.c as owner, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) as d,
            row_number() over (partition by v.id order by d, c.c) as place
        from v cross join c{r} c) where place = 1)"""
_LLOYD_CENTROIDS = """
m{r} as (
    select owner, j, sum(e) as s, count(*) as n
    from (select a.owner, unnest(v.x) as e, unnest(range(1, 65)) as j from a{p} a join v using (id)) group by owner, j),
n{r} as (select owner, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as x from m{r} group by owner),
c{r} as materialized (select c.c, coalesce(n.x, c.x) as x from c{p} c left join n{r} n on n.owner = c.c)"""
ORACLES["op11_delta_lloyd"] = (
    """
with v as materialized (
    select row_number() over () as id, vec_id, list_transform(embedding, lambda e: cast(floor(1024 * e::double) as bigint)) as x from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
c0 as materialized (select row_number() over (order by h, vec_id) - 1 as c, x from (select sha256('3:' || vec_id) as h, vec_id, x from v order by h, vec_id limit 8)),"""
    + ",".join(_LLOYD_ROUND.format(r=r) + "," + _LLOYD_CENTROIDS.format(r=r + 1, p=r) for r in range(10))
    + ","
    + _LLOYD_ROUND.format(r=10)
    + """
select v.vec_id, cast(a.owner as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.owner) as bigint) as cluster_inertia,
    cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a10 a join v using (id) join c10 c on c.c = a.owner
"""
)


@query
def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_wavelet_search"] = r"""
with dw as (
    select row_number() over () as d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
    from documents),
tf as (select d, doc_id, t, count(*) as tf from dw group by all),
sizes as (select d, sum(tf) as n from tf group by d),
total as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from sizes),
asked as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
    from benchmark),
df as (select t, count(*) as df from tf group by t),
weights as (
    select item_id, t, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from asked join df using (t), total),
scored as (
    select item_id, d, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + cast(90 * n * docs as bigint) // terms)))) as score
    from weights join tf using (t) join sizes using (d), total group by item_id, d)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10
"""


@query
def op13_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
