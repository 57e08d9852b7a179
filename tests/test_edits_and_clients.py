"""Edit limits, orders by quality, clients by many needles, canonical JSON, judged candidates, pages, and the way from moments to a timeline."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import edits, text
from tidemark.operators import lookups, policies, reports, timeline
from tidemark.plans import decisions, sessions
from tidemark.queries import moments


def zoomed(spark, requested, headroom, height, kind):
    df = spark.createDataFrame([(requested, headroom, height, kind)], "requested double, headroom double, height int, kind string")
    return round(df.select(edits.applied_zoom(*map(F.col, df.columns))).first()[0], 4)


@pytest.mark.parametrize(
    ("asked", "zoom"),
    [
        ((1.4, 2.0, 2160, "ride"), 1.4), ((3.0, 2.0, 2160, "ride"), 1.8), ((1.0, 2.0, 2160, "Aerial"), 1.3), ((1.0, 1.2, 2160, "aerial"), 1.08), ((1.4, 1.0, 2160, "aerial"), 1.0),
        ((1.4, 2.0, 1080, "aerial"), 1.0), ((1.6, 2.0, 1440, "wipeout"), 1.05), ((0.5, 2.0, 2160, None), 1.0), ((None, None, None, None), 1.0), ((1.02, 2.0, 2160, "crash"), 1.02),
    ],
)
def test_zoom_stays_within_source_and_kind(spark, asked, zoom):
    assert zoomed(spark, *asked) == zoom


def test_slow_motion_is_for_those_that_ask_and_can(spark):
    rows = [(True, True, 60, 1080, "ride", 5.0), (True, False, 30, 2160, "ride", 20.0), (True, False, 20, 2160, "ride", 5.0), (True, True, 60, 2160, "Crash", 5.0), (None, True, 60, 2160, "aerial", 5.0), (True, None, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "requested boolean, native boolean, rate int, height int, kind string, seconds double")
    got = [tuple(r.s) for r in df.select(edits.slow_motion(*map(F.col, df.columns), interpolate=True).alias("s")).collect()]
    plain = (False, False, 1.0, 0.4)
    assert got == [(True, False, 2.0, 0.3), (True, True, 1.5, 0.125), plain, plain, plain, (True, False, 2.0, 0.3)]
    assert df.where("rate = 30").select(edits.slow_motion(*map(F.col, df.columns))["slow"]).first()[0] is False


def reasons_of(spark, status=None, clear=None, confidence=None, active=None, actor=None, said=None, focused=None, pending=None):
    df = spark.createDataFrame([(status, clear, confidence, active, actor, said, focused, pending)], "status string, clear boolean, confidence double, active boolean, actor string, said string, focused boolean, pending boolean")
    c = F.col
    out = policies.ambiguity_reasons({}, {"primary_actor_status": c("status")}, c("clear"), c("confidence"), {"multiple_active_subjects": c("active")}, c("actor"), c("pending"), c("said"), c("focused"))
    return df.select(out).first()[0]


def test_states_are_read_whatever_their_spelling(spark):
    for said in ("Identity Switch", " identity-switch\t", "IDENTITY_SWITCH"):
        assert reasons_of(spark, status=said) == ["primary_actor_status:identity_switch"]
    assert reasons_of(spark, status="Stable") == [] == reasons_of(spark)


def test_others_active_need_a_target_surely_centred(spark):
    gaps = ["primary_actor_id:missing", "primary_actor_clear:not_proven", "identity_continuity:not_proven_stable", "primary_actor_confidence:missing", "multiple_active_subjects"]
    assert reasons_of(spark, active=True) == gaps
    assert reasons_of(spark, "followed", True, 0.9, True, "a") == []
    assert reasons_of(spark, "followed", True, 0.5, True, "a") == ["primary_actor_confidence:0.500", "multiple_active_subjects"]
    assert reasons_of(spark, "followed", True, 0.9, True, " ") == ["primary_actor_id:missing", "multiple_active_subjects"]
    assert reasons_of(spark, "followed", True, 7.0, False, None) == []


def test_phrases_are_told_in_their_order_and_not_of_a_focused_stretch(spark):
    said = "One cannot tell which player it is; the target is obscured at the key moment, the camera loses track of the target"
    assert reasons_of(spark, said=said) == ["target_lost_description", "primary_actor_occluded_description", "primary_actor_unclear_description"]
    assert reasons_of(spark, said=said, focused=True, pending=True) == ["focused_subwindow_validation_required"]


def in_order(events):
    """A reel's ordinals in order, from (ordinal, quality, evidence)."""
    fit = [e for e in events if e[2] and e[1] is not None and e[1] >= 6.5]
    if not fit:
        return [e[0] for e in sorted(events, key=lambda e: e[1])]
    last = max(fit, key=lambda e: e[1])
    rest = sorted((e for e in events if e is not last), key=lambda e: -e[1])
    return [e[0] for e in [*rest[:1], *sorted(rest[1:], key=lambda e: (e[1], e[0])), last]]


def test_quality_orders_a_reel(spark):
    draw = random.Random(5)
    reels = {k: [(i, draw.randrange(0, 20) / 2, draw.random() < 0.6) for i in range(draw.randrange(1, 9))] for k in range(60)}
    df = spark.createDataFrame([(k, *e) for k, es in reels.items() for e in es], "reel int, ordinal int, quality double, evidence boolean")
    got = {}
    for r in timeline.quality_order(df, "reel").orderBy("reel", "place").collect():
        got.setdefault(r.reel, []).append(r.ordinal)
    assert got == {k: in_order(es) for k, es in reels.items()}


def plain_client(said, clients):
    if said is None:
        return None
    low = said.lower()
    for name, jersey, pattern in clients:
        j = (jersey or "").strip()
        if j and (f"#{j}" in low or f"number {j}" in low or f"no. {j}" in low or f" {j} " in low or low.endswith(f" {j}")):
            return name
        if pattern and pattern.lower() in low:
            return name
    return None


def test_the_first_client_in_any_of_the_forms(spark):
    draw = random.Random(11)
    clients = [(f"client{i}", draw.choice([None, "", " ", str(draw.randrange(1, 40))]), draw.choice([None, "", "Red", "x", "blue cap", "é", str(i)])) for i in range(60)]
    words = ["#7", "number 12", "NO. 3", "the", "Red", "blue", "cap", "5", "17", "é", "rider", "number", "ax", "4,"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 6))) for _ in range(300)] + [None, "", "  ", "7", " 7", "x" * 5000 + " 12", "wears 12"]
    texts += ["the same text"] * 200
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(clients)], "ordinal int, client string, jersey string, pattern string")
    df = spark.createDataFrame(list(enumerate(texts)), "row int, said string")
    got = {r.row: r.label for r in lookups.clients_of(df, "said", c).collect()}
    assert got == {i: plain_client(t, clients) for i, t in enumerate(texts)}
    assert {r.label for r in lookups.clients_of(df, "said", c.limit(0)).collect()} == {None}
    assert lookups.clients_of(df.limit(0), "said", c).count() == 0


def test_many_patterns_have_no_limit(spark):
    patterns = spark.range(12_000).selectExpr("id as ordinal", "concat('name ', id, '!') as pattern", "cast(id as string) as label")
    df = spark.createDataFrame([(1, "NAME 11999! and name 7!"), (2, "name 12000!"), (3, None)], "row int, said string")
    assert {r.row: r.label for r in lookups.first_pattern(df, "said", patterns).collect()} == {1: "7", 2: None, 3: None}


def test_json_is_written_in_one_way(spark):
    values = [{"b": [1, {"d": None, "a": "Ü"}], "a": "x\ty"}, {"emoji": "😀", "z": {}, "k": []}, [3, "q\"uote", True], "plain", 17, {"": 0}]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3)) for i, v in enumerate(values)] + [(98, "{not json"), (99, None)]
    df = spark.createDataFrame(rows, "row int, raw string")
    got = {r.row: (r.c, r.d) for r in df.select("row", text.canonical_json(F.col("raw")).alias("c"), text.json_digest(F.col("raw")).alias("d")).collect()}
    for i, v in enumerate(values):
        want = json.dumps(v, sort_keys=True, separators=(",", ":"))
        assert got[i][0] == want
        assert got[i][1] == hashlib.sha1(re.sub(r"\s+", " ", want.strip().lower()).encode()).hexdigest()[:16]
    assert got[98] == (None, hashlib.sha1(b"{not json").hexdigest()[:16]) and got[99] == (None, None)


def test_what_json_has_no_kind_for_becomes_text(spark):
    df = spark.sql("select named_struct('z', date'2024-02-03', 'a', array(named_struct('t', timestamp'2024-01-01 00:00:00', 'n', cast(null as int)))) as v")
    told = json.loads(df.select(text.cleaned_json(F.col("v"))).first()[0])
    assert list(told) == ["a", "z"] and told["z"] == "2024-02-03" and told["a"][0]["n"] is None and told["a"][0]["t"].startswith("2024-01-01")


def test_counters_gathered_on_the_way_are_those_counted(spark):
    rows = [(0, "a", 10.0, 30.0, True), (1, "a", 490.0, 500.0, False), (1, "b", 20.0, 19.0, True), (2, "b", 470.0, 900.0, True), (0, "c", 478.0, 490.0, True), (1, "c", None, 5.0, False)]
    c = spark.createDataFrame(rows, "chunk_index int, person string, start double, end double, selected boolean").withColumns({
        "source": F.lit("v"), "discarded": ~F.col("selected"), "selection_reason": F.when(F.col("selected"), "score"), "discard_cause": F.when(~F.col("selected"), "low"), "mine": F.lit(7)})
    chunks = timeline.chunk_specs(spark.createDataFrame([("v", 1440.0)], "source string, seconds double"), "source", "seconds", 480.0)
    judged = sessions.judged_candidates(c, chunks)
    passed, seen = sessions.counted_on_the_way(judged)
    out = {(r.person, r.start): r for r in passed.collect()}
    counted = sessions.candidate_counters(judged, []).first().asDict()
    assert seen.get == counted
    assert (counted["candidates"], counted["invalid"], counted["selected"], counted["discarded"]) == (6, 3, 2, 4)
    flipped = out[("chunk_01:b", 20.0)]
    assert (flipped.selected, flipped.discarded, flipped.discard_cause, flipped.originally_selected, flipped.selection_reason, flipped.end, flipped.mine) == (False, True, "invalid_numeric_window", True, None, 19.0, 7)
    assert sessions.candidate_counters(judged.limit(0), []).first().candidates == 0


def test_pages_go_on_where_the_last_ended(spark, tmp_path):
    rows = [(i % 7, i, f"row {i}") for i in range(230)]
    spark.createDataFrame(rows, "day int, id int, said string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    order, after, seen = [("day", True), ("id", False)], None, []
    while True:
        page = timeline.page_after(df, order, after, 500).collect()  # kept to 50
        seen += [r.id for r in page]
        if len(page) < 50:
            break
        after = (page[-1].day, page[-1].id)
    assert seen == [i for _, i, _ in sorted(rows, key=lambda r: (-r[0], r[1]))]
    plan = timeline.page_after(df, order, (3, 10), 50)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\],", plan).group(1)
    assert "LessThanOrEqual(day,3)" in pushed and "TakeOrderedAndProject" in plan


def test_a_table_keeps_its_contract(spark):
    df = spark.createDataFrame([], "id long, name string")
    got = {r.item: r.ok for r in reports.schema_contract(df, {"id": "bigint", "name": "int", "gone": "string"}).collect()}
    assert got == {"id": True, "name": False, "gone": False}


def test_from_moments_to_parts_and_their_timeline(spark, sf_dir):
    m = moments(spark, sf_dir).withColumn("end", F.col("start") + (F.col("end") - F.col("start")) / 40)
    chosen = decisions.selected_moments(m).cache()
    whole = {r.ordinal: r for r in m.collect()}
    kept = [r.ordinal for r in chosen.collect()]
    assert kept and len(kept) == len(set(kept)) and set(kept) <= set(whole)
    assert decisions.parts(m, "source").count() == len(kept)
    parts = decisions.parts(m).cache()
    assert {r.ordinal for r in parts.collect()} == set(kept)  # no selected moment is lost or told twice
    assert parts.where("part >= 0 and seconds > 86.25").count() == 0
    reels = parts.where("part >= 0").withColumn("reel", F.struct("person", "part"))
    told = decisions.timeline_of(reels, "reel").orderBy("reel", "place").collect()
    for a, b in zip(told, told[1:]):
        if a.reel == b.reel:
            assert b.place == a.place + 1 and b.rendered_start == pytest.approx(a.rendered_end - 0.25)
        else:
            assert b.place == 1 and b.rendered_start == 0
