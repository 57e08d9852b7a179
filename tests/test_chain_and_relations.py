"""The chain of cluster steps, relatedness, names, teasers and transitions: small cases with known answers, and plain programs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.operators import chain, identity, ledger, timeline

CLUSTERS = "cluster long, description string, position long, ident string, clip string, own string"
PEOPLE = "ident string, clip string, own string, position long"
VERDICTS = "cluster string, same_person boolean, bad array<string>"


# the chain


def or_unknown(said):
    return "unknown athlete" if said is None else said


def numbers(said):
    low = (said or "").lower()
    return set(re.findall(r"(?:#|number\s+|no\.\s*|bib\s+|jersey\s+)(\d{1,3})", low)) | set(re.findall(r"\bplayer\s+(\d{1,3})\b", low))


def plain_split(clusters):
    out = []
    for name, said, apps in clusters:
        clips, seen, clash = [a[1] for a in apps], set(), False
        for a in apps:
            n = numbers(a[2])
            clash |= bool(seen and n and seen.isdisjoint(n))
            seen |= n
        bad = len(set(clips)) < len(clips) or clash
        out += [(f"{name}/{a[0]}", a[2] or or_unknown(said), [a]) for a in apps] if bad else [(name, said, apps)]
    return out


def plainly(clusters, everyone, verdicts):
    present = {a[0] for _, _, apps in clusters for a in apps}
    clusters = plain_split(clusters + [(f"new/{p[0]}", p[2] or "unknown athlete", [p]) for p in everyone if p[0] not in present])
    held, merged = {}, []
    for name, said, apps in clusters:
        key = re.sub(r"[^a-z0-9 ]", "", (said or "").lower()).strip()
        if key and key in held and not {a[1] for a in held[key][2]} & {a[1] for a in apps}:
            held[key][2].extend(apps)
            continue
        merged.append((name, said, list(apps)))
        if key:
            held.setdefault(key, merged[-1])
    out = []
    for name, said, apps in plain_split(merged):
        same, bad = verdicts.get(name, (True, []))
        bad = [a for a in apps if a[0] in bad]
        if len(apps) < 2 or (same and not bad):
            out.append((name, said, apps))
        elif not bad or len(bad) == len(apps):
            out += [(f"{name}/{a[0]}", a[2] or or_unknown(said), [a]) for a in apps]
        else:
            out.append((name, said, [a for a in apps if a not in bad]))
            out += [(f"{name}/{a[0]}", a[2] or or_unknown(said) + " (separated)", [a]) for a in bad]
    return {a[0]: (name, said) for name, said, apps in plain_split(out) for a in apps}


@pytest.mark.parametrize("seed", range(3))
def test_chain_like_a_plain_program(spark, seed):
    rnd = random.Random(seed)
    own = lambda: rnd.choice(["", None, "red shirt", "player 7", "#7 and bib 9", "no. 9", "blue board"])
    everyone = [(f"p{k}", f"c{rnd.randrange(25)}", own(), k) for k in range(160)]
    people, clusters = everyone[:120], []
    rnd.shuffle(people)
    while people:
        n = rnd.choice([1, 1, 2, 2, 3, 4])
        clusters.append((str(len(clusters)), rnd.choice(["Red shirt!", "red shirt", "blue", "", None, "green  board"]), [p[:3] for p in people[:n]]))
        people = people[n:]
    verdicts = {c: (rnd.random() < 0.5, rnd.sample([a[0] for a in apps], rnd.randrange(len(apps) + 1))) for c, _, apps in clusters if rnd.random() < 0.5}
    rows = [(int(c), said, k, *a) for c, said, apps in clusters for k, a in enumerate(apps)]
    members = chain.members_of(spark.createDataFrame(rows, CLUSTERS).repartition(3))
    out = chain.post_processed(members, spark.createDataFrame(everyone, PEOPLE), spark.createDataFrame([(c, s, b) for c, (s, b) in verdicts.items()], VERDICTS)).collect()
    assert len(out) == 160 and {r.ident: (r.cluster, r.description) for r in out} == plainly(clusters, [e[:3] for e in everyone], verdicts)


def test_chain_keeps_ids_and_says_what_it_did(spark):
    rows = [(1, "Red", 0, "a", "c1", ""), (1, "Red", 1, "b", "c2", ""), (2, "red!", 0, "c", "c3", ""), (3, "red", 0, "d", "c2", ""), (4, "x", 0, "e", "c4", "#7"), (4, "x", 1, "f", "c5", "#8")]
    people = [(i, c, o, k) for k, (i, c, o) in enumerate([("a", "c1", ""), ("z", "c9", None)])]
    out = chain.post_processed(chain.members_of(spark.createDataFrame(rows, CLUSTERS)), spark.createDataFrame(people, PEOPLE), spark.createDataFrame([("1", True, ["c"])], VERDICTS))
    got = {r.ident: (r.cluster, r.description, r.lineage) for r in out.collect()}
    assert got["a"] == ("1", "Red", []) and got["b"] == ("1", "Red", [])
    assert got["c"] == ("1/c", "Red (separated)", ["merged:2", "verified_out"])
    assert got["d"] == ("3", "red", [])  # shares a clip with what the first one holds
    assert got["e"] == ("4/e", "#7", ["split:numbers"]) and got["f"] == ("4/f", "#8", ["split:numbers"])
    assert got["z"] == ("new/z", "unknown athlete", ["added"])
    none = spark.createDataFrame([], CLUSTERS)
    assert chain.post_processed(chain.members_of(none), spark.createDataFrame([], PEOPLE), spark.createDataFrame([], VERDICTS)).collect() == []


# relatedness


def test_relatedness_like_a_plain_program(spark):
    rnd = random.Random(4)
    vocabulary = ["red", "black", "board", "wetsuit", "tall", "curly", "left", "goofy", *(f"word{k}" for k in range(12))]
    say = lambda: sorted(set(rnd.sample(vocabulary, rnd.choice([0, 1, 3, 6, 9]))))
    drafts = [(k, f"d{k}", say()) for k in range(12)]
    candidates = []
    for k in range(250):
        s = rnd.choice([None, float(rnd.randrange(900))])
        candidates.append((k, rnd.choice([None, "d1", "d2", "d3", "d9"]), say(), s, None if s is None else s + rnd.choice([1.0, 30.0, 200.0]), rnd.choice([None, 1, 5, 9]), rnd.random() < 0.3, rnd.random() < 0.6))
    sim = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 3) if a and b else 0.0
    want = []
    for i, name, label in drafts:
        anchor = next((c for c in candidates if c[6] and c[1] in (name, None)), None)
        rows = []
        for c in candidates:
            if c[6] and c[1] == name:
                continue
            shared = sorted(set(c[2]) & set(label) & set(text.COLORS_AND_EQUIPMENT))
            gap = None if c[3] is None or anchor[3] is None else round(max(0.0, anchor[3] - c[4], c[3] - anchor[4]), 2)
            r = round(sim(c[2], label) + 0.15 * len(shared) + 0.5 * sim(c[2], anchor[2]) + (0.25 if gap is not None and gap <= 60 else 0), 3)
            if r >= 0.45:
                rows.append((c[7] and (r >= 0.9 or len(shared) >= 2), c[5] or 0, r, c[0]))
        rows.sort(key=lambda x: (not x[0], -x[1], -x[2], x[3]))
        want += [(i, c, r, f, n) for n, (f, _, r, c) in enumerate(rows[:10], 1)]
    d = spark.createDataFrame(drafts, "draft_id long, name string, tokens array<string>")
    c = spark.createDataFrame(candidates, "candidate_id long, draft_name string, tokens array<string>, start double, end double, score int, selected boolean, discarded boolean")
    got = sorted((r.draft_id, r.candidate_id, r.relatedness, r.fragment, r["rank"]) for r in ledger.relatedness(d, c).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)] and all(abs(g[2] - w[2]) < 0.0011 for g, w in zip(got, sorted(want), strict=True))


# names, teasers, transitions


def test_names_take_the_next_free_number_before_the_suffix(spark):
    names = ["a", "a", "a_02", "clip.mp4", "clip.mp4", "clip.mp4", "clip_02.mp4", "b.mov", "b.mov", "a_02.mp4", "a"]
    df = spark.createDataFrame(list(enumerate(names)), "ordinal long, name string")
    got = [r.unique_name for r in timeline.unique_names(df, "name", "ordinal").orderBy("ordinal").collect()]
    assert got == ["a", "a_02.mp4", "a_02", "clip.mp4", "clip_02.mp4", "clip_03.mp4", "clip_02_02.mp4", "b.mov", "b_02.mov", "a_02_02.mp4", "a_03.mp4"]
    many = spark.createDataFrame([(k, "x") for k in range(120)], "ordinal long, name string")
    last = timeline.unique_names(many, "name", "ordinal").orderBy("ordinal").collect()
    assert last[1].unique_name == "x_02.mp4" and last[119].unique_name == "x_120.mp4"


def test_teasers_show_the_peak_in_full(spark):
    rows = [("a", 1, 0.0, 10.0), ("a", 2, 0.0, 20.0), ("b", 1, 0.0, 4.5), ("b", 2, 3.0, 7.5), ("c", 1, 100.0, 140.0), ("d", 1, 0.0, 9.0), ("e", 1, 0.0, 8.0), ("e", 2, 0.0, 4.6)]
    out = timeline.teasers(spark.createDataFrame(rows, "reel string, place int, start double, end double"), "reel").where("teaser").collect()
    got = {r.reel: (round(r.start, 6), round(r.end, 6), r.place) for r in out}
    assert got == {"a": (11.75, 14.25, 0), "c": (112.5, 115.0, 0), "d": (6.5, 9.0, 0), "e": (1.74, 4.24, 0)}


def test_zoom_moves_to_the_event_before_the_last(spark):
    def rule(wanted):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(wanted, 1)], "place int, wanted string")
        said = scores.transitions(F.col("place"), F.lit(len(wanted)), F.col("wanted"), F.lit("zoom" in wanted))
        return [r[0] for r in df.orderBy("place").select(said).collect()]

    assert rule(["zoom", "slide", "slide", "cut"]) == ["slide", "slide", "zoom", "cut"]
    assert rule(["cut", "zoom"]) == ["cut", "slide"] and rule(["zoom", "cut"]) == ["zoom", "cut"] and rule(["cut", "fade", "cut"]) == ["cut", "fade", "cut"]


def test_edges_are_vetoed_by_other_shirt_numbers(spark):
    best = [(i, o, 0.95, 1) for i, o in ((1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5))]
    said = [(1, "#7"), (2, "player 8"), (3, "#7 or #8"), (4, "bib 8"), (5, "#9")]
    numbers = spark.createDataFrame(said, "id long, own string").select("id", text.shirt_numbers(F.col("own")).alias("numbers"))
    df = spark.createDataFrame(best, "id long, other long, similarity double, rank int")
    edges = lambda **more: sorted(tuple(r) for r in identity.mutual_edges(df, "id", **more).collect())
    assert edges() == [(1, 2), (3, 4), (5, 6)] and edges(numbers=numbers) == [(3, 4), (5, 6)]
