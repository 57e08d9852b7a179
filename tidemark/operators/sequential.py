"""Rules that change what they have kept while they go on: mostly one group at a time, in pandas, after Spark has grouped and narrowed the rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geometry as g
from tidemark.operators import packing

SEGMENT = "source string, class string, raw string, canonical string"


def segments(detections: DataFrame) -> DataFrame:
    """One row for each (source, class, raw track): first and last time, box and frame. A track's millions of frames never reach Python."""
    order = F.struct("t", "frame")
    return detections.where("raw is not null").groupBy("source", "class", "raw").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.min_by(F.struct("x1", "y1", "x2", "y2", "width", "height"), order).alias("first"), F.max_by(F.struct("x1", "y1", "x2", "y2"), order).alias("last"),
    )


def continuations(flat: DataFrame, most_gap: float, most_distance: float, least_iou: float, least_area: float) -> DataFrame:
    """Which segment may go on from which: later and earlier segments (structs of their order) of one source, class and stretch, with the
    rank of the pair. Segments meet in bands of `most_gap` seconds of one's end and the other's begin, so no group is joined all against all."""
    band = lambda c: F.floor(F.col(c) / F.lit(max(most_gap, 1e-9)))
    order = F.struct("first_t", "last_t", "raw")
    box = lambda p: tuple(F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2"))
    early = flat.select("source", "class", "stretch", F.col("last_t").alias("a_end"), order.alias("earlier"), *(F.col(f"last_{c}").alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")), F.explode(F.array(band("last_t"), band("last_t") + 1)).alias("band"))
    late = flat.select("source", "class", "stretch", F.col("first_t").alias("b_start"), order.alias("later"), *(F.col(f"first_{c}").alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")), F.coalesce(F.nullif(F.hypot("width", "height"), F.lit(0.0)), F.lit(1.0)).alias("diagonal"), band("first_t").alias("band"))
    both = late.join(early, ["source", "class", "stretch", "band"])
    gap, overlap, away = F.col("b_start") - F.col("a_end"), g.iou(box("a"), box("b")), g.centre_distance(box("a"), box("b")) / F.col("diagonal")
    fit = gap.between(0, most_gap) & ((overlap >= least_iou) | (away <= most_distance)) & (g.area_ratio(box("a"), box("b")) >= least_area)
    return both.where((F.col("earlier") < F.col("later")) & fit).select("source", "class", "stretch", "later", "earlier", F.struct(away.alias("away"), gap.alias("gap"), (-overlap).alias("apart")).alias("rank"))


def stitched_tracks(detections: DataFrame, most_gap: float = 3.0, most_distance: float = 0.12, least_iou: float = 0.05, least_area: float = 0.15) -> DataFrame:
    """All detections with `track`: the canonical track that their raw track continues, and whether it was canonicalised.

    A segment may go on from one that ended at most `most_gap` seconds before, overlaps it or stands close, and is of like size. Segments
    in order of (first, last, raw) take, of those that none before took, the one whose last box is nearest (then: smallest gap, largest
    overlap, earlier segment); a chain of segments is one track, named after its first. Since a segment begins when the one it takes has ended, each
    track's end is always its last segment. Detections without a track pass through; `canonical` ids are text. Joins tell the possible pairs; only
    who takes whom is told in order, from the pairs of one stretch (cut by window functions where nothing was seen for `most_gap`) at a time.
    """
    flat = segments(detections).select(
        "source", "class", "raw", "first_t", "last_t", *(F.col(f"{p}.{c}").cast("double").alias(f"{p}_{c}") for p in ("first", "last") for c in ("x1", "y1", "x2", "y2")),
        F.col("first.width").cast("double").alias("width"), F.col("first.height").cast("double").alias("height"),
    )
    order = Window.partitionBy("source", "class").orderBy(F.asc_nulls_last("first_t"), "last_t", "raw")
    ended = F.max("last_t").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = flat.withColumn("fresh", F.when(F.col("first_t") - ended > most_gap, 1).otherwise(0)).withColumn("stretch", F.sum("fresh").over(order)).drop("fresh")
    pairs = continuations(cut, most_gap, most_distance, least_iou, least_area).select("source", "class", "stretch", F.col("later.raw").alias("later"), F.col("earlier.raw").alias("earlier"), F.struct("later", "rank", "earlier").alias("turn"))
    pairs = pairs.withColumn("turn", F.row_number().over(Window.partitionBy("source", "class", "stretch").orderBy("turn")))

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}
        gone: set[str] = set()
        for later, earlier in pdf.sort_values("turn")[["later", "earlier"]].itertuples(index=False):
            if later not in root and earlier not in gone:
                gone.add(earlier)
                root[later] = root.get(earlier, earlier)  # the earlier segment's own turn is over
        return pd.DataFrame({"source": pdf["source"].iloc[0], "class": pdf["class"].iloc[0], "raw": list(root), "canonical": list(root.values())})

    joined = pairs.groupBy("source", "class", "stretch").applyInPandas(named, SEGMENT)
    out = detections.join(joined, ["source", "class", "raw"], "left")
    known = F.col("raw").isNotNull()
    return out.withColumn("track", F.when(known, F.coalesce("canonical", "raw"))).withColumn("status", F.when(known, "canonicalized").otherwise("passthrough")).drop("canonical")


def stitch_summary(stitched: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: raw tracks, tracks after stitching, and how many were joined."""
    out = stitched.groupBy(*by).agg(F.count_distinct("class", "raw").alias("raw_tracks"), F.count_distinct("class", "track").alias("tracks"))
    return out.withColumn("joined", F.col("raw_tracks") - F.col("tracks"))


GUARD = ["same_fingerprint", "same_event_id", "same_source_time_overlap", "same_track_time_overlap"]  # fixed values: reasons, in the order in which they are told


def final_guard(events: DataFrame, key: list[str], same_source: float = 0.55, same_track: float = 0.70) -> DataFrame:
    """Rows with `kept`, `reason` and `rival`: in order of ordinal, a row that repeats a kept one (fingerprint, event id, source time, track time)
    either falls or, of better quality, takes its place; of several it meets the one whose place is oldest. Teasers neither fall nor strike.

    Columns: ordinal, fingerprint, event_id, source, track, start, end, quality, teaser. The order runs through each group of `key` (a reel);
    ordinals are unique within one.
    """
    needed = events.select(*key, "ordinal", "fingerprint", "event_id", "source", "track", "start", "end", "quality", "teaser")
    schema = T.StructType([*(needed.schema[k] for k in key), *T.StructType.fromDDL("ordinal long, kept boolean, reason string, rival long")])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ordinal", ignore_index=True)
        names = [pd.factorize(rows[c].where(rows[c].notna() & (rows[c] != "")))[0] for c in ("fingerprint", "event_id", "source", "track")]  # -1: not known
        start, end, quality = (rows[c].to_numpy(np.float64) for c in ("start", "end", "quality"))
        teaser = rows["teaser"].to_numpy(bool)
        places = np.zeros(0, np.int64)  # who holds each place, the oldest place first
        reason, rival = np.full(len(rows), None, object), np.full(len(rows), -1)
        for r in np.arange(len(rows)):
            shorter = np.minimum(end[r] - start[r], end[places] - start[places])
            share = (np.minimum(end[r], end[places]) - np.maximum(start[r], start[places])) / np.where(shorter > 0, shorter, np.inf)
            same = [(n[r] >= 0) & (n[places] == n[r]) for n in names]
            same[2] &= share >= same_source
            same[3] &= share >= same_track
            meets = np.flatnonzero(np.any(same, 0) & ~teaser[places] & ~teaser[r])
            if not len(meets):
                places = np.append(places, r)
                continue
            at = meets[0]
            loser, winner = (places[at], r) if quality[r] > quality[places[at]] else (r, places[at])
            reason[loser] = next(name for name, hit in zip(GUARD, same, strict=True) if hit[at])
            rival[loser] = rows["ordinal"].iloc[winner]
            places[at] = winner
        out = rows[key].assign(ordinal=rows["ordinal"], kept=pd.isna(reason), reason=reason, rival=pd.array(np.where(pd.isna(reason), None, rival), "Int64"))
        return out[[*key, "ordinal", "kept", "reason", "rival"]]

    return events.join(needed.groupBy(*key).applyInPandas(one, schema), [*key, "ordinal"])


# How much of a slow event is slowed, and how much, by score.
WHOLE_RIDE = [(9, 0.5, 2.5), (8, 0.4, 2.0)]
BEST_FIRST = [(9, 0.5, 2.5), (7, 0.4, 2.0), (-math.inf, 0.3, 1.5)]


def _packed(events: DataFrame, reel: str, order: list, budget: float, fade: float, levels: list, slow: str | None, alone: bool, by_source: bool = False) -> DataFrame:
    """Events with the part and seconds that `packing.parts` gives, in order of the given columns, with `by_source` of their sources as first seen before. An
    event too long for any part gets part -1 and its own seconds, or with `alone` a part for itself; one without a reel, an ordinal or both times gets neither."""
    seconds = F.col("end").cast("double") - F.col("start").cast("double")
    able = F.coalesce(F.col(slow).cast("boolean"), F.lit(False)) if slow else F.lit(False)
    rank, gain = packing.stretched(seconds, F.col("score"), able, levels)
    names = [f"_order{k}" for k in range(len(order))]
    sized = events.select(reel, "ordinal", seconds.alias("seconds"), rank.alias("rank"), gain.alias("gain"), *[c.alias(n) for c, n in zip(order, names, strict=True)], *(["source"] if by_source else []))
    sized = sized.where(F.col(reel).isNotNull() & F.col("ordinal").isNotNull() & F.col("seconds").isNotNull()).checkpoint()
    if by_source:
        seen = sized.groupBy(reel, "source").agg(F.min("ordinal").alias("_seen"))
        sized = sized.join(seen, [reel, "source"], "left").withColumn("_seen", F.coalesce("_seen", F.lit((1 << 63) - 1)))
        names = ["_seen", *names]
    own = F.greatest(F.lit(0.0), F.col("seconds") + F.col("gain"))
    found = packing.parts(sized if alone else sized.where(own <= budget), reel, names, budget, fade)
    if not alone:
        found = found.unionByName(sized.where(own > budget).select(reel, "ordinal", F.lit(-1).alias("part"), own.alias("seconds")))
    return events.join(found, [reel, "ordinal"], "left")


def packed_parts(events: DataFrame, reel: str, budget: float = 89.0 - 2.75, fade: float = 0.25, slow: str | None = None) -> DataFrame:
    """Rows with `part` (from 0) and `seconds` (of the whole part): whole events in order of (source first seen, start, ordinal), a new part where the next
    would not fit; events without a source come last. Fades shorten a part; with a column `slow`, its best scored slow event of 8 or more is stretched. An
    event that fits in no part gives part -1. Ordinals are unique within a reel. Reels may be of any length (see `packing.parts`); a checkpoint folder must be set.
    """
    return _packed(events, reel, [F.col("start"), F.col("ordinal")], budget, fade, WHOLE_RIDE, slow, alone=False, by_source=True)


def part_annotations(packed: DataFrame, reel: str) -> DataFrame:
    """Packed events with their part's number (from 1) and count, their place in the part and in the reel (from 1), and both totals; part -1 is left out."""
    placed = packed.where("part >= 0")
    order = ["part", "source_seen", "start", "ordinal"]
    whole, part = Window.partitionBy(reel), Window.partitionBy(reel, "part")
    seen = placed.withColumn("source_seen", F.min("ordinal").over(Window.partitionBy(reel, "source")))
    return seen.select(
        *packed.columns, (F.col("part") + 1).alias("part_number"), (F.max("part").over(whole) + 1).alias("part_count"), F.row_number().over(part.orderBy(*order)).alias("place_in_part"),
        F.count(F.lit(1)).over(part).alias("events_in_part"), F.row_number().over(whole.orderBy(*order)).alias("place_in_reel"), F.count(F.lit(1)).over(whole).alias("events_in_reel"),
    )


def scored_parts(events: DataFrame, reel: str, budget: float = 85.0, fade: float = 0.25, slow: str | None = None) -> DataFrame:
    """Rows with `part` and its `seconds`: next-fit packing by falling score (ties: ordinal). Fades shorten a part; with a column `slow` its best scored slow
    event is stretched, whatever its score. A longer event has a part for itself; events without a score come last. Ordinals are unique within a reel. Reels may
    be of any length (see `packing.parts`); a checkpoint folder must be set."""
    falling = F.coalesce(-F.col("score").cast("double"), F.lit(math.inf))
    return _packed(events, reel, [falling, F.col("ordinal")], budget, fade, BEST_FIRST, slow, alone=True)


def slow_runs_broken(events: DataFrame, reel: str) -> DataFrame:
    """Rows with `place`: where two slow events stand side by side, the second changes places with the next that isn't slow, if there is one
    before the last. The first and the last event keep their places. One pass does: what a place was given stays good for it. Ordinals are unique within a reel;
    an event without a reel or ordinal gets no place, a null `slow` is none."""
    schema = T.StructType([events.schema[reel], *T.StructType.fromDDL("ordinal long, place int")])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ordinal")
        slow, who = rows["slow"].to_numpy(bool).copy(), rows["ordinal"].to_numpy().copy()
        for k in np.arange(1, len(who) - 1):
            plain = np.flatnonzero(~slow[k + 1 : -1]) if slow[k - 1] and slow[k] else ()
            if len(plain):
                two = [k, k + 1 + plain[0]]
                slow[two], who[two] = slow[two[::-1]], who[two[::-1]]
        return rows[[reel]].assign(ordinal=who, place=np.arange(len(who)))

    known = events.where(F.col(reel).isNotNull() & F.col("ordinal").isNotNull()).select(reel, "ordinal", F.coalesce("slow", F.lit(False)).alias("slow"))
    return events.join(known.groupBy(reel).applyInPandas(one, schema), [reel, "ordinal"], "left")


def consuming_matches(wanted: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """wanted_id and offer_id: each wanted row in order takes the free offer of its key with the nearest end; no offer is taken twice."""
    both = wanted.select(*key, F.col("wanted_id").alias("id"), F.col("end"), F.lit(0).alias("side")).unionByName(offered.select(*key, F.col("offer_id").alias("id"), F.col("end"), F.lit(1).alias("side")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        free = pdf[pdf.side == 1].sort_values("id")[["id", "end"]].values.tolist()
        out = []
        for i, end in pdf[pdf.side == 0].sort_values("id")[["id", "end"]].values.tolist():
            if free:
                best = min(range(len(free)), key=lambda k: abs(free[k][1] - end))
                out.append((int(i), int(free.pop(best)[0])))
        return pd.DataFrame(out, columns=["wanted_id", "offer_id"])

    return both.groupBy(*key).applyInPandas(one, "wanted_id long, offer_id long")


def dropped_by_defects(events: DataFrame, reel: str) -> DataFrame:
    """Rows with `kept`: in order, an event with a blocking defect falls unless it is the last real (not teaser) one left."""
    real = Window.partitionBy(reel)
    left = F.sum(F.when(~F.col("teaser"), 1).otherwise(0)).over(real)
    falling = F.sum(F.when(F.col("blocking") & ~F.col("teaser"), 1).otherwise(0)).over(real.orderBy("ordinal"))
    stays = ~F.col("blocking") | (~F.col("teaser") & (falling == left))
    return events.withColumn("kept", stays)


def iou_columns(df: DataFrame) -> DataFrame:
    """iou, centre distance and area ratio of boxes a_* and b_*."""
    a, b = (tuple(F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")) for p in "ab")
    return df.withColumn("iou", g.iou(a, b)).withColumn("distance", g.centre_distance(a, b)).withColumn("area_ratio", g.area_ratio(a, b))
