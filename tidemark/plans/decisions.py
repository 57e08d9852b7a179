"""From raw moments to parts, and from drafts to a status, as ordered lists of transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import recovered, safe_div, valid_window
from tidemark.operators import greedy, overlap, reports, sequential, timeline


def selected_moments(moments: DataFrame, person: list[str] | None = None, least: float = 5.0) -> DataFrame:
    """Moments (ordinal, source, person, start, end, score) that are selected: time stamps recovered, candidates chosen by person, windows of a source made unique."""
    r = recovered(F.col("start"), F.col("end"), least)
    read = moments.withColumn("_r", r).withColumn("start", F.col("_r.start")).withColumn("end", F.col("_r.end")).drop("_r")
    chosen = greedy.selector_candidates(read, person or ["source", "person"], "ordinal", least).where("selected").drop("selected", "discard_cause", "selection_reason")
    return greedy.source_window_dedup(chosen).where("kept").drop("kept", "duplicate_of")


def parts(moments: DataFrame, reel: str = "person") -> DataFrame:
    """Selected moments in parts that fit a reel; `reel` names whose reel it is."""
    return sequential.packed_parts(selected_moments(moments), reel)


def window_report(windows: DataFrame, key: list[str], draft: str, ordinal: str) -> DataFrame:
    """Of each key: possible pairs of windows of different drafts, overlapping pairs, and their rate with its honest denominator."""
    good = windows.where(valid_window(F.col("start"), F.col("end"), F.lit("known")))
    pairs = overlap.overlapping_pairs(good, key, ordinal, differ=draft).groupBy(*(F.col("l_" + k).alias(k) for k in key)).agg(F.count(F.lit(1)).alias("pairs"), F.sum("overlap_seconds").alias("seconds"))
    out = overlap.possible_pairs(good, key, draft).join(pairs, key, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0))).withColumn("seconds", F.coalesce("seconds", F.lit(0)))
    return out.withColumn("rate", safe_div(F.col("pairs"), F.col("possible_pairs")))


def run_status(metrics: DataFrame, by: str, limits: list[tuple[str, float, str]]) -> DataFrame:
    return reports.status(metrics, reports.alerts(metrics, limits, by), by)


def timeline_of(moments: DataFrame, reel: str) -> DataFrame:
    """Moments in narrative order with their rendered times."""
    return timeline.rendered_timeline(timeline.narrative_order(moments, reel), reel, ordinal="place")
