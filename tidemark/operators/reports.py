"""Coverage, quality and learning reports. Rates carry their denominators; unknown is never counted as passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import safe_div

SEVERITY = {"pass": 0, "inconclusive": 1, "hard_block": 2}


def coverage(candidates: DataFrame, cluster: str) -> DataFrame:
    """Of each cluster: candidates, selected, seconds, selected seconds, utilisation, represented, its commonest discard reason (first in time on ties)
    and outcome. Columns: ordinal, start, end, selected, discard_cause."""
    seconds = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    base = candidates.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("selected").alias("selected"), F.sum(seconds).alias("candidate_seconds"),
        F.sum(F.when(F.col("selected"), seconds).otherwise(0)).alias("selected_seconds"), F.count_if(F.col("discard_cause").isNotNull()).alias("explained"),
    )
    causes = candidates.where("discard_cause is not null").groupBy(cluster, "discard_cause").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    common = causes.groupBy(cluster).agg(F.min_by("discard_cause", F.struct(-F.col("n"), F.col("first"))).alias("reason"))
    out = base.join(common, cluster, "left")
    outcome = F.when(F.col("selected") > 0, "selected_for_render").when(F.col("reason").isNotNull(), F.col("reason")).otherwise("unresolved_selection_path")
    return out.withColumn("utilisation", safe_div(F.col("selected_seconds"), F.col("candidate_seconds"))).withColumn("represented", F.col("selected") > 0).withColumn("outcome", outcome).withColumn("accounted", outcome != "unresolved_selection_path")


def coverage_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if("represented").alias("represented"), F.count_if("accounted").alias("accounted"),
        F.count_if(~F.col("accounted")).alias("gaps"), F.sum("candidate_seconds").alias("candidate_seconds"), F.sum("selected_seconds").alias("selected_seconds"),
    )


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"))


def fragmentation(detections: DataFrame, source: str, track: str, time: str = "t", short: float = 2.0, least_tracks: int = 10, most_rate: float = 0.5) -> DataFrame:
    """Of each source: tracks, tracks shorter than `short` seconds, and whether they are too many."""
    per = detections.where(F.col(track).isNotNull()).groupBy(source, track).agg((F.max(time) - F.min(time)).alias("seconds"))
    out = per.groupBy(source).agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("seconds") < short).alias("short_tracks"))
    return out.withColumn("fragmented", (F.col("tracks") >= least_tracks) & (F.col("short_tracks") >= F.col("tracks") * most_rate))


def mixed_windows(hits: DataFrame, window: str, track: str, least_hits: int = 4, least_tracks: int = 2, most_share: float = 0.7) -> DataFrame:
    """Windows with several tracks none of which dominates: hits, tracks, hits of the commonest."""
    per = hits.where(F.col(track).isNotNull()).groupBy(window, track).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(window).agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("tracks"), F.max("n").alias("dominant"))
    return out.where((F.col("hits") >= least_hits) & (F.col("tracks") >= least_tracks) & (F.col("dominant") <= F.col("hits") * most_share))


def frame_concurrency(hits: DataFrame, window: str, frame: str, track: str, primary: str) -> DataFrame:
    """Of each window: frames, frames with several tracks, the most at once, frames that show the primary."""
    per = hits.groupBy(window, frame).agg(F.count_distinct(track).alias("n"), F.bool_or(F.coalesce(F.col(track) == F.col(primary), F.lit(False))).alias("own"))
    return per.groupBy(window).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("n") > 1).alias("concurrent_frames"), F.max("n").alias("most_at_once"), F.count_if("own").alias("primary_frames"))


def duplicate_athletes(drafts: DataFrame, athlete: str, draft: str, source: str) -> DataFrame:
    """Strong ids whose drafts have at least two different sets of sources, with their drafts."""
    sets = drafts.where(F.trim(F.col(athlete)) != "").groupBy(athlete, draft).agg(F.array_sort(F.collect_set(source)).alias("sources"))
    out = sets.groupBy(athlete).agg(F.count_distinct("sources").alias("source_sets"), F.array_sort(F.collect_list(draft)).alias("drafts"))
    return out.where("source_sets > 1")


def alerts(metrics: DataFrame, limits: list[tuple[str, float, str]], by: str) -> DataFrame:
    """One row for each metric of a run over its limit: by, metric, value, severity. A null metric is inconclusive. limits: (metric, most, severity)."""
    pairs = ", ".join(f"'{m}', cast({m} as double), cast({most} as double), '{s}'" for m, most, s in limits)
    long = metrics.select(by, F.expr(f"stack({len(limits)}, {pairs}) as (metric, value, most, severity)"))
    severity = F.when(F.col("value").isNull(), "inconclusive").otherwise(F.col("severity"))
    return long.where("value is null or value > most").select(by, "metric", "value", severity.alias("severity"))


def status(runs: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Each run's status: the worst severity of its alerts, else pass."""
    rank = F.max(F.when(F.col("severity") == "hard_block", 2).otherwise(1)).alias("rank")
    out = runs.select(by).join(found.groupBy(by).agg(rank, F.count(F.lit(1)).alias("alerts")), by, "left")
    return out.select(by, F.coalesce("alerts", F.lit(0)).alias("alerts"), F.when(F.col("rank") == 2, "hard_block").when(F.col("rank") == 1, "inconclusive").otherwise("pass").alias("status"))


def counts_by(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """A map of counts of each item."""
    per = df.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(item), "n")))).alias("counts"))


def decayed_labels(rows: DataFrame, by: list[str], label: str, days: Column, half_life: float = 30.0, least: int = 3, k: int = 6) -> DataFrame:
    """Of each group the k labels with the largest decayed weight, among those with `least` rows; ties to the label."""
    from tidemark.functions.scores import decay

    per = rows.groupBy(*by, label).agg(F.sum(decay(days, half_life)).alias("weight"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    w = Window.partitionBy(*by).orderBy(F.desc("weight"), label)
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def indexed_percentile(values: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The value at place max(1, floor(n * share)) of each group in order, no interpolation. Equal values are counted first, so a group's rows
    never come together, only its different values."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("_past", F.sum("_k").over(w.orderBy(value))).withColumn("_n", F.sum("_k").over(w))
    place = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return ranked.where((F.col("_past") >= place) & (F.col("_past") - F.col("_k") < place)).select(*by, F.col(value).alias("suggested"), F.col("_n").alias("n"))


def calibration(rows: DataFrame, by: list[str], approved: str, engagement: str) -> DataFrame:
    """Of each group: approvals, and the median engagement of what was approved."""
    return rows.where(F.col(approved)).groupBy(*by).agg(F.count(F.lit(1)).alias("approvals"), F.median(engagement).alias("middle"))


def threshold_suggestion(labelled: DataFrame, provisional: DataFrame, by: list[str], value: str, current: float, least: int = 5, everyone: DataFrame | None = None) -> DataFrame:
    """The lower quartile of labelled values, else the 0.4 place of provisional ones, else the current threshold; with where it came from. Groups are those of
    either table, or of `everyone`."""
    a = indexed_percentile(labelled, by, value, 0.25).where(F.col("n") >= least).select(*by, F.col("suggested").alias("a"))
    b = indexed_percentile(provisional, by, value, 0.40).where(F.col("n") >= least).select(*by, F.col("suggested").alias("b"))
    groups = (labelled.select(*by).union(provisional.select(*by)) if everyone is None else everyone.select(*by)).distinct()
    out = groups.join(a, by, "left").join(b, by, "left")
    return out.select(*by, F.coalesce("a", "b", F.lit(current)).alias("threshold"), F.when(F.col("a").isNotNull(), "labelled").when(F.col("b").isNotNull(), "provisional").otherwise("current").alias("basis"))


def revenue(rows: DataFrame, by: list[str], at: str, amount: str, as_of: str) -> DataFrame:
    """Amounts of the day, the last seven days and the month of `as_of`, in one pass."""
    day = F.to_date(F.lit(as_of))
    d = F.to_date(F.col(at))
    part = lambda c: F.sum(F.when(c, F.col(amount)).otherwise(0))
    return rows.groupBy(*by).agg(
        part(d == day).alias("today"), part((d <= day) & (d > F.date_sub(day, 7))).alias("last_7_days"), part((F.trunc(d, "month") == F.trunc(day, "month")) & (d <= day)).alias("month"), F.count(F.lit(1)).alias("rows")
    )


def funnel(rows: DataFrame, user: str, kind: str, steps: list[str]) -> DataFrame:
    """step, users: those who did this step and all before it, at any time."""
    per = rows.groupBy(user).agg(*(F.bool_or(F.col(kind) == s).alias(f"s{k}") for k, s in enumerate(steps)))
    reached, out = F.lit(True), []
    for k in range(len(steps)):
        reached = reached & F.col(f"s{k}")
        out.append(F.count_if(reached).alias(steps[k]))
    one = per.agg(*out)
    pairs = ", ".join(f"'{s}', {s}" for s in steps)
    return one.select(F.expr(f"stack({len(steps)}, {pairs}) as (step, users)"))


def manifest_violations(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each broken rule: athlete, rule, detail. parts: athlete, part_index, file_name, seconds, width, height, qa_passed, qa_recorded, has_audio, published.
    expected: athlete, expected_parts."""
    w = Window.partitionBy("athlete").orderBy("part_index")
    gaps = parts.withColumn("_want", F.row_number().over(w)).where(F.col("part_index") != F.col("_want")).select("athlete", F.lit("part_order").alias("rule"), F.col("part_index").cast("string").alias("detail"))
    twice = parts.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.min("athlete").alias("athlete")).where("n > 1").select("athlete", F.lit("file_name_repeated").alias("rule"), F.col("file_name").alias("detail"))
    bad = {
        "too_long": F.col("seconds") > 90, "qa_not_recorded": F.col("published") & ~F.col("qa_recorded"), "qa_not_passed": F.col("published") & ~F.coalesce("qa_passed", F.lit(False)),
        "audio": F.coalesce("has_audio", F.lit(True)), "height": F.col("height") < 1280,
    }
    broken = [parts.where(c).select("athlete", F.lit(rule).alias("rule"), F.col("file_name").alias("detail")) for rule, c in bad.items()]
    count = parts.groupBy("athlete").agg(F.count(F.lit(1)).alias("n"))
    sizes = expected.join(count, "athlete", "full_outer").where(~F.col("n").eqNullSafe(F.col("expected_parts"))).select("athlete", F.lit("part_count").alias("rule"), F.concat_ws("/", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("expected_parts", F.lit(0)).cast("string")).alias("detail"))
    out = gaps.unionByName(twice).unionByName(sizes)
    for b in broken:
        out = out.unionByName(b)
    return out


def schema_contract(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """item and ok for each wanted column and type."""
    have = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(c, have.get(c) == t) for c, t in wanted.items()], "item string, ok boolean")


def issue_reasons(rows: DataFrame, by: list[str], reason: str) -> DataFrame:
    """The distinct reasons of each group, sorted and joined; groups without one have an empty text."""
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(reason)), ", ").alias("reasons"))


def grouped_reels(rows: DataFrame, by: list[str], ordinal: str, item: str) -> DataFrame:
    """Groups with their first row's ordinal (their order) and their items in order."""
    out = rows.groupBy(*by).agg(F.min(ordinal).alias("first"), F.array_sort(F.collect_list(F.struct(ordinal, item))).alias("_i"))
    return out.select(*by, "first", F.transform("_i", lambda x: x[item]).alias("items"))


def draft_trace(windows: DataFrame, draft: str) -> DataFrame:
    """Of each draft: bounds, windows, sources (distinct, sorted), whether every window names its athlete, and the best score."""
    named = F.coalesce(F.trim(F.col("athlete").cast("string")) != "", F.lit(False))
    return windows.groupBy(draft).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("windows"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_and(named).alias("lineage_complete"), F.max("score").alias("score")
    )


def constraint_violations(rows: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """id and rule of every row that breaks a rule. Like CHECK, an unknown result breaks nothing."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return rows.select(F.col(ident), F.explode(broken).alias("rule"))


def coverage_violations(rows: DataFrame, summary: DataFrame, run: str) -> DataFrame:
    """run, rule: athletes named twice, unaccounted athletes, and totals that differ from the summary's. rows: run, athlete, accounted; summary: run, athletes, accounted."""
    twice = rows.groupBy(run, "athlete").count().where("count > 1").select(run, F.lit("athlete_repeated").alias("rule")).distinct()
    gaps = rows.where(~F.col("accounted")).select(run, F.lit("athlete_unaccounted").alias("rule")).distinct()
    own = rows.groupBy(run).agg(F.count_distinct("athlete").alias("n"), F.count_if("accounted").alias("k"))
    both = own.join(summary.select(F.col(run).alias("_run"), "athletes", F.col("accounted").alias("said")), F.col(run) == F.col("_run"), "full_outer").select(F.coalesce(run, "_run").alias(run), "n", "k", "athletes", "said")
    wrong = both.where(~F.col("n").eqNullSafe(F.col("athletes")) | ~F.col("k").eqNullSafe(F.col("said"))).select(run, F.lit("summary_differs").alias("rule"))
    return twice.unionByName(gaps).unionByName(wrong)


def run_metrics(drafts: DataFrame, sidecars: DataFrame, detections: DataFrame, overlaps: DataFrame, mixed: DataFrame, fragments: DataFrame, videos: int, exit_code: int | None = None, summary_found: bool = True, trace_found: bool = False) -> DataFrame:
    """One row of a run's counts and rates; each rate is 0 where its denominator is.

    drafts: has_window, duplicate, in_trace (the decision trace tells of it); sidecars: valid; detections: track, box_valid, time_valid, confidence; overlaps and mixed: a row for each pair and
    window found; fragments: tracks, short_tracks (see fragmentation). summary_found, trace_found: the run's summary and any trace file are there; a trace that tells
    of a draft is one. Each table is summed up by itself, and only these sums meet.
    """
    d = drafts.agg(F.count(F.lit(1)).alias("draft_count"), F.count_if("has_window").alias("_windows"), F.count_if("duplicate").alias("duplicate_athlete_likely_draft_count"), F.count_if("in_trace").alias("draft_metadata_count"))
    s = sidecars.agg(F.count_if("valid").alias("sidecar_count"), F.count_if(~F.col("valid")).alias("_errors"))
    e = detections.agg(
        F.count(F.lit(1)).alias("detection_count"), F.count_distinct("track").alias("unique_track_count"), F.count_if(F.col("track").isNull()).alias("_untracked"), F.count_if(~F.col("box_valid")).alias("_boxes"),
        F.count_if(~F.col("time_valid")).alias("_times"), F.min("confidence").alias("least_confidence"), F.max("confidence").alias("most_confidence"),
    )
    o, m = overlaps.agg(F.count(F.lit(1)).alias("source_window_overlap_pair_count")), mixed.agg(F.count(F.lit(1)).alias("mixed_subject_likely_window_count"))
    f = fragments.agg(F.coalesce(F.sum("tracks"), F.lit(0)).alias("_tracks"), F.coalesce(F.sum("short_tracks"), F.lit(0)).alias("short_track_count"))
    one = d
    for other in (s, e, o, m, f):
        one = one.join(F.broadcast(other))  # one row each
    n, c = F.col("draft_count"), F.col("detection_count")
    rates = {
        "draft_source_window_coverage_rate": safe_div(F.col("_windows"), F.greatest(n, F.lit(1))), "source_window_overlap_duplicate_rate": safe_div(F.col("source_window_overlap_pair_count"), n * (n - 1) / 2),
        "mixed_subject_violation_rate": safe_div(F.col("mixed_subject_likely_window_count"), F.greatest(n, F.lit(1))), "duplicate_athlete_violation_rate": safe_div(F.col("duplicate_athlete_likely_draft_count"), F.greatest(n, F.lit(1))),
        "short_track_rate": safe_div(F.col("short_track_count"), F.col("_tracks")), "sidecar_missing_rate": F.when((F.lit(videos) > 0) & (F.col("sidecar_count") == 0), 1.0).otherwise(0.0),
        "sidecar_schema_error_rate": safe_div(F.col("_errors"), F.greatest(F.col("sidecar_count") + F.col("_errors"), F.lit(1))), "track_id_missing_rate": safe_div(F.col("_untracked"), c),
        "bbox_out_of_bounds_rate": safe_div(F.col("_boxes"), c), "invalid_time_window_rate": safe_div(F.col("_times"), c), "detections_per_video": safe_div(c, F.greatest(F.lit(videos), F.lit(1))),
        "tracks_per_video": safe_div(F.col("unique_track_count"), F.greatest(F.lit(videos), F.lit(1))), "track_fragmentation_rate": safe_div(F.col("short_track_count"), F.col("_tracks")),
        "artifact_upload_missing_rate": F.lit(0.0 if summary_found else 1.0), "draft_without_decision_trace_rate": F.when((n > 0) & (F.col("draft_metadata_count") == 0) & ~F.lit(trace_found), 1.0).otherwise(0.0),
        "no_drafts_with_candidates_rate": F.lit(0.0), "exit_code": F.lit(exit_code).cast("int"),
    }
    return one.withColumns(rates).withColumn("video_count", F.lit(videos)).drop("_windows", "_errors", "_untracked", "_boxes", "_times", "_tracks")


def policy_rollup(windows: DataFrame, run: str, expected: DataFrame) -> DataFrame:
    """Of each run: evaluated, violating, explicit and unevaluated windows, the rates of both, windows with others allowed, and status.

    windows: run, decision (null: no policy), others_allowed; expected: run, and the columns traced, drafts, reported, whose largest is the expected number of windows.
    """
    explicit = F.col("decision").isNotNull()
    own = windows.groupBy(run).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(explicit).alias("explicit"), F.count_if(F.col("decision") == "review_required").alias("violations"), F.count_if(F.coalesce("others_allowed", F.lit(False))).alias("others_allowed"),
    )
    both = expected.join(own, run, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("evaluated", "explicit", "violations", "others_allowed")})
    most = F.greatest(F.coalesce("traced", F.lit(0)), F.coalesce("drafts", F.lit(0)), F.coalesce("reported", F.lit(0)))
    out = both.withColumn("expected", most).withColumn("unevaluated", F.greatest(most - F.col("evaluated"), F.lit(0)))
    bottom = F.greatest("expected", "evaluated")
    out = out.withColumn("evidence_rate", F.when(bottom > 0, F.round(F.col("explicit") / bottom, 3)).otherwise(1.0)).withColumn("violation_rate", F.round(safe_div(F.col("violations"), F.col("evaluated")), 3))
    gaps = (F.col("explicit") < F.col("evaluated")) | (F.col("unevaluated") > 0)
    return out.withColumn("status", F.when(F.col("violations") > 0, "hard_block").when(gaps, "inconclusive").otherwise("pass")).drop("traced", "drafts", "reported")


def qa_log(lines: DataFrame, run: str, drafts: DataFrame, line: str = "line", defect: str = r"\b([A-Z]+(?:_[A-Z]+)+)\b", critical: list[str] | None = None) -> DataFrame:
    """Of each run's log: defects and critical ones named, uploads flagged and not, the gate's bypass, and how far uploads differ from the traced drafts.

    An upload line says "uploaded N drafts"; the last one (by `place`) counts. drafts: run, draft_count.
    """
    named = F.regexp_extract_all(line, F.lit(defect), F.lit(1))
    worst = F.filter(named, lambda x: x.isin(critical or [])) if critical else F.array().cast("array<string>")
    count = F.regexp_extract(line, r"uploaded (\d+) drafts", 1).try_cast("int")
    own = lines.groupBy(run).agg(
        F.sum(F.size(named)).alias("defects"), F.sum(F.size(worst)).alias("critical"), F.count_if(F.contains(F.col(line), F.lit("QA-FLAGGED"))).alias("by_name"), F.count_if(F.contains(F.col(line), F.lit("uploading FLAGGED"))).alias("by_flow"),
        F.count_if(F.contains(F.col(line), F.lit("QA still failing"))).alias("still_failing"), F.coalesce(F.max_by(count, F.when(count.isNotNull(), F.col("place"))), F.lit(0)).alias("uploaded"),
    )
    out = own.join(drafts, run, "left").withColumn("draft_count", F.coalesce("draft_count", F.lit(0))).withColumn("flagged", F.greatest("by_name", "by_flow"))
    out = out.withColumn("unflagged", F.greatest(F.col("uploaded") - F.col("flagged"), F.lit(0))).withColumn("bypass", (F.col("critical") > 0) & (F.col("unflagged") > 0))
    differs = (F.col("uploaded") > 0) & (F.col("draft_count") > 0) & (F.col("uploaded") != F.col("draft_count"))
    return out.withColumn("mismatch", F.when(differs, F.abs(F.col("uploaded") - F.col("draft_count"))).otherwise(0)).drop("by_name", "by_flow")


def qa_trace(drafts: DataFrame, windows: DataFrame, run: str, explicit: list[str]) -> DataFrame:
    """Of each run: drafts, blocked and not, with a decision named in `explicit`, blocking defects, retries, windows marked for review whose draft is blocked
    or open, and whether every draft is decided.

    drafts: run, draft, decision, blocked, critical, retries, multi_person (a draft-level defect); windows: draft, review_required. A draft without a marked window but with the
    draft-level defect counts as one marked window.
    """
    marked = windows.groupBy("draft").agg(F.count_if("review_required").alias("marked"))
    d = drafts.join(marked, "draft", "left").withColumn("marked", F.coalesce("marked", F.lit(0)))
    d = d.withColumn("marked", F.when((F.col("marked") == 0) & F.col("multi_person"), 1).otherwise(F.col("marked")))
    told = F.coalesce(F.col("decision").isin(explicit), F.lit(False))
    return d.groupBy(run).agg(
        F.count(F.lit(1)).alias("drafts"), F.count_if("blocked").alias("blocked"), F.count_if(told).alias("explicit"), F.sum("critical").alias("blocking_defects"), F.sum(F.coalesce("retries", F.lit(0))).alias("retries"),
        F.sum("marked").alias("marked"), F.sum(F.when(F.col("blocked"), F.col("marked")).otherwise(0)).alias("marked_blocked"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("marked"))).alias("marked_open"),
        F.bool_and(told | (F.col("blocked") & (F.col("critical") > 0))).alias("policy_explicit"),
    )


def person_summary(rows: DataFrame, person: Column) -> DataFrame:
    """Of each person (unknown where null): candidates, selected, discarded, best score, and the counts of discard causes and stages as maps.

    rows: selected, discarded, discard_stage, discard_cause, score. Groups are counted by stage and cause first, so a person of many rows is some counts.
    """
    named = rows.withColumn("person", F.coalesce(person, F.lit("unknown"))).withColumns({c: F.coalesce(c, F.lit("selected")) for c in ("discard_stage", "discard_cause")})
    base = named.groupBy("person").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("selected").alias("selected"), F.count_if("discarded").alias("discarded"), F.max(F.coalesce("score", F.lit(0))).alias("score_max"))
    stages, causes = counts_by(named, ["person"], "discard_stage"), counts_by(named, ["person"], "discard_cause")
    return base.join(stages.withColumnRenamed("counts", "stages"), "person").join(causes.withColumnRenamed("counts", "causes"), "person")


def ledger_summary(entries: DataFrame, draft: str) -> DataFrame:
    """Of each draft: entries, and the counts of decisions and of value labels as maps. entries: draft, decision, labels."""
    named = entries.withColumn("decision", F.coalesce("decision", F.lit("unknown")))
    base = named.groupBy(draft).agg(F.count(F.lit(1)).alias("entries"))
    decisions = counts_by(named, [draft], "decision").withColumnRenamed("counts", "decisions")
    labels = counts_by(named.select(draft, F.explode("labels").alias("label")), [draft], "label").withColumnRenamed("counts", "labels")
    return base.join(decisions, draft).join(labels, draft, "left")


def session_violations(persons: DataFrame, events: DataFrame, session: str) -> DataFrame:
    """session, rule: persons without an id or with another's, events without a finite window from 0 on, with a score outside 1 to 10, or without a type.

    persons: session, person; events: session, start, end, score, event_type (numbers null where they couldn't be read).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    missing = persons.where(blank(F.col("person"))).select(session, F.lit("person_without_id").alias("rule"))
    twice = persons.where(~blank(F.col("person"))).groupBy(session, F.trim("person").alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(session, F.lit("duplicate_person_id").alias("rule"))
    good = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") < float("inf")), F.lit(False))
    rules = {"invalid_time_window": good, "score_outside_1_to_10": F.coalesce(F.col("score").between(1, 10), F.lit(False)), "missing_type": ~blank(F.col("event_type"))}
    broken = constraint_violations(events, session, rules)
    return missing.unionByName(twice).unionByName(broken).groupBy(session, "rule").agg(F.count(F.lit(1)).alias("n"))
