"""Policies on moments: quality and value of a moment, who is in it, what is rescued, and the path of a decision. Nulls take the documented default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import clamp
from tidemark.functions.text import has_any

# Labels that add to or take from a moment's editorial value.
CATEGORIES = {"FULL_RIDE": "long_ride", "BIG_TURN": "turn_cutback", "FALL": "fall_recovery", "SOCIAL_MOMENT": "social_moment", "HIGH_FIVE": "high_five", "GOOD_STYLE": "good_style"}
NEGATIVE = ["BAD_CROP", "WRONG_ATHLETE", "DUPLICATE_ATHLETE", "DUPLICATE_MOMENT", "CUT_TOO_EARLY", "BORING"]
# Identity confidences that don't suffice, states of an actor's tracking that block, and phrases that tell of them.
UNSURE = ["low", "none", "unknown"]
BAD_STATES = ["ambiguous", "unclear", "unknown", "lost", "switched", "identity_switch", "target_lost", "occluded", "blocked"]
SOCIAL = ["high_five", "celebration", "team_interaction"]  # and the types of moments that are meant to show several people
STABLE_STATES = ["clear", "continuous", "followed", "stable", "tracked"]
PHRASES = [  # in the order in which they are told
    ("identity switches", "identity_switch_description"), ("switches to another player", "identity_switch_description"), ("switches to another athlete", "identity_switch_description"),
    ("loses track of the target", "target_lost_description"), ("primary athlete is unclear", "primary_actor_unclear_description"),
    ("target is obscured at the key moment", "primary_actor_occluded_description"), ("cannot tell which player", "primary_actor_unclear_description"),
]
LEAST_CONFIDENCE, LEAST_CONTINUITY, LEAST_VISIBLE = 0.55, 0.50, 0.35


def identity_known(confidence: Column, mismatch: Column) -> Column:
    """No mismatch, and a confidence (medium where null) that suffices."""
    return ~F.coalesce(mismatch, F.lit(False)) & ~F.lower(F.coalesce(confidence, F.lit("medium"))).isin(UNSURE)


def quality_evidence(visible: Column, confidence: Column, window_status: Column, known: Column, least_visible: float = LEAST_VISIBLE) -> Column:
    seen = (F.coalesce(visible, F.lit(1.0)) >= least_visible) & (F.coalesce(confidence, F.lit(1.0)) >= 0.25)
    return seen & ~F.lower(F.coalesce(window_status, F.lit("valid"))).isin("rejected", "manual_review") & known


def narrative_quality(score: Column, visible: Column, confidence: Column, tracked: Column, action: Column, window_status: Column, known: Column) -> Column:
    """Score, visibility and confidence, with bonuses for a track, a known action time, a good window and a known identity, and 3 less without evidence."""
    one = lambda c: clamp(F.coalesce(c, F.lit(1.0)), 0.0, 1.0)
    part = lambda c, yes, no: F.when(c, F.lit(yes)).otherwise(F.lit(no))
    good = F.lower(F.coalesce(window_status, F.lit("valid"))).isin("valid", "adjusted")
    extra = part(tracked, 0.6, 0.0) + part(action, 0.6, 0.0) + part(good, 0.4, -2.0) + part(known, 0.4, -3.0) + part(quality_evidence(visible, confidence, window_status, known), 0.0, -3.0)
    return F.coalesce(score, F.lit(0.0)) * 0.6 + one(visible) * 1.6 + one(confidence) + extra


def editorial_value(base: Column, labels: Column, bonus: float = 1.0, penalty: float = 1.5) -> Column:
    """struct(value, categories): the base, a bonus for each category among the labels, a penalty for each negative label."""
    named = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    distinct = F.array_distinct(labels)
    hits = F.array_sort(F.transform(F.filter(distinct, lambda x: x.isin(list(CATEGORIES))), lambda x: F.try_element_at(named, x)))
    bad = F.size(F.filter(distinct, lambda x: x.isin(NEGATIVE)))
    return F.struct(F.round(base + bonus * F.size(hits) - penalty * bad, 3).alias("value"), hits.alias("categories"))


def decision_path(selected: Column, prefilter: Column, stage: Column, cause: Column) -> Column:
    """The steps that a candidate went through, as an array."""
    why = F.coalesce(cause, F.lit("None"))
    steps = lambda *x: F.array(*(v if isinstance(v, Column) else F.lit(v) for v in x))
    return (
        F.when(selected & F.coalesce(prefilter, F.lit(False)), steps("analyzer_selected", "prefilter_passed", "draft_uploaded")).when(selected, steps("analyzer_selected", "draft_uploaded"))
        .when(stage == "selector", steps("selector", why)).when(stage == "long_video_pre_qa_prefilter", steps("analyzer_selected", "prefilter_failed", why))
        .when(stage == "single_athlete_selection_policy", steps("analyzer_selected", "selection_policy_rejected", why))
        .when(stage == "render_or_upload_not_emitted_after_prefilter", steps("analyzer_selected", "prefilter_passed", "render_or_upload_not_emitted", why))
        .when(stage == "post_selector_not_emitted", steps("analyzer_selected", "prefilter_unknown", "not_emitted", why)).otherwise(steps("analyzer_selected", "stage_unknown", why))
    )


def ambiguity_reasons(flags: dict[str, Column], states: dict[str, Column], clear: Column, confidence: Column, active: dict[str, Column], actor: Column, pending: Column, description: Column, focused: Column) -> Column:
    """Why it isn't sure who a moment is about, in order and once each. Booleans have three states: null says nothing.

    flags and active: named booleans; states: named states of tracking, in any case, with blanks or dashes. Others who are active count only where the target isn't
    surely centred: an actor, said to be clear, in a stable and no bad state, of enough confidence; what is missing of that is told before them. focused: the
    evidence's scope is a focused stretch, so the description of the whole window isn't read.
    """
    no = F.lit(None).cast("string")
    named = {k: F.translate(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")), "- ", "__") for k, c in states.items()}
    sure = F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double"))))
    low = F.when(sure < LEAST_CONFIDENCE, F.concat(F.lit("primary_actor_confidence:"), F.format_string("%.3f", sure)))
    any_ = lambda cs: F.coalesce(F.greatest(F.lit(False), *(F.coalesce(c, F.lit(False)) for c in cs), F.lit(False)), F.lit(False))
    known = F.coalesce(F.trim(actor.cast("string")) != "", F.lit(False))
    stable, bad = any_([c.isin(STABLE_STATES) for c in named.values()]), any_([c.isin(BAD_STATES) for c in named.values()])
    centred = ~bad & known & F.coalesce(clear, F.lit(False)) & stable & F.coalesce(sure >= LEAST_CONFIDENCE, F.lit(False))
    open_ = any_(list(active.values())) & ~centred
    told = [F.when(c, F.lit(k)).otherwise(no) for k, c in flags.items()]
    told += [F.when(c.isin(BAD_STATES), F.concat(F.lit(f"{k}:"), c)).otherwise(no) for k, c in named.items()]
    told += [F.when(~clear, "primary_actor_clear:false"), low]
    told += [F.when(open_ & ~known, "primary_actor_id:missing"), F.when(open_ & ~F.coalesce(clear, F.lit(False)), "primary_actor_clear:not_proven")]
    told += [F.when(open_ & ~stable, "identity_continuity:not_proven_stable"), F.when(open_ & sure.isNull(), "primary_actor_confidence:missing")]
    told += [F.when(c & open_, F.lit(k)).otherwise(no) for k, c in active.items()]
    told.append(F.when(pending, "focused_subwindow_validation_required"))
    told += [F.when(~F.coalesce(focused, F.lit(False)) & has_any(description, [phrase]), F.lit(code)).otherwise(no) for phrase, code in PHRASES]
    return F.array_distinct(F.array_compact(F.array(*told)))


def primary_actor(reasons: Column, actor: Column, clear: Column, continuity: Column, visible_count: Column, pending: Column) -> Column:
    """struct(decision, reason, defect, centred, others_allowed, reasons): whether the featured athlete can be followed through a moment."""
    waits = F.coalesce(pending, F.lit(False)) & actor.isNotNull() & F.coalesce(continuity >= LEAST_CONTINUITY, F.lit(False))
    open_ = F.when(waits, F.array_remove(reasons, "focused_subwindow_validation_required")).otherwise(reasons)
    low = F.when(continuity < LEAST_CONTINUITY, F.array(F.concat(F.lit("primary_continuity_ratio:"), F.format_string("%.3f", continuity.cast("double"))))).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(open_, low)
    blocked = F.size(all_) > 0
    sure = actor.isNotNull() | F.coalesce(clear | waits, F.lit(False)) | F.coalesce(continuity >= LEAST_CONTINUITY, F.lit(False))
    said = F.array_join(all_, " ")
    defect = F.when(blocked, F.when(F.contains(said, F.lit("switch")), "IDENTITY_SWITCH").when(F.contains(said, F.lit("occlu")), "PRIMARY_ACTOR_OCCLUDED").otherwise("PRIMARY_ACTOR_UNCLEAR")).when(~sure & (visible_count > 1), "PRIMARY_ACTOR_UNCLEAR")
    decision = F.when(blocked, "review_required").when(sure, "allowed_primary_actor_clear").when(visible_count <= 1, "allowed_single_visible_subject").otherwise("review_required")
    why = F.when(blocked, "primary_actor_not_reliably_followable").when(sure, "primary_athlete_centered_other_people_allowed").when(visible_count <= 1, "single_visible_subject").otherwise("primary_actor_unknown_among_multiple_visible_subjects")
    shown = F.when(blocked, all_).when(~sure & (visible_count > 1), F.array(F.lit("primary_actor_unknown"))).otherwise(F.array().cast("array<string>"))
    return F.struct(decision.alias("decision"), why.alias("reason"), defect.alias("defect"), (decision != "review_required").alias("centred"), (~blocked & sure & (visible_count > 1)).alias("others_allowed"), shown.alias("reasons"))


def multi_person_gate(actor_decision: Column, visible_ids: Column, social_flag: Column, labels: Column, kind: Column, description: Column) -> Column:
    """struct(decision, social, visible): a meant social moment passes, anything else as the primary actor's decision says. visible_ids: arrays of ids, put together."""
    name = F.translate(F.lower(F.coalesce(kind, F.lit(""))), "- ", "__")
    social = F.coalesce(social_flag, F.lit(False)) | F.arrays_overlap(F.coalesce(labels, F.array().cast("array<string>")), F.array(F.lit("SOCIAL_MOMENT"), F.lit("HIGH_FIVE"))) | name.isin(SOCIAL) | has_any(description, ["high five", "high-five"])
    social = F.coalesce(social, F.lit(False))
    return F.struct(F.when(social, "allowed_social_moment").otherwise(actor_decision).alias("decision"), social.alias("social"), F.size(F.array_distinct(F.array_compact(visible_ids))).alias("visible"))


def focused_or_dropped(moments: DataFrame, reasons: Column, start: str = "focused_start", end: str = "focused_end", least: float = 6.0) -> DataFrame:
    """Moments that no reason speaks against, and those of the others that have a focused stretch of `least` seconds, cut to it; `focused` tells which. The rest go."""
    whole = F.size(reasons) == 0
    fits = F.coalesce(F.col(end) - F.col(start) >= least, F.lit(False))
    told = moments.withColumn("focused", ~whole).where(whole | fits)
    pick = lambda a, b: F.when(F.col("focused"), F.col(a)).otherwise(F.col(b))
    return told.withColumns({"start": pick(start, "start"), "end": pick(end, "end")})


def rescued(events: DataFrame, clean: DataFrame, event_id: str, defect: str, primary: str, identity: list[str]) -> DataFrame:
    """Events with `rescue`: not_needed without a subject defect; clean_subwindow_rescued with their window cut to the clean one, its primary track set and
    what was told of their identity cleared; else no_clean_subwindow_found. clean: event id, start, end (see timeline.clean_subwindows)."""
    found = clean.select(F.col(event_id).alias("_e"), F.col("start").alias("_s"), F.col("end").alias("_t"))
    out = events.join(found, F.col(event_id) == F.col("_e"), "left")
    bad = F.coalesce(F.col(defect), F.lit(False))
    saved = bad & F.col("_e").isNotNull()
    changes = {c: F.when(saved, F.lit(None)).otherwise(F.col(c)) for c in identity}
    changes |= {"start": F.when(saved, F.col("_s")).otherwise(F.col("start")), "end": F.when(saved, F.col("_t")).otherwise(F.col("end")), "track": F.when(saved, F.col(primary)).otherwise(F.col("track"))}
    status = F.when(saved, "clean_subwindow_rescued").when(bad, "no_clean_subwindow_found").otherwise("not_needed")
    return out.withColumn("rescue", status).withColumns(changes).drop("_e", "_s", "_t")


def extended(after: DataFrame, before: DataFrame, most: float = 30.0) -> DataFrame:
    """Re-edited events with `extension`: seconds by which each is longer than the event of its source, type, start and description (the first 120
    letters) before, and whether it is `extended`; a window over `most` seconds keeps its tail."""
    key = lambda df, p: df.select("*", F.substring(F.coalesce("description", F.lit("")), 1, 120).alias(f"_{p}"))
    was = key(before, "was").groupBy("source", "event_type", F.col("start").alias("_start"), "_was").agg(F.max("end").alias("_end"))
    same = [F.col("n.source") == F.col("w.source"), F.col("n.event_type") == F.col("w.event_type"), F.col("n.start") == F.col("_start"), F.col("_now") == F.col("_was")]
    out = key(after, "now").alias("n").join(was.alias("w"), same, "left").select("n.*", "_end").drop("_now")
    more = F.greatest(F.col("end") - F.col("_end"), F.lit(0))
    out = out.withColumn("extension", F.coalesce(more, F.lit(0))).withColumn("extended", F.coalesce(more > 0, F.lit(False))).drop("_end")
    return out.withColumn("start", F.when(F.col("extended") & (F.col("end") - F.col("start") > most), F.col("end") - most).otherwise(F.col("start")))


def cluster_evidence(events: DataFrame, cluster: str, appearance: str, has_box: str, usable: str, visible: str, least: float = LEAST_VISIBLE) -> DataFrame:
    """cluster and `evidence`: every appearance has an event with a box, not known to be unusable, visible enough."""
    good = F.col(has_box) & F.coalesce(F.col(usable), F.lit(True)) & (F.coalesce(F.col(visible), F.lit(0.0)) >= least)
    each = events.groupBy(cluster, appearance).agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("any"))
    return each.groupBy(cluster).agg(F.bool_and("any").alias("evidence"))


def publishable(revision: Column, task_revision: Column, granted: Column, active_task: Column, qa_passed: Column) -> Column:
    """Whether a draft may be published: granted for its present revision, its QA passed, and no task of it pending or running."""
    return F.coalesce(granted & (revision == task_revision) & qa_passed, F.lit(False)) & ~F.coalesce(active_task, F.lit(False))
