"""Qualities, weights and gates of moments. Nulls take the documented default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.intervals import clamp


def dedup_quality(score: Column, visible: Column, confidence: Column, seconds: Column, has_box: Column, has_track: Column) -> Column:
    return score * 10 + visible * 4 + confidence * 4 + F.least(seconds, F.lit(12.0)) * 0.1 + F.when(has_box, 0.25).otherwise(0.0) + F.when(has_track, 0.15).otherwise(0.0)


def guard_quality(score: Column, visible: Column, confidence: Column) -> Column:
    one = lambda c: clamp(F.coalesce(c, F.lit(1.0)), 0.0, 1.0)
    return F.coalesce(score, F.lit(0.0)) * 0.75 + one(visible) * 1.5 + one(confidence)


def impact(score: Column, weight: Column, seconds: Column, low_interest: Column) -> Column:
    return score * 10 + weight * 3 - F.greatest(F.lit(0.0), seconds - 8) * 0.7 - F.when(low_interest, 8.0).otherwise(0.0)


def decay(days: Column, half_life: float = 30.0) -> Column:
    """1 for today, a half for each half-life; 1 where the time is unknown."""
    return F.coalesce(F.exp(-F.greatest(F.lit(0.0), days) * F.log(F.lit(2.0)) / half_life), F.lit(1.0))


def wave_completion(takeoff: Column, peak: Column, outcome: Column, end: Column) -> Column:
    """Parts of a complete action: take-off 0.2, peak 0.3, outcome 0.4, and 0.1 if the cut holds the outcome."""
    part = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    holds = F.coalesce(outcome <= end, F.lit(False))
    return part(takeoff.isNotNull(), 0.2) + part(peak.isNotNull(), 0.3) + part(outcome.isNotNull(), 0.4) + part(holds, 0.1)


def normalised_score(score: Column, peak: Column) -> Column:
    """The score as ten parts of the session's best, whole."""
    return F.rint(F.least(F.lit(10.0), score * 10.0 / F.greatest(peak, F.lit(1)))).cast("int")


def subject_class(visible: Column, continuity: Column, confidence: Column, least: float = 0.5, sure: float = 0.55) -> Column:
    return F.when(visible == 0, "no_subject").when(visible == 1, "single").when((continuity >= least) & (confidence >= sure), "clear_primary").otherwise("ambiguous")


def blocking(kind: Column, severity: Column, always: list[str], critical: list[str]) -> Column:
    """Defects that block whatever their severity, and those that block where they are critical."""
    return kind.isin(always) | (kind.isin(critical) & (F.lower(severity) == "critical"))


def verdict(technical: Column, engagement: Column, critical: Column, least: int = 60) -> Column:
    return F.when(technical & (engagement >= least) & (critical == 0), "PASS").otherwise("FAIL")


def output_issues(width: Column, height: Column, seconds: Column, audio: Column, longest: float = 90.0, least_height: int = 1280, slack: float = 0.02) -> Column:
    aspect = width.cast("double") / height
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(seconds > 0, F.lit(False)), "missing_duration"), F.when(seconds > longest, "too_long"), F.when(height < least_height, "low_resolution"),
            F.when(F.abs(aspect - 9.0 / 16) > slack, "wrong_aspect"), F.when(audio.isNull(), "audio_unknown"), F.when(audio, "audio_present"),
        )
    )


def review_reasons(**flags: Column) -> Column:
    """The names of the flags that hold, in order."""
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in flags.items())))


# Terms of failed take-offs, and of the input modes' size limit.
FAILED_TAKEOFF = ["failed takeoff", "failed take-off", "missed takeoff", "missed the wave", "did not catch", "no ride"]
LARGE_FILE = 100_000_000


def failed_takeoff(description: Column, reason: Column) -> Column:
    from tidemark.functions.text import has_any

    return has_any(description, FAILED_TAKEOFF) | has_any(reason, FAILED_TAKEOFF)


def admitted(score: Column, surf: Column, failed: Column, least: int = 6) -> Column:
    """Scored enough, or any surf moment that isn't a failed take-off."""
    return F.coalesce(score >= least, F.lit(False)) | (surf & ~failed)


def event_fingerprint(strong: list[Column], trajectory: list[Column], sync_seconds: Column, box_bucket: Column, confidence: Column, visible: Column, bucket: float = 1.5, least: float = 0.5) -> Column:
    """The first strong field there is, else the first trajectory field, else (with enough evidence) a hash of the synchronous time's bucket and the box's place, else null."""
    known = lambda c: F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string")))
    text = lambda kind, cols: [F.concat(F.lit(f"{kind}{k}:"), known(c)) for k, c in enumerate(cols)]
    place = F.concat_ws(":", F.rint(sync_seconds / bucket).cast("long").cast("string"), box_bucket.cast("string"))
    medium = F.when((confidence >= least) & (visible >= least) & sync_seconds.isNotNull() & box_bucket.isNotNull(), F.concat(F.lit("medium:"), F.substring(F.sha1(place.cast("binary")), 1, 16)))
    return F.coalesce(*text("strong", strong), *text("trajectory", trajectory), medium)


def input_mode(n: Column, largest: Column) -> Column:
    """none, single, long (a file over LARGE_FILE) or multi."""
    return F.when(n == 0, "none").when(largest > LARGE_FILE, "long").when(n == 1, "single").otherwise("multi")


def render_tier(width: Column, height: Column) -> Column:
    short = F.least(width, height)
    return F.when(~F.coalesce(short > 0, F.lit(False)), "unknown").when(short >= 2160, "4k").when(short >= 1440, "1440p").when(short >= 1080, "1080p").when(short >= 720, "720p").otherwise("low")


def framing(samples: Column, confidence: Column, visible: Column, height_share: Column, area_share: Column, edge: Column, fits: Column) -> Column:
    """struct(mode, reason): a tracked crop needs enough of a sure, visible, large track that stays inside the crop; else the whole frame."""
    reason = (
        F.when(samples < 2, "too_few_samples").when(confidence < 0.60, "low_confidence").when(visible < 0.55, "low_visible_ratio")
        .when((height_share < 0.065) | (area_share < 0.0025), "subject_too_small").when(edge < 0.08, "subject_at_edge").when(~fits, "track_motion_requires_contain")
    )
    return F.struct(F.when(reason.isNull(), "tracked_crop").otherwise("contain").alias("mode"), F.coalesce(reason, F.lit("stable_track_trajectory")).alias("reason"))


def transitions(place: Column, last: Column, wanted: Column, has_zoom: Column | None = None) -> Column:
    """"zoom" only on the event before the last (places from 1), and always there if any event of a reel of three or more asks for it (`has_zoom`)."""
    rule = F.when((wanted == "zoom") & (place != last - 1), "slide").otherwise(wanted)
    return rule if has_zoom is None else F.when(has_zoom & (last >= 3) & (place == last - 1), "zoom").otherwise(rule)


def required_evidence(has_box: Column, visible: Column, track: Column, tracks: Column, least: float = 0.35) -> Column:
    """A usable box, and a track that is the only one or named among several."""
    bound = (F.size(tracks) <= 1) | F.coalesce(F.array_contains(tracks, track), F.lit(False))
    return has_box & F.coalesce(visible >= least, F.lit(False)) & track.isNotNull() & bound
