"""What a cut may do to a moment: zoom and slow motion as asked for, within what its source can give and its kind allows. Nulls take the documented default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least zoom of kinds of moments, the most of others, and the kinds that are never slowed.
ZOOM_FLOOR = {
    "aerial": 1.3, "gap_jump": 1.3, "trick": 1.2, "flip": 1.3, "kicker": 1.2, "jump": 1.2, "landing": 1.2, "grind": 1.2, "manual": 1.2,
    "goal": 1.2, "save": 1.2, "tackle": 1.1, "shot": 1.1, "header": 1.1, "near_miss": 1.2, "tube_ride": 1.2, "barrel": 1.2,
}
ZOOM_CEILING = {"wipeout": 1.05, "crash": 1.05, "paddle": 1.1, "approach": 1.1, "walk": 1.05}
NEVER_SLOW = ["wipeout", "crash"]
# Headroom from which a zoom is used, the share of it that may be, and the least height and frame rates of sources.
LEAST_HEADROOM, HEADROOM_SHARE, LEAST_HEIGHT, LEAST_RATE = 1.15, 0.9, 1440, 24.0
SLOW_SECONDS, MOST_SLOW_SHARE, PLAIN_SHARE = 2.5, 0.30, 0.40


def _of(values: dict[str, float], kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.try_element_at(table, F.lower(F.coalesce(kind, F.lit(""))))


def applied_zoom(requested: Column, headroom: Column, height: Column, kind: Column, least_height: int = LEAST_HEIGHT) -> Column:
    """The zoom that is used, 1 at least: what was asked for (null: 1), raised to the kind's floor, both up to nine tenths of the headroom (null: 1), and
    then the kind's ceiling. A source without headroom or of less than `least_height` (null: 1080) isn't zoomed."""
    head = F.coalesce(headroom.cast("double"), F.lit(1.0))
    able = (head >= LEAST_HEADROOM) & (F.coalesce(height, F.lit(1080)) >= least_height)
    most = head * HEADROOM_SHARE
    wanted = F.greatest(F.coalesce(requested.cast("double"), F.lit(1.0)), F.coalesce(_of(ZOOM_FLOOR, kind), F.lit(1.0)))
    zoom = F.when(able, F.greatest(F.lit(1.0), F.least(wanted, most))).otherwise(F.lit(1.0))
    return F.least(zoom, F.coalesce(_of(ZOOM_CEILING, kind), zoom))


def slow_motion(requested: Column, native: Column, rate: Column, height: Column, kind: Column, seconds: Column, interpolate: bool = False, least_height: int = LEAST_HEIGHT) -> Column:
    """struct(slow, interpolated, factor, share): whether a moment that asks for it is slowed, how much, and which share of its seconds.

    It needs a source with frames enough (`native`, null: it has them), or, where `interpolate` allows, one of 24 frames (null: 30) and `least_height` whose
    frames are made up; some kinds never are. No kind is slowed that doesn't ask."""
    has = F.coalesce(native, F.lit(True))
    made = F.lit(interpolate) & ~has & (F.coalesce(rate.cast("double"), F.lit(30.0)) >= LEAST_RATE) & (F.coalesce(height, F.lit(1080)) >= least_height)
    slow = F.coalesce(requested, F.lit(False)) & (has | made) & ~F.lower(F.coalesce(kind, F.lit(""))).isin(NEVER_SLOW)
    share = F.round(F.least(F.lit(MOST_SLOW_SHARE), F.lit(SLOW_SECONDS) / F.greatest(F.coalesce(seconds.cast("double"), F.lit(0.0)), F.lit(0.1))), 3)
    return F.struct(
        slow.alias("slow"), (slow & ~has).alias("interpolated"), F.when(slow & ~has, 1.5).when(slow, 2.0).otherwise(1.0).alias("factor"),
        F.when(slow, share).otherwise(F.lit(PLAIN_SHARE)).alias("share"),
    )
