"""Closed intervals [start, end] in seconds, and how time stamps are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap as a share of the shorter interval; 0 where one is empty."""
    return safe_div(overlap_seconds(s1, e1, s2, e2), F.least(e1 - s1, e2 - s2))


def gap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Time between two intervals, 0 where they overlap, null where a bound is unknown."""
    return F.when(s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull(), F.greatest(F.lit(0), s2 - e1, s1 - e2))


def safe_div(n: Column, d: Column) -> Column:
    """n / d as a double, 0 where d isn't positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(as_column(high), x))


def finite(x: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def optional_number(text: Column) -> Column:
    """A number from text; null, never 0, where there is none."""
    return finite(F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double"))


def duration(start: Column, end: Column, given: Column | None = None) -> Column:
    own = F.greatest(F.lit(0), end - start)
    return own if given is None else F.coalesce(given, own)


def valid_window(start: Column, end: Column, source: Column) -> Column:
    return F.coalesce((end > start) & (F.trim(source) != ""), F.lit(False))


def minute_second(x: Column) -> Column:
    """12.34 read as 12 minutes 34 seconds; null where negative or of 60 seconds or more."""
    minutes = F.floor(x + 1e-9)
    seconds = F.rint((x - minutes) * 100)
    return F.when((x >= 0) & (seconds < 60), minutes * 60 + seconds).cast("double")


def recovered(start: Column, end: Column, least: float = 5.0) -> Column:
    """struct(start, end, encoding): read as minutes and seconds only where decimal seconds are shorter than `least` and that reading isn't."""
    s, e = minute_second(start), minute_second(end)
    use = (end - start < least) & (e - s >= least)
    pick = lambda a, b: F.when(F.coalesce(use, F.lit(False)), a).otherwise(b)
    return F.struct(pick(s, start).alias("start"), pick(e, end).alias("end"), pick(F.lit("minute_second"), F.lit("decimal_seconds")).alias("encoding"))


def namespaced(index: Column, chunks: Column, local: Column) -> Column:
    """chunk_07:id where a source has several chunks, else the id."""
    return F.when(chunks > 1, F.format_string("chunk_%02d:%s", index, local)).otherwise(local)


def _readings(start: Column, end: Column, offset: Column, length: Column, least: float, tolerance: float) -> Column:
    """All readings of a window: encoding, basis, local bounds, usable overlap."""
    source_end = offset + length
    usable = lambda s, e: F.greatest(F.lit(0.0), F.least(e, length) - F.greatest(s, F.lit(0.0)))
    out = []
    for rank, (encoding, s, e) in enumerate((("decimal_seconds", start, end), ("minute_second", minute_second(start), minute_second(end)))):
        local = (s >= -tolerance) & (s < length + tolerance)
        whole = (offset > 0) & (s >= offset - tolerance) & (s < source_end + tolerance)
        for basis, prefer, good, b, f in (("chunk_local", 1, local, s, e), ("source_global", 0, whole, s - offset, e - offset)):
            value = F.struct(
                F.when(usable(b, f) >= least, 1).otherwise(0).alias("valid"), F.lit(1 - rank).alias("decimal"), usable(b, f).alias("overlap"), F.lit(prefer).alias("prefer"),
                F.lit(encoding).alias("encoding"), F.lit(basis).alias("basis"), b.cast("double").alias("local_start"), f.cast("double").alias("local_end"),
            )
            out.append(F.when((e > s) & good, value))
    return F.array_compact(F.array(*out))


def chunk_window(start: Column, end: Column, offset: Column, length: Column, least: float = 4.0, tolerance: float = 1.0) -> Column:
    """struct(valid, reason, encoding, basis, clamped, start, end) of a window reported for a chunk [offset, offset + length].

    Each encoding takes the basis with the larger usable overlap (local on ties); among encodings with `least` usable seconds decimal
    seconds win; with none, the larger overlap. The window is clamped to the chunk and moved to the source's time.
    """
    bad = ~F.coalesce((end > start) & (length > 0), F.lit(False))

    def best_of(readings: Column, decimal: int) -> Column:
        ranked = F.transform(F.filter(readings, lambda r: r["decimal"] == decimal), lambda r: F.struct(r["overlap"].alias("overlap"), r["prefer"].alias("prefer"), r.alias("r")))
        return F.array_max(ranked)["r"]

    def better(two: Column) -> Column:
        decimal, minutes = two["d"], two["m"]
        usable = lambda r: F.coalesce(r["valid"] == 1, F.lit(False))
        worse = F.coalesce(minutes["overlap"] > decimal["overlap"], decimal.isNull())
        return F.when(usable(decimal), decimal).when(usable(minutes), minutes).when(worse, minutes).otherwise(decimal)

    def judged(c: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), c["local_start"]), F.least(length.cast("double"), c["local_end"])
        moved = (F.abs(low - c["local_start"]) > 0.001) | (F.abs(high - c["local_end"]) > 0.001)
        reason = F.when(bad, "invalid_numeric_window").when(c.isNull(), "timestamp_outside_chunk_bounds").when((low >= length) | (high - low < least), "insufficient_time_inside_chunk")
        return F.struct(
            reason.isNull().alias("valid"), reason.alias("reason"), F.when(~bad, c["encoding"]).alias("encoding"), F.when(~bad, c["basis"]).alias("basis"),
            F.when(reason.isNull(), moved).alias("clamped"), F.when(reason.isNull(), offset + low).alias("start"), F.when(reason.isNull(), F.least(offset + length, offset + high)).alias("end"),
        )

    chosen = let(_readings(start, end, offset, length, least, tolerance), lambda x: let(F.struct(best_of(x, 1).alias("d"), best_of(x, 0).alias("m")), better))
    return let(chosen, judged)


def tail_guard(end: Column, outcome: Column, source_end: Column, pad: float = 3.0) -> Column:
    """The end moved `pad` seconds on, inside the source, where no outcome was seen."""
    return F.when(outcome.isNull(), F.least(source_end, end + pad)).otherwise(end)


def complete_action(start: Column, end: Column, setup: Column, outcome: Column) -> Column:
    """A window that holds its set-up and outcome where they are known."""
    return F.struct(F.least(start, F.coalesce(setup, start)).alias("start"), F.greatest(end, F.coalesce(outcome, end)).alias("end"))


def capped(start: Column, end: Column, cap: Column | float, keep_tail: Column | bool = True) -> Column:
    """A window of at most `cap` seconds, of its tail or its head."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    tail = keep_tail if isinstance(keep_tail, Column) else F.lit(keep_tail)
    long = end - start > cap
    return F.struct(F.when(long & tail, end - cap).otherwise(start).alias("start"), F.when(long & ~tail, start + cap).otherwise(end).alias("end"))


def effective_cut(start: Column, end: Column, climax: Column, peak: Column, climax_cap: float = 15.0, cap: float = 11.0) -> Column:
    """The window that a cut will show: of a climax up to `climax_cap` seconds, else the last `cap` seconds."""
    limit = F.when(climax, F.lit(climax_cap)).otherwise(F.lit(cap))
    return capped(start, end, limit, True)


def resolved_window(start: Column, end: Column, source_end: Column, setup: Column, peak: Column, outcome: Column, least: float = 4.0, cap: float = 11.0, tail: float = 1.5) -> Column:
    """struct(start, end, reason) of a cut, null where none is left.

    In turn: clamp to the source with at least `least` seconds; reach back to the set-up; hold the peak with 2 seconds before and 3 after;
    reach the outcome, or trim a tail of more than `tail` seconds after it; cap at `cap` seconds around the peak where phases are
    known (no cut if they don't fit), else keep the end.
    """
    zero = F.lit(0.0)

    def clamped(_: Column) -> Column:
        s = F.greatest(zero, F.least(start, F.greatest(zero, source_end - least)))
        return F.struct(s.alias("s"), F.least(F.greatest(end, s + least), source_end).alias("e"))

    def reached_back(w: Column) -> Column:
        early = F.coalesce(setup < w["s"], F.lit(False))
        s = F.when(early, F.greatest(zero, setup)).otherwise(w["s"])
        return F.struct(s.alias("s"), w["e"].alias("e"), early.alias("early"), (w["e"] - w["s"] < least).alias("none"))

    def with_peak(w: Column) -> Column:
        off = F.coalesce(~((peak >= w["s"]) & (peak <= w["e"])), F.lit(False))
        s = F.when(off, F.greatest(zero, F.least(w["s"], peak - 2.0))).otherwise(w["s"])
        e = F.when(off, F.least(source_end, F.greatest(w["e"], peak + 3.0))).otherwise(w["e"])
        return F.struct(s.alias("s"), e.alias("e"), w["early"].alias("early"), w["none"].alias("none"), off.alias("off"))

    def with_outcome(w: Column) -> Column:
        late = F.coalesce(outcome > w["e"], F.lit(False))
        trimmed = F.greatest(outcome + tail, w["s"] + least, F.coalesce(peak + tail, w["s"] + least))
        trim = F.coalesce(~late & (w["e"] - outcome > tail) & (trimmed < w["e"]), F.lit(False))
        e = F.when(late, F.least(source_end, outcome)).when(trim, trimmed).otherwise(w["e"])
        return F.struct(w["s"].alias("s"), e.alias("e"), w["early"].alias("early"), w["none"].alias("none"), w["off"].alias("off"), late.alias("late"), trim.alias("trim"))

    phases = setup.isNotNull() | peak.isNotNull() | outcome.isNotNull()

    def under_cap(w: Column) -> Column:
        over = w["e"] - w["s"] > cap
        need_s = F.coalesce(setup, w["s"])
        need_p = F.coalesce(peak, setup, w["s"])
        need_e = F.when(outcome.isNotNull(), F.greatest(outcome, need_p)).otherwise(F.greatest(need_p, w["e"]))
        mid = F.greatest(zero, need_p - cap * 0.45)
        begin = F.when(need_s < mid, F.greatest(zero, need_s)).otherwise(mid)
        past = F.least(source_end, begin + cap)
        shifted = need_e > past
        last = F.when(shifted, F.least(source_end, need_e)).otherwise(past)
        s = F.when(over & phases, F.when(shifted, F.greatest(zero, last - cap)).otherwise(begin)).when(over, F.greatest(zero, w["e"] - cap)).otherwise(w["s"])
        none = w["none"] | (over & phases & (need_e - need_s > cap))
        said = F.array_compact(
            F.array(
                F.when(w["early"], "setup"), F.when(w["off"], "peak"), F.when(w["late"], "outcome"), F.when(w["trim"], "outcome_trim"),
                F.when(over & phases, "cap_preserved_action"), F.when(over & ~phases, "cap_no_phase"),
            )
        )
        return F.struct(s.alias("s"), F.when(over & phases, last).otherwise(w["e"]).alias("e"), none.alias("none"), said.alias("said"))

    def told(w: Column) -> Column:
        fits = ~(w["none"] | (w["e"] - w["s"] < least) | (start >= source_end - 2.0))
        return F.when(fits, F.struct(w["s"].alias("start"), w["e"].alias("end"), F.when(F.size(w["said"]) == 0, "valid").otherwise(F.array_join(w["said"], "+")).alias("reason")))

    out = let(F.lit(0), clamped)
    for step in (reached_back, with_peak, with_outcome, under_cap, told):
        out = let(out, step)
    return out
