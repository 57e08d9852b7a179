"""From a model's raw replies to events on the source's time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.intervals import chunk_window, clamp, finite, namespaced
from tidemark.functions.text import unfenced

REPLY = """activity string, persons array<struct<id: string, description: string, no_output_reason: string, events: array<struct<type: string, start: string, end: string,
score: string, description: string, setup_start: string, peak_time: string, outcome_end: string, crop_x: string, crop_y: string, edit: struct<zoom: string, slowmo: boolean, focus: string, transition_out: string>>>>>"""
TRANSITIONS = ["cut", "slide", "fade", "zoom"]  # fixed values: the transitions that are known


def _number(c: Column) -> Column:
    return finite(c.try_cast("double"))


def events_of(replies: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Events of all replies with defaults and clamps applied, and the replies that are no JSON object with persons.

    Missing end: start + 10; score 5, kept in 1 to 10; crop 0.5 and 0.65, kept in 0 to 1; zoom 1, kept in 1 to 2; unknown transitions slide. Phase times
    stay null where they aren't numbers. An event without a numeric start is dropped. `place` counts a reply's events.
    """
    parsed = replies.withColumn("_r", F.from_json(unfenced(F.col(raw)), REPLY))
    good = F.col("_r.persons").isNotNull()
    people = parsed.where(good).select(*[c for c in replies.columns if c != raw], F.col("_r.activity").alias("activity"), F.posexplode("_r.persons").alias("person_place", "p"))
    rows = people.select(*[c for c in people.columns if c != "p"], F.coalesce("p.id", F.concat(F.lit("person_"), F.col("person_place").cast("string"))).alias("person"), F.col("p.description").alias("person_description"), F.posexplode("p.events").alias("event_place", "e"))
    start = _number(F.col("e.start"))
    transition = F.lower("e.edit.transition_out")
    out = rows.select(
        *[c for c in rows.columns if c != "e"],
        F.coalesce(F.col("e.type"), F.lit("highlight")).alias("event_type"), start.alias("start"), F.coalesce(_number(F.col("e.end")), start + 10).alias("end"),
        clamp(F.coalesce(F.rint(_number(F.col("e.score"))), F.lit(5.0)), 1.0, 10.0).cast("int").alias("score"), F.col("e.description").alias("description"),
        *(_number(F.col(f"e.{c}")).alias(c) for c in ("setup_start", "peak_time", "outcome_end")),
        clamp(F.coalesce(_number(F.col("e.crop_x")), F.lit(0.5)), 0.0, 1.0).alias("crop_x"), clamp(F.coalesce(_number(F.col("e.crop_y")), F.lit(0.65)), 0.0, 1.0).alias("crop_y"),
        clamp(F.coalesce(_number(F.col("e.edit.zoom")), F.lit(1.0)), 1.0, 2.0).alias("zoom"), F.coalesce("e.edit.slowmo", F.lit(False)).alias("slowmo"),
        F.when(transition.isin(TRANSITIONS), transition).otherwise("slide").alias("transition"),
    )
    return out.where("start is not null"), parsed.where(~F.coalesce(good, F.lit(False))).drop("_r")


def padded(events: DataFrame, least: float = 5.0, pad: float = 6.0) -> DataFrame:
    """Events of at least `least` seconds, `pad` seconds long at least."""
    return events.where(F.col("end") - F.col("start") >= least).withColumn("end", F.greatest("end", F.col("start") + pad))


def on_source_time(events: DataFrame, chunks: DataFrame, source: str = "source", least: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Events of numbered chunks on their source's time line, persons named by chunk where there are several; and the invalid ones with reasons.

    chunks: source, chunk_index, offset, length (a row for each chunk).
    """
    counted = chunks.join(chunks.groupBy(source).agg(F.count(F.lit(1)).alias("chunks")), source)
    both = events.join(counted, [source, "chunk_index"]).withColumn("_w", chunk_window(F.col("start"), F.col("end"), F.col("offset"), F.col("length"), least))
    named = both.withColumn("person", namespaced(F.col("chunk_index"), F.col("chunks"), F.col("person"))).drop("chunks", "offset", "length")
    keep = [c for c in named.columns if c not in ("start", "end", "_w")]
    good = named.where("_w.valid").select(*keep, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), F.col("_w.encoding").alias("encoding"), F.col("_w.basis").alias("basis"), F.col("_w.clamped").alias("clamped"))
    return good, named.where("not _w.valid").select(*keep, "start", "end", F.col("_w.reason").alias("reason"))


def judged_candidates(candidates: DataFrame, chunks: DataFrame, source: str = "source", least: float = 4.0) -> DataFrame:
    """All candidates of numbered chunks, those with a good window moved to their source's time line, the others discarded with the reason and their window as told.

    candidates: source, chunk_index, person, start, end, selected, discarded, selection_reason, discard_cause and anything else; `originally_selected` keeps what was chosen, and
    valid, encoding, basis, clamped and recovered (told in minutes and seconds) say what became of the window.
    """
    counted = chunks.join(chunks.groupBy(source).agg(F.count(F.lit(1)).alias("_chunks")), source).select(source, "chunk_index", F.col("offset").alias("_offset"), F.col("length").alias("_length"), "_chunks")
    both = candidates.join(counted, [source, "chunk_index"]).withColumn("_w", chunk_window(F.col("start"), F.col("end"), F.col("_offset"), F.col("_length"), least))
    ok = F.col("_w.valid")
    out = both.withColumn("originally_selected", F.coalesce("selected", F.lit(False))).withColumns({
        "person": namespaced(F.col("chunk_index"), F.col("_chunks"), F.col("person")), "valid": ok, "selected": ok & F.col("originally_selected"),
        "discarded": ~ok | F.coalesce("discarded", F.lit(False)), "selection_reason": F.when(ok, F.col("selection_reason")),
        "discard_cause": F.when(ok, F.col("discard_cause")).otherwise(F.coalesce("_w.reason", F.lit("timestamp_outside_chunk_bounds"))),
        "start": F.when(ok, F.col("_w.start")).otherwise(F.col("start")), "end": F.when(ok, F.col("_w.end")).otherwise(F.col("end")),
        "encoding": F.when(ok, F.col("_w.encoding")), "basis": F.when(ok, F.col("_w.basis")), "clamped": ok & F.coalesce("_w.clamped", F.lit(False)),
        "recovered": ok & F.coalesce(F.col("_w.encoding") == "minute_second", F.lit(False)),
    })
    return out.drop("_w", "_offset", "_length", "_chunks")


def _counters(encodings: list[str], bases: list[str]) -> list[Column]:
    counts = {"selected": F.col("selected"), "discarded": F.col("discarded"), "invalid": ~F.col("valid"), "clamped": F.col("clamped"), "recovered": F.col("recovered")}
    counts |= {f"encoding_{e}": F.col("encoding") == e for e in encodings} | {f"basis_{b}": F.col("basis") == b for b in bases}
    given = F.coalesce(F.max(F.col("discarded").cast("int")) == 1, F.lit(False)) & (F.count_if(F.col("discarded") & F.coalesce(F.col("discard_cause") == "", F.lit(True))) == 0)
    return [F.count(F.lit(1)).alias("candidates"), *(F.count_if(c).alias(k) for k, c in counts.items()), given.alias("causes_available")]


ENCODINGS, BASES = ["decimal_seconds", "minute_second"], ["chunk_local", "source_global"]


def candidate_counters(judged: DataFrame, by: list[str]) -> DataFrame:
    """Of each group of judged candidates: how many there are, were selected, discarded, invalid, clamped, recovered, of each encoding and basis, and whether
    there are discarded ones that all have a cause."""
    return judged.groupBy(*by).agg(*_counters(ENCODINGS, BASES))


def counted_on_the_way(judged: DataFrame) -> tuple[DataFrame, Observation]:
    """The same candidates and their counters over all, which Spark gathers while the candidates are written or otherwise used: no pass of their own."""
    seen = Observation("candidates")
    return judged.observe(seen, *_counters(ENCODINGS, BASES)), seen


def effective(first: list[Column], original: list[Column]) -> Column:
    """The final window where both of its bounds are known, else the original one."""
    whole = first[0].isNotNull() & first[1].isNotNull()
    return F.struct(F.when(whole, first[0]).otherwise(original[0]).alias("start"), F.when(whole, first[1]).otherwise(original[1]).alias("end"))


def expiry_counts(rows: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """active, expired and without an expiry."""
    at = F.col(expires)
    return rows.agg(F.count_if(at > as_of).alias("active"), F.count_if(at <= as_of).alias("expired"), F.count_if(at.isNull()).alias("missing"))


def visible_to(rows: DataFrame, owner: str, token: str, user: Column | None = None) -> DataFrame:
    """Rows that have a token or belong to the user (the session's, unless named)."""
    return rows.where(F.col(token).isNotNull() | F.coalesce(F.col(owner) == (F.current_user() if user is None else user), F.lit(False)))
