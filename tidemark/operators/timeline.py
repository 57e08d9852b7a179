"""Windows over ordered moments: merging, subtraction, order, running time lines, latest rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.overlap import points_in_intervals


def rides(df: DataFrame, key: list[str], gap: float = 7.0, start: str = "start", end: str = "end", ordinal: str = "ordinal", track: str | None = None) -> DataFrame:
    """`ride`: fragments of a key in order of start belong together while each starts at most `gap` seconds after the end of the one before
    (not the latest end so far) and, with `track`, has its track, as far as both are known."""
    order = Window.partitionBy(*key).orderBy(start, ordinal)
    near = F.col(start) <= F.lag(end).over(order) + gap
    if track:
        near = near & F.coalesce(F.col(track) == F.lag(track).over(order), F.lit(True))
    return df.withColumn("_fresh", F.when(near, 0).otherwise(1)).withColumn("ride", F.sum("_fresh").over(order)).drop("_fresh")


def merged_rides(df: DataFrame, key: list[str], track: str, gap: float = 7.0) -> DataFrame:
    """One row for each ride: bounds, fragments, best score and the moment that has it (first on ties), tracks, outcome known, review reasons."""
    outcome = F.max("outcome")
    out = rides(df, key, gap, track=track).groupBy(*key, "ride").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("fragments"), F.max("score").alias("score"),
        F.min_by("ordinal", F.struct(-F.col("score"), F.col("ordinal"))).alias("peak_ordinal"), F.array_sort(F.collect_set(track)).alias("tracks"), outcome.alias("outcome"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("outcome").isNull(), "RIDE_BOUNDARY_UNCERTAIN"), F.when(F.size("tracks") != 1, "IDENTITY_UNCERTAIN")))
    return out.withColumn("review", reasons)


def clean_subwindows(events: DataFrame, detections: DataFrame, key: list[str], event_id: str = "event_id", primary: str = "primary", least: float = 6.0, most: float = 15.0, others: float = 0.35, pad: float = 0.2, hits: int = 4) -> DataFrame:
    """Of each event the best stretch with its primary track alone: event_id, start, end, hits.

    The event less `others` seconds around each detection of another track leaves segments of at least `least` seconds; one with
    `hits` primary detections is cut to `pad` around them, `most` seconds at most. The longest wins, then most hits, then the earliest.
    Detections: key, t, track (null tracks say nothing). Events that have no such stretch are absent.
    """
    inside = points_in_intervals(detections.where("track is not null"), events.where(F.col("end") - F.col("start") >= least), key, "t", "start", "end", 60)
    inside = inside.select(event_id, "start", "end", "t", (F.col("track") == F.col(primary)).alias("own"))
    order = Window.partitionBy(event_id).orderBy("t")
    rival = inside.where("not own").withColumn("from", F.max(F.col("t") + others).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    low = F.greatest(F.col("start"), F.coalesce("from", "start"))
    before = rival.select(event_id, low.alias("low"), (F.col("t") - others).alias("high"))
    last = inside.groupBy(event_id).agg(F.max("start").alias("start"), F.max("end").alias("end"), F.max(F.when(~F.col("own"), F.col("t") + others)).alias("from"))
    after = last.select(event_id, F.greatest("start", F.coalesce("from", "start")).alias("low"), F.col("end").alias("high"))
    free = before.unionByName(after).where(F.col("high") - F.col("low") >= least)
    own = inside.where("own").select(event_id, "t")
    found = free.join(own, event_id).where(F.col("t").between(F.col("low"), F.col("high")))
    cut = found.groupBy(event_id, "low", "high").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("t")).alias("ts")).where(F.col("n") >= hits)
    start = F.greatest(F.col("low"), F.col("first") - pad)
    cut = cut.withColumn("start", start).withColumn("end", F.least(F.least(F.col("high"), F.col("last") + pad), F.col("start") + most)).where(F.col("end") - F.col("start") >= least)
    cut = cut.withColumn("hits", F.size(F.filter("ts", lambda t: t.between(F.col("start"), F.col("end")))))
    best = Window.partitionBy(event_id).orderBy(F.desc(F.col("end") - F.col("start")), F.desc("hits"), "start")
    return cut.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(event_id, "start", "end", "hits")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def top(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0, most: int = 50) -> tuple[DataFrame, bool]:
    """A page of rows in order, of `size` rows kept in 1 to `most`, and whether there may be more (the page is full)."""
    size = max(1, min(most, size))
    rows = df.orderBy(*order).offset(max(0, offset)).limit(size)
    return rows, rows.count() == size


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int, most: int = 50) -> DataFrame:
    """The page of `size` rows (kept in 1 to `most`) that follows the row whose order columns are `after` (null: the first page). order: column and whether it falls.

    Which rows come later is a filter on the first order column, which the scan takes, and a finer one, so a late page costs no more than the first. Order columns
    hold no nulls, and together tell rows apart."""
    size = max(1, min(most, size))
    by = [F.desc(c) if falls else F.asc(c) for c, falls in order]
    if after is None:
        return df.orderBy(*by).limit(size)
    beyond = F.lit(False)
    for (c, falls), at in reversed(list(zip(order, after))):
        further = F.col(c) < at if falls else F.col(c) > at
        beyond = further | ((F.col(c) == at) & beyond)
    (c, falls), at = order[0], after[0]
    return df.where((F.col(c) <= at) if falls else (F.col(c) >= at)).where(beyond).orderBy(*by).limit(size)


def canonical_uploads(df: DataFrame, digest: str, order: list[Column], upload: str) -> DataFrame:
    """Rows with `canonical` (the upload that stands for all of its digest: first in order) and `superseded`. A null digest stands for itself.

    Spark keeps one row of a digest in each task before it deals them, so a digest of many uploads is no large group; nulls are set apart."""
    known, alone = df.where(F.col(digest).isNotNull()), df.where(F.col(digest).isNull())
    best = latest(known, [digest], order).select(F.col(digest).alias("_d"), F.col(upload).alias("canonical"))
    both = known.join(best, F.col(digest) == F.col("_d")).drop("_d").unionByName(alone.withColumn("canonical", F.col(upload)))
    return both.withColumn("superseded", F.col("canonical") != F.col(upload))


def rendered_timeline(df: DataFrame, reel: str, fade: float = 0.25, ordinal: str = "ordinal") -> DataFrame:
    """`rendered_start` and `rendered_end`: each clip begins where those before it end, fades overlapping."""
    w = Window.partitionBy(reel).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("end") - F.col("start") - fade).over(w), F.lit(0.0))
    return df.withColumn("rendered_start", at).withColumn("rendered_end", F.col("rendered_start") + F.col("end") - F.col("start"))


def narrative_order(df: DataFrame, reel: str, score: str = "score", ordinal: str = "ordinal") -> DataFrame:
    """`place` (from 1): the second best first, the rest by rising score, the best last. Ties go to the smaller ordinal."""
    w = Window.partitionBy(reel)
    rank = F.row_number().over(w.orderBy(F.desc(score), ordinal))
    n = F.count(F.lit(1)).over(w)
    place = F.when(rank == 1, n).when(rank == 2, 1).otherwise(n - rank + 2)
    return df.withColumn("place", place.cast("int"))


LEAST_CLIMAX = 6.5  # fixed value


def quality_order(df: DataFrame, reel: str, quality: str = "quality", evidence: str = "evidence", least: float = LEAST_CLIMAX, ordinal: str = "ordinal") -> DataFrame:
    """`place` (from 1) and `climax`: a reel's best event with evidence and a quality of `least` comes last, the best of the others first, the rest between
    them by rising quality. A reel without such an event rises all through. Ties keep the order of ordinals."""
    w = Window.partitionBy(reel)
    fit = F.coalesce(F.col(evidence) & (F.col(quality) >= least), F.lit(False))
    told = df.withColumn("climax", fit & (F.row_number().over(w.orderBy(F.desc(fit), F.desc(quality), ordinal)) == 1))
    told = told.withColumns({"_n": F.count(F.lit(1)).over(w), "_any": F.bool_or("climax").over(w), "_down": F.row_number().over(w.orderBy("climax", F.desc(quality), ordinal))})
    opens = F.col("_any") & ~F.col("climax") & (F.col("_down") == 1)
    rises = F.row_number().over(Window.partitionBy(reel, "climax", "_opens").orderBy(quality, ordinal))
    place = F.when(F.col("climax"), F.col("_n")).when(F.col("_opens"), 1).when(F.col("_any"), rises + 1).otherwise(rises)
    return told.withColumn("_opens", opens).withColumn("place", place.cast("int")).drop("_n", "_any", "_down", "_opens")


def single_slow(df: DataFrame, reel: str, place: str = "place", least: int = 8) -> DataFrame:
    """`slow_final`: only a reel's last event, if flagged and scored `least`."""
    last = F.row_number().over(Window.partitionBy(reel).orderBy(F.desc(place))) == 1
    return df.withColumn("slow_final", last & F.col("slow") & (F.col("score") >= least))


TEASER_AT, TEASER_SECONDS, TEASER_SPARE, SINGLE_CAP = 0.65, 2.5, 2.0, 15.0  # fixed values


def teasers(df: DataFrame, reel: str, place: str = "place", at: float = TEASER_AT, seconds: float = TEASER_SECONDS, spare: float = TEASER_SPARE, cap: float = SINGLE_CAP) -> DataFrame:
    """The events and, for each reel whose last one is more than `spare` longer than a teaser, a teaser of that one at place 0.

    A teaser's middle lies at `at` of the last event, but all of it inside; of a reel's only event, which is shown for `cap` seconds at most, it is the end of
    what is shown."""
    w = Window.partitionBy(reel)
    last = F.row_number().over(w.orderBy(F.desc(place))) == 1
    length = F.col("end") - F.col("start")
    middle = F.greatest(F.col("start"), F.least(F.col("start") + length * at - seconds / 2, F.col("end") - seconds))
    start = F.when(F.col("_n") > 1, middle).otherwise(F.col("start") + F.least(length, F.lit(cap)) - seconds)
    told = df.withColumn("_l", last).withColumn("_n", F.count(F.lit(1)).over(w))
    extra = told.where(F.col("_l") & (length > seconds + spare)).withColumn("start", start).withColumn("end", F.col("start") + seconds).withColumn(place, F.lit(0)).withColumn("teaser", F.lit(True))
    return df.withColumn("teaser", F.lit(False)).unionByName(extra.drop("_l", "_n"))


def single_capped(df: DataFrame, events: str, cap: float = SINGLE_CAP) -> DataFrame:
    """`shown_until`: a reel's only event (`events`: how many the reel has) ends after `cap` seconds, others where they end."""
    return df.withColumn("shown_until", F.when(F.col(events) == 1, F.least("end", F.col("start") + cap)).otherwise(F.col("end")))


def unique_names(df: DataFrame, name: str, ordinal: str, suffix: str = ".mp4") -> DataFrame:
    """`unique_name`, in order of `ordinal`: a name that is taken gets the first free number from _02 on, before its suffix (`suffix` where it has none).

    Names that differ by such numbers alone may take each other's; only these families (of one stem) are gone through row by row. A family of
    one name is numbered by a window.
    """
    ends = r"^(.+)(\.[^.]+)$"
    stem = F.when(F.rlike(name, F.lit(ends)), F.regexp_extract(name, ends, 1)).otherwise(F.col(name))
    tail = F.when(F.rlike(name, F.lit(ends)), F.regexp_extract(name, ends, 2)).otherwise(F.lit(suffix))
    named = df.withColumn("_stem", stem).withColumn("_tail", tail).withColumn("_family", F.concat(F.regexp_replace("_stem", r"(_\d{2,})+$", ""), F.lit("|"), "_tail"))
    mixed = named.groupBy("_family").agg((F.min(name) != F.max(name)).alias("_mixed"))
    told = named.join(mixed, "_family", "left")
    k = F.row_number().over(Window.partitionBy(name).orderBy(ordinal))
    plain = told.where(~F.coalesce("_mixed", F.lit(False))).withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat("_stem", F.lit("_"), F.lpad(k.cast("string"), F.greatest(F.lit(2), F.length(k.cast("string"))), F.lit("0")), "_tail")))
    inside = told.where("_mixed")

    def numbered(rows: pd.DataFrame) -> pd.DataFrame:
        used, after = set(), {}
        out = []
        for one, s, t in rows.sort_values(ordinal)[[name, "_stem", "_tail"]].itertuples(index=False):
            n = after.get(one, 2)
            new = one
            while new in used:
                new, n = f"{s}_{n:02d}{t}", n + 1
            after[one] = n
            used.add(new)
            out.append(new)
        return rows.sort_values(ordinal).assign(unique_name=out)

    schema = T.StructType([*inside.schema.fields, T.StructField("unique_name", T.StringType())])
    both = plain.unionByName(inside.groupBy("_family").applyInPandas(numbered, schema))
    return both.drop("_stem", "_tail", "_family", "_mixed")


def multiset_matches(left: DataFrame, right: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """All left rows with `matched`: the n-th row of a key on the left uses the n-th on the right, each once."""
    w = Window.partitionBy(*key).orderBy(ordinal)
    l, r = left.withColumn("_n", F.row_number().over(w)), right.withColumn("_n", F.row_number().over(w)).select(*key, "_n", F.lit(True).alias("_hit"))  # noqa: E741
    return l.join(r, [*key, "_n"], "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_n", "_hit")


def moving_peak(df: DataFrame, key: list[str], order: str, value: str, width: int) -> DataFrame:
    """Of each key the place where the mean of `width` following values is largest (first on ties), and that mean as sum."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(0, width - 1)
    sums = df.withColumn("window_sum", F.sum(value).over(w)).withColumn("window_rows", F.count(value).over(w)).where(F.col("window_rows") == width)
    best = F.min_by(F.struct(order, "window_sum"), F.struct(-F.col("window_sum"), F.col(order)))
    return sums.groupBy(*key).agg(best.alias("b")).select(*key, F.col(f"b.{order}").alias(order), F.col("b.window_sum").alias("window_sum"))


def chunk_specs(sources: DataFrame, source: str, seconds: str, chunk: float = 480.0) -> DataFrame:
    """source, chunk_index, offset, length: the chunks of every source; the last is shorter."""
    n = F.greatest(F.ceil(F.col(seconds) / chunk), F.lit(1))
    rows = sources.select(source, F.col(seconds), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return rows.select(source, "chunk_index", (F.col("chunk_index") * chunk).alias("offset"), F.least(F.lit(chunk), F.col(seconds) - F.col("chunk_index") * chunk).alias("length"))


def rate_limited(df: DataFrame, key: list[str], seconds: str, limit: int, window: int) -> DataFrame:
    """`in_window` (rows of the key in the last `window` seconds, this one too) and `allowed`."""
    w = Window.partitionBy(*key).orderBy(seconds).rangeBetween(-window + 1, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("in_window") <= limit)


def sessions(df: DataFrame, key: list[str], seconds: str, quiet: int) -> DataFrame:
    """One row for each session: rows of a key less than `quiet` seconds apart."""
    w = Window.partitionBy(*key).orderBy(seconds)
    fresh = F.when(F.col(seconds) - F.lag(seconds).over(w) < quiet, 0).otherwise(1)
    numbered = df.withColumn("_f", fresh).withColumn("session", F.sum("_f").over(w))
    return numbered.groupBy(*key, "session").agg(F.min(seconds).alias("first_s"), F.max(seconds).alias("last_s"), F.count(F.lit(1)).alias("rows"))
