"""Small joins: names, defects, tasks, prices of grades, and first matches in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import key
from tidemark.operators.overlap import points_in_intervals


GRAM = 3  # letters by which texts and needles meet


def first_needle(rows: DataFrame, text: str, needles: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows with `label`: that of the first needle (by ordinal, then label) that the text holds, in any case, else null.

    needles: ordinal, needle, label, at_end (held only where the text ends with it). However many there are, none is gone through row by row: each different text is
    looked up by its pieces of up to `gram` letters, each needle by that one of its own pieces which the fewest texts have, and what meets is compared letter by letter.
    Null and empty needles are in no text.
    """
    lowered = F.lower(F.col(text))
    pieces = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    sharp = needles.select("ordinal", "label", "at_end", F.lower("needle").alias("needle")).where("needle != ''").distinct()
    sized = [F.when(F.length("needle") == n if n < gram else F.length("needle") >= n, pieces(F.col("needle"), n)) for n in range(1, gram + 1)]
    uses = sharp.select("*", F.explode(F.array_distinct(F.coalesce(*sized))).alias("piece"))
    texts = rows.select(lowered.alias("_said")).where("_said is not null").distinct()
    cut = texts.select("_said", F.explode(F.array_distinct(F.concat(*(pieces(F.col("_said"), n) for n in range(1, gram + 1))))).alias("piece"))
    known = cut.join(uses.select("piece").distinct(), "piece", "left_semi")
    common = known.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))["piece"]
    chosen = uses.join(common, "piece", "left").groupBy("ordinal", "label", "at_end", "needle").agg(rarest.alias("piece"))
    holds = F.when(F.col("at_end"), F.endswith("_said", F.col("needle"))).otherwise(F.contains("_said", F.col("needle")))
    first = known.join(chosen, "piece").where(holds).groupBy("_said").agg(F.min(F.struct("ordinal", "label"))["label"].alias("label"))
    return rows.drop("label").join(first, lowered == F.col("_said"), "left").drop("_said")


def first_pattern(rows: DataFrame, text: str, patterns: DataFrame, ident: str | None = None) -> DataFrame:
    """Rows with `label`: that of the first pattern (by ordinal) contained in the text, else null. patterns: ordinal, pattern, label."""
    return first_needle(rows, text, patterns.select("ordinal", F.col("pattern").alias("needle"), "label", F.lit(False).alias("at_end")))


def clients_of(rows: DataFrame, text: str, clients: DataFrame) -> DataFrame:
    """Rows with `label`: the first client (by ordinal) whose shirt number or pattern a description holds. clients: ordinal, client, jersey, pattern.

    A shirt number is told as "#7", "number 7", "no. 7", as a word between blanks, or as the last word."""
    shirt = F.trim(F.col("jersey").cast("string"))
    form = lambda before, after="", end=False: F.struct(F.concat(F.lit(before), shirt, F.lit(after)).alias("needle"), F.lit(end).alias("at_end"))
    shirts = F.array(form("#"), form("number "), form("no. "), form(" ", " "), form(" ", end=True))
    worn = clients.where(shirt != "").select("ordinal", F.col("client").alias("label"), F.explode(shirts).alias("f")).select("ordinal", "f.needle", "label", "f.at_end")
    return first_needle(rows, text, worn.union(clients.select("ordinal", F.col("pattern"), F.col("client"), F.lit(False))))


def defect_events(defects: DataFrame, events: DataFrame, bucket: float = 60) -> DataFrame:
    """defect_id and ordinal: the event of the defect's id, else the first whose rendered span holds its time, else null.

    defects: defect_id, reel, event_id, at_seconds; events: reel, ordinal, event_id, rendered_start, rendered_end. Times meet spans in buckets of `bucket` seconds.
    """
    by_id = defects.join(events, ["reel", "event_id"]).groupBy("defect_id").agg(F.min("ordinal").alias("a"))
    spans = events.select("reel", "ordinal", "rendered_start", "rendered_end")
    hits = points_in_intervals(defects.select("defect_id", "reel", "at_seconds"), spans, ["reel"], "at_seconds", "rendered_start", "rendered_end", bucket)
    by_time = hits.groupBy("defect_id").agg(F.min("ordinal").alias("b"))
    return defects.select("defect_id").join(by_id, "defect_id", "left").join(by_time, "defect_id", "left").select("defect_id", F.coalesce("a", "b").alias("ordinal"))


def with_tasks(drafts: DataFrame, tasks: DataFrame, authority: DataFrame) -> DataFrame:
    """Drafts with their latest active task (created_at, then task_id, last first) and whether their publishability is known and granted."""
    w = Window.partitionBy("draft_id").orderBy(F.desc("created_at"), F.desc("task_id"))
    last = tasks.where(F.col("state").isin("pending", "running")).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("draft_id", "task_id", F.col("state").alias("task_state"))
    granted = authority.groupBy("draft_id").agg(F.bool_and("publishable").alias("publishable"))
    return drafts.join(last, "draft_id", "left").join(granted, "draft_id", "left").withColumn("authority_known", F.col("publishable").isNotNull()).withColumn("publishable", F.coalesce("publishable", F.lit(False)))


def matching_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, matches and right_id (where there is exactly one): rows with the same set of ids, whatever its order and repeats."""
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    r = right.select(F.col("id").alias("right_id"), as_set(F.col("ids")).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("right_id").alias("one"))
    out = left.select(F.col("id").alias("left_id"), as_set(F.col("ids")).alias("k")).join(r, "k", "left")
    return out.select("left_id", F.coalesce("n", F.lit(0)).alias("matches"), F.when(F.col("n") == 1, F.col("one")).alias("right_id"))


def resolved_appearances(named: DataFrame, known: DataFrame) -> DataFrame:
    """Named appearances (cluster, clip, person, ordinal) that exist and have events; each is used by the first that names it."""
    there = known.where("events > 0").select("clip", "person").distinct()
    w = Window.partitionBy("clip", "person").orderBy("ordinal")
    return named.join(there, ["clip", "person"], "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def chunks_merged(events: DataFrame, within: float = 5.0) -> DataFrame:
    """Events of all chunks on the source's time line: persons of one description (its first 40 letters) are one; starts less than `within` seconds apart
    are one event, the better scored. Columns: source, chunk_offset, person, description, ordinal, start, end, score."""
    from tidemark.operators.greedy import greedy_keep, near_start

    who = F.substring(F.lower("description"), 1, 40)
    moved = events.withColumn("person_key", who).withColumn("start", F.col("start") + F.col("chunk_offset")).withColumn("end", F.col("end") + F.col("chunk_offset")).withColumn("_stop", F.col("start"))
    return greedy_keep(moved, ["source", "person_key"], [("score", True)], "ordinal", near_start(within), "start", "_stop", within).drop("_stop")


def dominant(rows: DataFrame, by: list[str], value: str, ordinal: str, ignored: list[str], fallback: Column) -> DataFrame:
    """Of each group the commonest value that isn't ignored (ties: seen first), else the fallback."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    good = counted.where(F.col(value).isNotNull() & ~F.col(value).isin(ignored)).groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias("dominant"))
    return rows.select(*by).distinct().join(good, by, "left").withColumn("dominant", F.coalesce("dominant", fallback))


def counters_merged(payloads: DataFrame, by: list[str], counters: str) -> DataFrame:
    """Maps of counts, summed by name; the names in order."""
    flat = payloads.select(*by, F.explode(counters).alias("name", "n")).groupBy(*by, "name").agg(F.sum("n").alias("n"))
    return flat.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(counters))


def silent_variants(files: DataFrame) -> DataFrame:
    """Of each group the first file (by ordinal) without sound and without issues; a group without one has a failure code. files: group, ordinal, file, has_audio, issues."""
    good = F.coalesce(~F.col("has_audio"), F.lit(False)) & (F.size("issues") == 0)
    out = files.groupBy("group").agg(
        F.min_by(F.when(good, F.col("file")), F.when(good, F.col("ordinal"))).alias("file"), F.bool_and(F.coalesce("has_audio", F.lit(False))).alias("loud"), F.bool_and(F.col("has_audio").isNull()).alias("unknown")
    )
    return out.select("group", "file", F.when(F.col("file").isNotNull(), None).when(F.col("unknown"), "audio_unknown").when(F.col("loud"), "no_silent_variant").otherwise("technical_issues").alias("failure"))


def fits_in_crop(samples: DataFrame, by: list[str], pad: float = 0.015, least: int = 2) -> DataFrame:
    """Of each group: samples, tracks, and whether every box lies in the crop around the median centre. samples: x1, x2 (shares of the width), crop (its share), track."""
    middle = samples.groupBy(*by).agg(F.median((F.col("x1") + F.col("x2")) / 2).alias("centre"))
    inside = (F.col("x1") >= F.col("centre") - F.col("crop") / 2 + pad) & (F.col("x2") <= F.col("centre") + F.col("crop") / 2 - pad)
    out = samples.join(middle, by).groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("track").alias("tracks"), F.bool_and(inside).alias("inside"))
    return out.withColumn("fits", F.col("inside") & (F.col("samples") >= least) & (F.col("tracks") == 1)).drop("inside")


def empty_manifest(manifest: DataFrame, ident: str) -> DataFrame:
    """Whether a manifest is provably empty: it was read, has no rows and says so; anything else is not. manifest: ident, readable, rows, summary_count."""
    sure = F.col("readable") & (F.col("rows") == 0) & (F.col("summary_count") == 0)
    return manifest.select(ident, F.coalesce(sure, F.lit(False)).alias("empty"))


def best_music(tracks: DataFrame, by: list[str], score: str, ident: str, seed: int = 7, k: int = 3) -> DataFrame:
    """Of each group one of its k best tracks, picked by a hash of the group and seed, so that a repeated run picks the same."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    best = tracks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", ident))).alias("_b"))
    pick = F.get("_b", F.pmod(F.xxhash64(F.lit(seed), *by), F.size("_b")).cast("int"))
    return best.select(*by, pick[ident].alias(ident))


def graded(events: DataFrame, base: DataFrame, delta: DataFrame) -> DataFrame:
    """Events with their grade: the sport's base and the kind's delta, 0 where there is none. base: sport, contrast; delta: event_type, extra."""
    return events.join(base, "sport", "left").join(delta, "event_type", "left").withColumn("contrast", F.coalesce("contrast", F.lit(0)) + F.coalesce("extra", F.lit(0))).drop("extra")


def description_key(text: Column) -> Column:
    return key(text, " ")
