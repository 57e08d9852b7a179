"""Next-fit packing of ordered events into parts of a bounded length, without a reel as one task.

Where a part ends depends only on where it begins. So every event is taken as a possible beginning and gets a pointer to the next one, block of places by
block; the true beginnings are those that the first one reaches, and pointers that join their own targets find these in as many steps as the number of
blocks has binary digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 2048
GROUP = 1 << 15


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with `place` (from 0, by `order` within the key) and `of` (rows of the key). Numbered by ranges and the ranges' counts, so that a large key is
    spread over tasks; checkpoint() holds the ranges fast, so a checkpoint folder must be set. `order` must tell the rows of a key apart."""
    ranged = rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    by_key = Window.partitionBy(key)
    before = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(by_key).alias("of"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(counts, [key, "_range"]).withColumn("place", F.col("_before") + F.col("_inside") - 1).drop("_range", "_inside", "_before")


def stretched(seconds: Column, score: Column, slow: Column, levels: list[tuple[float, float, float]]) -> tuple[Column, Column]:
    """An event's rank among the slow ones of its part (-inf: it is never slowed) and the seconds that slowing adds; `levels` lists least score, share of
    the event that is slowed and times slower, highest score first."""
    rank, gain = F.lit(float("-inf")), F.lit(0.0)
    for least, share, times in reversed(levels):
        here = slow & (score >= F.lit(float(least)))
        rank, gain = F.when(here, score.cast("double")).otherwise(rank), F.when(here, seconds * share * (times - 1)).otherwise(gain)
    return rank, gain


def _carried(events: pd.DataFrame, at, stop, total, best, more, budget: float, fade: float):
    """Open parts, each with the next event to take, its length, and its best slow event's rank and gain, take events in step until one doesn't fit or the
    part's own `stop` is met. Returns the arrays after that; a part that stands before its stop is closed by the event there."""
    seconds, rank, gain = (events[c].to_numpy(np.float64) for c in ("seconds", "rank", "gain"))
    live = np.flatnonzero(at < stop)
    while len(live):
        e = at[live]
        longer, better = total[live] + seconds[e] - fade, rank[e] > best[live]
        top, extra = np.where(better, rank[e], best[live]), np.where(better, gain[e], more[live])
        fits = np.maximum(0.0, longer + extra) <= budget
        live = live[fits]
        total[live], best[live], more[live] = longer[fits], top[fits], extra[fits]
        at[live] += 1
        live = live[at[live] < stop[live]]
    return at, total, best, more


def _chain(first: int, following, stop: int) -> list[int]:
    """The beginnings from `first` on, before `stop`."""
    out = []
    while first < stop:
        out.append(first)
        first = following[first]
    return out


def parts(events: DataFrame, reel: str, order: list[str], budget: float, fade: float, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """reel, ordinal, part (from 0) and seconds (of the whole part) of events with ordinal, seconds, rank and gain (see `stretched`) and the columns of
    `order`, which tells a reel's rows apart. A part takes its first event whatever its length, and ends where the next would make it longer than `budget`.

    A reel of up to `block` events is one block, a longer one several; about `group` events, of many blocks, are one pandas group. Open parts are handed on from
    block to block, so a part that spans many blocks costs a round a block; parts of bounded length cost one. Needs a checkpoint folder. Reels without a name
    must have been set apart; `events` is read several times, so it should be a table or a checkpoint.
    """
    key = events.schema[reel]
    narrow = events.select(*dict.fromkeys([reel, "ordinal", "seconds", "rank", "gain", *order]))
    counts = narrow.groupBy(reel).agg(F.count(F.lit(1)).alias("of"))
    every, largest = counts.agg(F.sum("of"), F.max("of")).first()
    if not every:
        return narrow.select(reel, "ordinal", F.lit(None).cast("int").alias("part"), "seconds")
    place = F.row_number().over(Window.partitionBy(reel).orderBy(*order)) - 1
    if largest <= block:
        numbered = narrow.withColumns({"place": place.cast("long"), "of": F.lit(largest)})
    else:
        sized = narrow.join(counts, reel)
        numbered = sized.where(F.col("of") <= block).withColumn("place", place.cast("long"))
        numbered = numbered.unionByName(placed(sized.where(F.col("of") > block).drop("of"), reel, order))
    numbered = numbered.withColumn("block", F.floor(F.col("place") / block)).select(reel, "block", "place", "of", "ordinal", "seconds", "rank", "gain")

    pointer = "block long, place long, of long, ordinal long, seconds double, total double, best double, more double, next long, last long, count int, part long"

    def pointers(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(pdf[reel])[0]
        turn = np.lexsort((pdf["place"].to_numpy(), codes))
        rows, codes = pdf.iloc[turn].reset_index(drop=True), codes[turn]
        n, places, own = len(rows), rows["place"].to_numpy(), [rows[c].to_numpy(np.float64).copy() for c in ("seconds", "rank", "gain")]
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (np.diff(rows["block"].to_numpy()) != 0)])  # of each block
        stop = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
        at, total, best, more = _carried(rows, np.arange(1, n + 1), stop, *own, budget, fade)
        open_, whole = at >= stop, rows["of"].to_numpy() <= block
        last, count, steps = list(range(n)), [1] * n, at.tolist()
        for i in np.flatnonzero(~open_ & ~whole)[::-1].tolist():
            last[i], count[i] = last[steps[i]], count[steps[i]] + 1
        length, part = np.maximum(0.0, total + more), np.full(n, -1)
        if whole.any():  # blocks that are reels; the next block's first event begins a part as well
            begins = np.zeros(n, bool)
            for i in first[whole[first]].tolist():
                begins[_chain(i, steps, stop[i])] = True
            begins[first] = True
            parts_, of_first = np.cumsum(begins) - 1, np.flatnonzero(begins)
            part = np.where(whole, parts_ - np.repeat(parts_[first], np.diff(np.r_[first, n])), -1)
            length = np.where(whole, length[of_first][parts_], length)
        out = rows[[reel, "block", "place", "of", "ordinal"]].assign(seconds=length, total=total, best=best, more=more)
        shift = places - np.arange(n)
        following = pd.array(at + shift, "Int64")
        following[open_] = pd.NA
        return out.assign(next=following, last=np.array(last) + shift, count=count, part=part)

    groups = F.pmod(F.xxhash64(reel, "block"), F.lit(-(-every // group)))
    schema = T.StructType([key, *T.StructType.fromDDL(pointer)])
    first = numbered.withColumn("_group", groups).groupBy("_group").applyInPandas(lambda pdf: pointers(pdf.drop(columns="_group")), schema)
    if largest <= block:
        return first.select(reel, "ordinal", F.col("part").cast("int").alias("part"), "seconds")
    first = first.checkpoint()
    result = first.where(F.col("of") <= block).select(reel, "ordinal", F.col("part").cast("int").alias("part"), "seconds")
    long_ = first.where(F.col("of") > block)
    crossing = _crossing(long_, numbered.where(F.col("of") > block), reel, key, budget, fade, block)
    return result.unionByName(_reached(long_, crossing, reel, key, -(-largest // block), block))


def _crossing(first: DataFrame, numbered: DataFrame, reel: str, key: T.StructField, budget: float, fade: float, block: int) -> DataFrame:
    """reel, place, next (null at the reel's end) and seconds of the parts that are open where their block ends."""
    state = T.StructType([key, *T.StructType.fromDDL("place long, block long, closed boolean, total double, best double, more double, next long, seconds double")])
    final = F.floor((F.col("of") - 1) / block) == F.col("block")
    seen = first.where(F.col("next").isNull()).select(
        reel, "place", (F.col("block") + 1).alias("block"), final.alias("closed"), "total", "best", "more", F.lit(None).cast("long").alias("next"), "seconds"
    )
    done = [seen.where("closed")]
    open_ = seen.where(~F.col("closed")).checkpoint()

    def handed_on(parts_: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place", ignore_index=True)
        own = [parts_[c].to_numpy(np.float64).copy() for c in ("total", "best", "more")]
        at, total, best, more = _carried(rows, np.zeros(len(parts_), np.int64), np.full(len(parts_), len(rows)), *own, budget, fade)
        stopped = at < len(rows)
        ended = stopped | (rows["place"].iloc[-1] == rows["of"].iloc[0] - 1)
        following = pd.array(np.where(stopped, at + rows["place"].iloc[0], 0), "Int64")
        following[~stopped] = pd.NA
        out = parts_[[reel, "place"]].assign(block=parts_["block"] + 1, closed=ended, total=total, best=best, more=more)
        return out.assign(next=following, seconds=np.maximum(0.0, total + more))

    while not open_.isEmpty():
        needed = numbered.join(open_.select(reel, "block").distinct(), [reel, "block"], "left_semi")
        step = open_.groupBy(reel, "block").cogroup(needed.groupBy(reel, "block")).applyInPandas(handed_on, state).checkpoint()
        done.append(step.where("closed"))
        open_ = step.where(~F.col("closed"))
    out = done[0]
    for more_ in done[1:]:
        out = out.unionByName(more_)
    return out.select(reel, "place", "next", "seconds")


def _reached(first: DataFrame, crossing: DataFrame, reel: str, key: T.StructField, blocks: int, block: int) -> DataFrame:
    """reel, ordinal, part and seconds of reels of several blocks: of each block's possible entries the one that the reel's beginning reaches."""
    entries = crossing.where("next is not null").select(reel, F.col("next").alias("place")).union(first.select(reel, F.lit(0).cast("long")).distinct()).distinct()
    ways = first.join(entries, [reel, "place"]).select(reel, F.col("place").alias("entry"), "block", "count", F.col("last").alias("place"))
    ways = ways.join(crossing.select(reel, "place", "next"), [reel, "place"]).select(reel, "entry", "block", "count", "next").checkpoint()
    jumps = ways.where("next is not null").select(reel, "entry", "next")
    reached = ways.where("entry = 0").select(reel, "entry")
    for _ in range(int(blocks - 1).bit_length()):
        reached = reached.union(reached.join(jumps, [reel, "entry"]).select(reel, F.col("next").alias("entry"))).checkpoint()
        onward = jumps.select(reel, F.col("entry").alias("next"), F.col("next").alias("far"))
        jumps = jumps.join(onward, [reel, "next"]).select(reel, "entry", F.col("far").alias("next")).checkpoint()
    true = ways.join(reached, [reel, "entry"]).select(reel, "block", "entry", "count")
    before = Window.partitionBy(reel).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = first.select(reel, "block").distinct().join(true, [reel, "block"], "left")
    per_block = per_block.select(reel, "block", "entry", F.coalesce(F.sum(F.coalesce("count", F.lit(0))).over(before), F.lit(0)).alias("base"))

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place", ignore_index=True)
        n, at0, entry = len(rows), rows["place"].iloc[0], rows["entry"].iloc[0]
        following = (rows["next"] - at0).fillna(n).astype(np.int64).to_numpy()
        begins = np.array(_chain(n if pd.isna(entry) else int(entry - at0), following, n), np.int64)
        out = rows[[reel, "place", "ordinal", "seconds"]].assign(part=rows["base"] + np.searchsorted(begins, np.arange(n), side="right") - 1, begins=False)
        out.loc[begins, "begins"] = True
        return out

    schema = T.StructType([key, *T.StructType.fromDDL("place long, ordinal long, seconds double, part long, begins boolean")])
    rows = first.select(reel, "block", "place", "ordinal", "next", "seconds").join(per_block, [reel, "block"])
    told = rows.groupBy(reel, "block").applyInPandas(marked, schema).checkpoint()
    whole = crossing.select(reel, "place", F.col("seconds").alias("_whole"))
    lengths = told.where("begins").join(whole, [reel, "place"], "left").select(reel, "part", F.coalesce("_whole", "seconds").alias("seconds"))
    return told.select(reel, "ordinal", "part").join(lengths, [reel, "part"]).select(reel, "ordinal", F.col("part").cast("int").alias("part"), "seconds")
