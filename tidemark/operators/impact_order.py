"""The order of a reel by impact: a short hook first, a build of rising impact without two neighbours of one kind where a swap helps, the climax last."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scores

# Weights of the kinds of moments in a ride; any other kind has OTHER.
WEIGHTS = {"aerial": 6, "barrel": 6, "tube_ride": 6, "snap": 5, "cutback": 5, "carve": 4, "bottom_turn": 3, "wave_catch": 3, "near_miss": 2, "wipeout": 1, "paddle": 0}
LOW = ["paddle", "wipeout"]
OTHER, HOOK_SECONDS = 2, 10.0


def ride_impact(score: Column, kind: Column, seconds: Column) -> Column:
    weight = F.lit(OTHER)
    for name, value in WEIGHTS.items():
        weight = F.when(kind == name, value).otherwise(weight)
    return scores.impact(score, weight, seconds, F.coalesce(kind.isin(LOW), F.lit(False)))


def impact_order(df: DataFrame, reel: str) -> DataFrame:
    """Rows with `impact` and `place` (from 1). The climax is the event of most impact; the hook the one of most impact among the others that are of no low
    kind and at most ten seconds long, or among all others where there is none; the build between them rises by (impact, start). Ties keep the order of ordinals.

    Where two neighbours of the build are of one kind, the second changes places with the next event of another kind, if there is one. A reel of up to two
    events, or of which less than half (rounded down, one at least) are kinds of a ride, keeps its order. Columns: ordinal, kind, score, start, end; kinds
    are compared in lower case, a null score counts 0, a missing time makes a length of 0. Ordinals are unique within a reel; rows without a reel get no place.

    Only builds with two such neighbours go to pandas, one reel a group: a reel is a film, not a key of unbounded size.
    """
    kind = F.lower(F.coalesce("kind", F.lit("")))
    seconds = F.greatest(F.lit(0.0), F.coalesce(F.col("end").cast("double") - F.col("start").cast("double"), F.lit(0.0)))
    rated = df.withColumns({"_kind": kind, "_seconds": seconds}).withColumn("impact", ride_impact(F.coalesce("score", F.lit(0)), F.col("_kind"), F.col("_seconds")))
    w = Window.partitionBy(reel)
    half = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 2))
    rated = rated.withColumns({"_n": F.count(F.lit(1)).over(w), "_ride": F.count(F.when(F.col("_kind").isin(list(WEIGHTS)), 1)).over(w) >= half, "_asis": F.row_number().over(w.orderBy("ordinal"))})
    rated = rated.withColumn("_climax", F.row_number().over(w.orderBy(F.desc("impact"), "ordinal")) == 1)
    able = ~F.col("_climax") & ~F.col("_kind").isin(LOW) & (F.col("_seconds") <= HOOK_SECONDS)
    rated = rated.withColumn("_hook", ~F.col("_climax") & (F.row_number().over(w.orderBy("_climax", F.desc(able), F.desc("impact"), "ordinal")) == 1))
    build = Window.partitionBy(reel, "_climax", "_hook").orderBy("impact", F.coalesce("start", F.lit(0)), "ordinal")
    moved = F.when(F.col("_climax"), F.col("_n")).when(F.col("_hook"), 1).otherwise(F.row_number().over(build) + 1)
    arranged = F.col("_ride") & (F.col("_n") > 2)
    middle = arranged & ~F.col("_climax") & ~F.col("_hook")
    same = middle & (F.col("_kind") == F.lag("_kind").over(build))
    placed = rated.withColumns({"place": F.when(F.col(reel).isNotNull(), F.when(arranged, moved).otherwise(F.col("_asis"))).cast("int"), "_middle": middle, "_same": F.coalesce(same, F.lit(False))})
    placed = placed.withColumn("_alike", F.bool_or("_same").over(w) & F.col("_middle") & F.col(reel).isNotNull())
    key = df.schema[reel]

    def varied(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place", ignore_index=True)
        kinds, who = pd.factorize(rows["_kind"])[0], rows["ordinal"].to_numpy().copy()
        for k in np.arange(1, len(who)):
            others = np.flatnonzero(kinds[k + 1 :] != kinds[k]) if kinds[k] == kinds[k - 1] else ()
            if len(others):
                two = [k, k + 1 + others[0]]
                kinds[two], who[two] = kinds[two[::-1]], who[two[::-1]]
        return rows[[reel]].assign(ordinal=who, _place=rows["place"])

    swapped = placed.where("_alike").select(reel, "ordinal", "place", "_kind").groupBy(reel).applyInPandas(varied, T.StructType([key, *T.StructType.fromDDL("ordinal long, _place int")]))
    out = placed.join(swapped, [reel, "ordinal"], "left").withColumn("place", F.coalesce("_place", "place"))
    return out.select(*df.columns, "impact", "place")
