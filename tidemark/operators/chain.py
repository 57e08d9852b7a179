"""Clusters of appearances made safe: missing people added, impossible clusters split, equal descriptions merged, a verifier's doubts applied.

A table of members goes through every step: cluster (text), turn (array: where the cluster stands among all), description (of the cluster), place (array: where the
appearance stands in it), ident, clip, own (the appearance's description) and lineage (what was done to it). A cluster keeps its id for as long as it
stands; one that is split off is named by the cluster that it leaves and its appearance, a merged one takes the first one's. Every step keeps all appearances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import described, shirt_numbers

UNKNOWN = "unknown athlete"
BEHIND = 1 << 62  # added clusters stand behind all others


def noted(what: Column | str) -> Column:
    return F.array_append("lineage", F.lit(what) if isinstance(what, str) else what)


def own_description(fallback: Column) -> Column:
    """An appearance's own description, else another."""
    return F.when(F.coalesce("own", F.lit("")) != "", F.col("own")).otherwise(fallback)


def members_of(clusters: DataFrame) -> DataFrame:
    """Rows (cluster, description, position, ident, clip, own) as members; clusters stand in the order of `cluster`, appearances in that of `position`."""
    turn, place = F.array(F.col("cluster").cast("long")), F.array(F.col("position").cast("long"))
    return clusters.select(F.col("cluster").cast("string").alias("cluster"), turn.alias("turn"), "description", place.alias("place"), "ident", "clip", "own", F.array().cast("array<string>").alias("lineage"))


def with_missing(members: DataFrame, everyone: DataFrame) -> DataFrame:
    """Also everyone (ident, clip, own, position) who is in no cluster, each a cluster behind all others."""
    absent = everyone.join(members.select("ident"), "ident", "left_anti")
    added = absent.select(
        F.concat(F.lit("new/"), F.col("ident").cast("string")).alias("cluster"), F.array(F.lit(BEHIND), F.col("position").cast("long")).alias("turn"), own_description(F.lit(UNKNOWN)).alias("description"),
        F.array(F.lit(0).cast("long")).alias("place"), "ident", "clip", "own", F.array(F.lit("added")).alias("lineage"),
    )
    return members.unionByName(added)


def impossible(members: DataFrame) -> DataFrame:
    """cluster and why: same_clip (two appearances of one clip; unknown clips count as one), or numbers (an appearance has numbers, none of which an
    earlier one has, though an earlier one has some). Nothing of a cluster is collected: a number's first place tells who brought it."""
    clips = members.groupBy("cluster").agg((F.count(F.lit(1)) > F.count_distinct(F.struct("clip"))).alias("same_clip"))
    said = members.select("cluster", "place", F.explode(shirt_numbers(F.col("own"))).alias("number"))
    first = said.groupBy("cluster", "number").agg(F.min("place").alias("first"))
    each = said.join(first, ["cluster", "number"]).groupBy("cluster", "place").agg((F.min("first") == F.col("place")).alias("fresh"))
    fresh = each.groupBy("cluster").agg((F.count_if("fresh") > 1).alias("numbers"))  # the first numbered appearance is fresh itself
    why = F.when(F.col("same_clip"), "same_clip").when(F.col("numbers"), "numbers")
    return clips.join(fresh, "cluster", "left").select("cluster", why.alias("why")).where("why is not null")


def alone(members: DataFrame, out: Column, why: Column, description: Column) -> DataFrame:
    """Members where `out` holds, each a cluster of its own, right behind the one that it leaves."""
    name, turn = F.concat("cluster", F.lit("/"), F.col("ident").cast("string")), F.concat("turn", "place")
    pick = lambda new, old: F.when(out, new).otherwise(F.col(old)).alias(old)
    return members.select(
        pick(name, "cluster"), pick(turn, "turn"), pick(description, "description"), pick(F.array(F.lit(0).cast("long")), "place"), "ident", "clip", "own", pick(noted(why), "lineage")
    )


def split_impossible(members: DataFrame) -> DataFrame:
    """Clusters that can't be one person fall into single appearances."""
    told = members.join(impossible(members), "cluster", "left")
    fallback = F.coalesce("description", F.lit(UNKNOWN))
    return alone(told, F.col("why").isNotNull(), F.concat(F.lit("split:"), F.col("why")), own_description(fallback))


def merged_descriptions(members: DataFrame) -> DataFrame:
    """Of clusters of one description (letters, digits and blanks, lower-cased) the first takes in each later one that shares no clip with what it holds by then.

    In rounds: of the open clusters of a description those that come first for all of their clips are taken in, and those that share a clip with one
    taken in stay by themselves; nothing is ordered or collected in one task. checkpoint() cuts each round's lineage, so a checkpoint folder must be set.
    """
    named = members.withColumn("key", described(F.col("description"))).where("key <> ''").select("key", "cluster", "turn", F.coalesce(F.col("clip").cast("string"), F.lit("")).alias("clip")).distinct()
    several = named.groupBy("key").agg(F.count_distinct("cluster").alias("n"), F.min(F.struct("turn", "cluster")).alias("head")).where("n > 1")
    open_, rounds = named.join(several.select("key", "head"), "key").checkpoint(), []
    while open_.limit(1).count():
        first = open_.groupBy("key", "clip").agg(F.min(F.struct("turn", "cluster")).alias("first"))
        leads = open_.join(first, ["key", "clip"]).groupBy("key", "cluster").agg(F.bool_and(F.col("first.cluster") == F.col("cluster")).alias("leads"), F.first("head").alias("head"))
        taken = leads.where("leads").select("key", "cluster", "head").checkpoint()
        rounds.append(taken)
        held = open_.join(taken.select("key", "cluster"), ["key", "cluster"]).select("key", "clip").distinct()
        met = open_.join(held, ["key", "clip"]).select("key", "cluster").distinct()  # those taken in, and those that share a clip with one
        open_ = open_.join(met, ["key", "cluster"], "left_anti").checkpoint()
    if not rounds:
        return members
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    heads = members.select("cluster", "description").groupBy("cluster").agg(F.first("description").alias("_said"))
    into = every.where("cluster <> head.cluster").select("cluster", F.col("head.cluster").alias("_into"), F.col("head.turn").alias("_turn")).join(heads.withColumnRenamed("cluster", "_into"), "_into")
    grown = every.select(F.col("head.cluster").alias("cluster")).distinct().withColumn("_grows", F.lit(True))
    told = members.join(into, "cluster", "left").join(grown, "cluster", "left")
    moved = F.col("_into").isNotNull()
    place = F.when(moved | F.coalesce("_grows", F.lit(False)), F.concat("turn", "place")).otherwise(F.col("place"))  # behind those of earlier clusters
    pick = lambda new, old: F.when(moved, new).otherwise(F.col(old)).alias(old)
    return told.select(
        pick(F.col("_into"), "cluster"), pick(F.col("_turn"), "turn"), pick(F.col("_said"), "description"), place.alias("place"), "ident", "clip", "own", pick(noted(F.concat(F.lit("merged:"), F.col("cluster"))), "lineage")
    )


def verified(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Members after a verifier's word on clusters of several appearances (cluster, same_person, bad: idents). Named appearances leave, each for itself; where none or all
    are named though it is not one person, all do. Clusters without a verdict stay."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    said = verdicts.groupBy(F.col("cluster").cast("string").alias("cluster")).agg(F.bool_and("same_person").alias("same_person"), F.flatten(F.collect_list("bad")).alias("bad"))
    hit = members.join(said, "cluster").where(F.array_contains("bad", F.col("ident"))).groupBy("cluster").agg(F.count(F.lit(1)).alias("hits"))
    told = members.join(size, "cluster").join(said, "cluster", "left").join(hit, "cluster", "left")
    hits = F.coalesce("hits", F.lit(0))
    doubted = (F.col("size") > 1) & F.col("same_person").isNotNull() & (~F.col("same_person") | (hits > 0))
    whole = F.coalesce(doubted & ((hits == 0) | (hits >= F.col("size"))), F.lit(False))
    one = F.coalesce(doubted & ~whole & F.array_contains("bad", F.col("ident")), F.lit(False))
    fallback = F.coalesce("description", F.lit(UNKNOWN))
    description = own_description(F.when(one, F.concat(fallback, F.lit(" (separated)"))).otherwise(fallback))
    return alone(told, whole | one, F.when(one, "verified_out").otherwise(F.lit("split:unverified")), description)


def post_processed(members: DataFrame, everyone: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All steps in order. Merging and each later step read members cut off by checkpoint()."""
    merged = merged_descriptions(split_impossible(with_missing(members, everyone)).checkpoint()).checkpoint()
    return split_impossible(verified(split_impossible(merged), verdicts).checkpoint())
