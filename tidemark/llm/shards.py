"""Shards by a k-d tree over documents' metadata, cut at distributed weighted medians.

Each node is cut along the dimension that is widest in it, at the place that gives its two sides bytes in proportion to their
leaves. All nodes of a level are cut together. A document's place is a key of two numbers: its value in the dimension with a hash of the
text, so that equal texts stay side by side, then a hash of the id. A cut is found from sums of bytes by equal intervals of the
keys that it may lie between, again and again: a small grouped aggregation each time, however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

DIMS = ("size", "wide", "lines")
BINS = 10  # 2**BINS intervals of each node's keys are told apart in one aggregation


def metadata(text: Column) -> dict[str, Column]:
    """What texts are placed by, each 0 to 2**31 - 1: bytes, share of bytes beyond one for each character, lines for each 4096 characters."""
    n, chars = F.octet_length(text), F.greatest(F.char_length(text), F.lit(1))
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    clip = lambda c: F.least(c, F.lit((1 << 31) - 2)).cast("int")
    return {"size": clip(n), "wide": clip(F.floor((n - F.char_length(text)) * 65536 / chars)), "lines": clip(F.floor(lines * 4096 / chars))}


def _by_node(values: dict[int, object], default: object) -> Column:
    out = F.lit(default)
    for n, v in values.items():
        out = F.when(F.col("node") == n, F.lit(v)).otherwise(out)
    return out


def _measured(rows: DataFrame) -> dict[int, tuple[str, int, int, int]]:
    """Of each node: its widest dimension (as a part of the range over all rows; ties to the first), its ends there, and its bytes."""
    ends = rows.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max))).collect()
    whole = {d: max(max(r[f"max_{d}"] for r in ends) - min(r[f"min_{d}"] for r in ends), 1) for d in DIMS} if ends else {}
    out = {}
    for r in ends:
        d = max(DIMS, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d])
        out[r.node] = (d, r[f"min_{d}"], r[f"max_{d}"], r.bytes)
    return out


def _cuts(rows: DataFrame, nodes: dict[int, tuple[str, int, int, int]], parts: dict[int, tuple[int, int]], tolerance: float) -> dict[int, tuple[int, int]]:
    """Of each node its cut (key, second): rows below it go left. The bytes left are within `tolerance` leaves of the share, or
    the cut lies between two keys."""
    cuts, open_, second = {}, {}, {}
    for n, (_, low, high, total) in nodes.items():
        if n in parts:
            left, right = parts[n]
            open_[n] = (low << 32, (high + 1) << 32, total * left / (left + right), total * tolerance / (left + right))
    while open_:
        shift = {n: max(0, (high - low - 1).bit_length() - BINS) for n, (low, high, _, _) in open_.items()}
        value = F.when(F.col("node").isin(list(second)), F.col("id_hash")).otherwise(F.col("key")) if second else F.col("key")
        lows, highs = _by_node({n: x[0] for n, x in open_.items()}, 0), _by_node({n: x[1] for n, x in open_.items()}, 0)
        near = rows.where(F.col("node").isin(list(open_))).withColumn("value", value).where((F.col("value") >= lows) & (F.col("value") < highs))
        for n, key in second.items():
            near = near.where((F.col("node") != n) | (F.col("key") == key))
        bins = near.withColumn("bin", _shifted(F.col("value") - lows, shift)).groupBy("node", "bin")
        sums: dict[int, dict[int, int]] = {}
        for r in bins.agg(F.sum("bytes").alias("b")).collect():  # nodes * 2**BINS rows at most
            sums.setdefault(r.node, {})[r.bin] = r.b
        for n, (low, high, want, slack) in list(open_.items()):
            run = 0
            for b, x in sorted(sums.get(n, {}).items()):
                if run + x > want:
                    break
                run += x
            else:
                b, x = ((high - low - 1) >> shift[n]) + 1, 0
            here, past = low + (b << shift[n]), min(high, low + ((b + 1) << shift[n]))
            done = x == 0 or min(want - run, run + x - want) <= slack
            if done or shift[n] == 0 and n in second:
                cut = here if x == 0 or want - run <= run + x - want else past
                cuts[n] = (second[n], cut) if n in second else (cut, 0)
                open_.pop(n), second.pop(n, None)
            elif shift[n] == 0:  # one key holds the cut: on with the ids' hashes
                second[n] = here
                open_[n] = (0, 1 << 32, want - run, slack)
            else:
                open_[n] = (here, past, want - run, slack)
    return cuts


def _shifted(value: Column, shift: dict[int, int]) -> Column:
    out = value
    for k in sorted(set(shift.values()) - {0}):
        out = F.when(F.col("node").isin([n for n, x in shift.items() if x == k]), F.shiftright(value, k)).otherwise(out)
    return out


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of every row.

    size is the text's UTF-8 bytes plus 8. Shards are the tree's leaves from left to right and hold near equal bytes: each cut is within
    `tolerance` of a leaf's bytes, or between two rows. Equal texts are one group that only a cut inside it divides. A null text has no
    bytes and the empty text's crc32; a null id is an id like another; repeated rows can't be told apart, so they can't be
    divided either. Slots count a shard's rows from 0: a row's place in the part of the table it was read in, after the
    parts before it, so no shard is ever one task. Fewer rows than shards leave some shards empty.
    """
    scratch = Scratch(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(whole) + 8).cast("long").alias("bytes"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_column)), 32).alias("id_hash"),
        *(c.alias(d) for d, c in metadata(whole).items()),
        F.monotonically_increasing_id().alias("row"),
        F.lit(0).alias("node"),
    )
    rows = scratch.keep(rows, "rows")  # row numbers are made once: a lost task doesn't change them
    leaves, first = {0: shards}, {0: 0}  # leaves of a node, and the first of them
    while any(n > 1 for n in leaves.values()):
        below, nodes = rows, _measured(rows)
        at = F.lit(0)
        for d in DIMS:
            if own := [n for n, x in nodes.items() if x[0] == d]:
                at = F.when(F.col("node").isin(own), F.col(d)).otherwise(at)
        rows = rows.withColumn("key", F.shiftleft(at.cast("long"), 32) + F.col("text_crc32"))
        parts = {n: (k // 2, k - k // 2) for n, k in leaves.items() if k > 1}
        cuts = _cuts(rows, nodes, parts, tolerance)
        key, second = _by_node({n: c[0] for n, c in cuts.items()}, (1 << 63) - 1), _by_node({n: c[1] for n, c in cuts.items()}, 0)
        right = (F.col("key") > key) | (F.col("key") == key) & (F.col("id_hash") >= second)
        rows = scratch.keep(rows.withColumn("node", F.col("node") * 2 + right.cast("int")).drop("key"), "rows")
        scratch.drop(below)
        grown, start = {}, {}
        for n, k in leaves.items():
            left = parts[n][0] if n in parts else k
            grown[2 * n], start[2 * n] = left, first[n]
            if n in parts:
                grown[2 * n + 1], start[2 * n + 1] = parts[n][1], first[n] + left
        leaves, first = grown, start
    number = F.lit(None).cast("int")
    for n, k in first.items():
        number = F.when(F.col("node") == n, k).otherwise(number)
    placed = scratch.keep(rows.select("doc_id", "bytes", "text_crc32", "row", F.shiftright("row", 33).alias("part"), number.alias("shard")), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    numbered = placed.withColumn("own", own).join(before, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return numbered.select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("own") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
