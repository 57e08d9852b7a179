"""Tolerant readers: what can't be read is set apart, never raised row by row and never silently counted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"
DETECTION = T.StructType(
    [
        T.StructField("frame_index", T.LongType()), T.StructField("time_sec", T.DoubleType()), T.StructField("bbox_xyxy", T.ArrayType(T.DoubleType())),
        T.StructField("frame_width", T.IntegerType()), T.StructField("frame_height", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("class_name", T.StringType()), T.StructField("track_id", T.StringType()), T.StructField("raw_track_id", T.StringType()),
    ]
)
FRAME = T.StructType([T.StructField("frame_index", T.LongType()), T.StructField("time_sec", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("detections", T.ArrayType(DETECTION))])
SIDECAR = T.StructType(
    [
        T.StructField("source_video", T.StringType()), T.StructField("status", T.StringType()), T.StructField("frame_width", T.IntegerType()), T.StructField("frame_height", T.IntegerType()),
        T.StructField("detections", T.ArrayType(DETECTION)), T.StructField("frames", T.ArrayType(FRAME)),
    ]
)


def json_objects(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema with their file, and the others' files and text. Files hold one object each, or one a line."""
    whole = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    texts = spark.read.option("recursiveFileLookup", True).option("wholetext", not lines).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = texts.select("file", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"), "value")
    good = F.col("r").isNotNull() & F.col(f"r.{BAD}").isNull()
    return rows.where(good).select(*(f"r.{c}" for c in schema.names), "file"), rows.where(~good).select("file", F.col("value").alias("text"))


def detections(sidecars: DataFrame) -> DataFrame:
    """One row for each detection of either layout (flat, or by frame), frame sizes and times from the envelope or frame where its own are missing."""
    flat = sidecars.select("source_video", "frame_width", "frame_height", F.explode("detections").alias("d"))
    flat = flat.select("source_video", *(F.coalesce(F.col(f"d.{c}"), F.col(c)).alias(c) if c in ("frame_width", "frame_height") else F.col(f"d.{c}").alias(c) for c in DETECTION.names))
    framed = sidecars.select("source_video", F.explode("frames").alias("f")).select("source_video", "f", F.explode("f.detections").alias("d"))
    instead = {"frame_index": "f.frame_index", "time_sec": "f.time_sec", "frame_width": "f.width", "frame_height": "f.height"}
    framed = framed.select("source_video", *(F.coalesce(F.col(f"d.{c}"), F.col(instead[c])).alias(c) if c in instead else F.col(f"d.{c}").alias(c) for c in DETECTION.names))
    return flat.unionByName(framed)


def normalised_detections(rows: DataFrame, least_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Detections of enough confidence, and rejects with a reason: no class, no track, no box or a box of no size."""
    box = F.col("bbox_xyxy")
    at = lambda k: F.get(box, F.lit(k))
    bad = F.when(F.col("class_name").isNull(), "missing_class").when(F.col("track_id").isNull(), "missing_track")
    bad = bad.when(F.coalesce(F.size(box), F.lit(0)) != 4, "missing_box").when((at(2) <= at(0)) | (at(3) <= at(1)), "invalid_box").when(F.col("time_sec").isNull() | (F.col("time_sec") < 0), "invalid_time")
    marked = rows.where(F.coalesce("confidence", F.lit(1.0)) >= least_confidence).withColumn("reason", bad)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def columnar_detections(rows: DataFrame) -> DataFrame:
    """Parallel arrays (boxes, confidences, classes, tracks) of one row for each frame, as one row for each detection; time = frame / fps."""
    zipped = rows.select("source_video", "frame_index", "fps", F.posexplode(F.arrays_zip("boxes", "confidences", "classes", "tracks")).alias("place", "z"))
    return zipped.select("source_video", "frame_index", (F.col("frame_index") / F.col("fps")).alias("time_sec"), "place", F.col("z.boxes").alias("bbox_xyxy"), F.col("z.confidences").alias("confidence"), F.col("z.classes").alias("class_name"), F.col("z.tracks").alias("track_id"))


def log_lines(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """file, line and one column for each pattern's first group, null where it isn't in the line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    found = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return lines.select("file", "line", *(found(p).alias(k) for k, p in patterns.items()))


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".mp4", ".mov", ".m4v")) -> DataFrame:
    """key, size and time of the files below a path with one of the suffixes; contents aren't read. Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    low, wanted = F.lower("key"), F.lit(False)
    for s in suffixes:
        wanted = wanted | F.endswith(low, F.lit(s))
    return files.where(wanted)


def file_digests(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """key and SHA-256 of files of any size, read in chunks of `chunk` bytes by the task that has the file, so that no content is ever one value. Empty files aren't listed."""
    files = listing(spark, path, ("",)).select("key")

    def digests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            out = []
            for key in part["key"]:
                store, inner = pafs.FileSystem.from_uri(key.replace("file:/", "file:///", 1) if re.match("file:/[^/]", key) else key)
                total = hashlib.sha256()
                with store.open_input_stream(inner) as f:
                    while data := f.read(chunk):
                        total.update(data)
                out.append(total.hexdigest())
            yield part.assign(sha256=out)

    return files.mapInPandas(digests, "key string, sha256 string")


def unprocessed(files: DataFrame, done: DataFrame, recovered: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Listed files that aren't done, and those to be done again."""
    fresh = files.join(done.select(key).distinct(), key, "left_anti")
    return fresh if recovered is None else fresh.unionByName(files.join(recovered.select(key).distinct(), key, "left_semi")).dropDuplicates([key])


def preferred_sidecars(files: DataFrame, video: str = "video", priority: str = "priority") -> DataFrame:
    """Of the candidate files of a video the one of the least priority, then name."""
    best = files.groupBy(video).agg(F.min(F.struct(priority, "path")).alias("b"))
    return best.select(video, F.col(f"b.{priority}").alias(priority), F.col("b.path").alias("path"))
