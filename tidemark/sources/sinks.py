"""Writes: replacing, appending and merging tables. A table that is replaced has a file that names its present version; versions are written
beside it and the file is replaced by one rename, so that readers see the old table or the new one, whatever fails when."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.states import upsert


CURRENT = "_current.json"


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null where there is none."""
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, said: str) -> None:
    """Replaces a small file by a rename over it, which the file system does at once or not at all."""
    staged = f"{path}.{uuid.uuid4().hex}"
    where, fs = _files(spark, staged)
    stream = fs.create(where)
    try:
        stream.write(bytearray(said.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(over, 1)
    options[0] = over.OVERWRITE
    target = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(where), target, options)


def replace_table(df: DataFrame, path: str, kind: str = "parquet", keep: int = 2) -> None:
    """The rows as the table's next version. Until all of it is written readers get the last one; a write that fails leaves that as it is.
    Of the versions that were current the last `keep` stay, for readers that have begun."""
    spark = df.sparkSession
    said = json.loads(read_small(spark, f"{path}/{CURRENT}") or "[]")
    version = uuid.uuid4().hex
    df.write.format(kind).save(f"{path}/{version}")
    replace_small(spark, f"{path}/{CURRENT}", json.dumps([version, *said][:keep]))
    for old in said[keep - 1 :]:
        where, fs = _files(spark, f"{path}/{old}")
        fs.delete(where, True)


def current_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The present version of a table written by `replace_table`."""
    said = json.loads(read_small(spark, f"{path}/{CURRENT}") or "[]")
    if not said:
        raise ValueError(f"no table at {path}")
    return spark.read.format(kind).load(f"{path}/{said[0]}")


class KeptByKey:
    """A table kept in buckets of a key, each with a version of its own. A change reads and writes the buckets of its keys alone; which version of each bucket
    holds is one small file, replaced at once."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[str, str]:
        return json.loads(read_small(self.spark, f"{self.path}/{CURRENT}") or "{}")

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets; files of other buckets aren't opened."""
        wanted = None if only is None else {str(b) for b in only}
        folders = [f"{self.path}/{v}/bucket={b}" for b, v in self.versions().items() if wanted is None or b in wanted]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets of the changes' keys: at most as many as the table has."""
        return sorted(r.b for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def put(self, rows: DataFrame, buckets: list[int]) -> None:
        """Some buckets' rows in place of what they hold; a bucket without rows becomes empty."""
        version = uuid.uuid4().hex
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        where, fs = _files(self.spark, f"{self.path}/{version}")
        held = {s.getPath().getName().split("=")[1] for s in fs.listStatus(where) if "=" in s.getPath().getName()}
        now = {b: v for b, v in self.versions().items() if int(b) not in buckets} | {b: version for b in held}
        replace_small(self.spark, f"{self.path}/{CURRENT}", json.dumps(now))


def replace_json(df: DataFrame, path: str) -> None:
    replace_table(df, path, "json")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def merge_table(spark: SparkSession, path: str, changes: DataFrame, key: list[str], order: list[Column], version: int) -> str:
    """Writes the table of the last version with the changes merged in as the next version's folder, and gives its path. Readers of the last version aren't disturbed."""
    current = spark.read.parquet(f"{path}/v{version}") if version else changes.limit(0)
    out = f"{path}/v{version + 1}"
    upsert(current, changes.select(*current.columns, *[c for c in changes.columns if c not in current.columns]), key, order).write.parquet(out)
    return out


def insert_missing(current: DataFrame, seed: DataFrame, key: list[str]) -> DataFrame:
    """The current rows and the seed's of new keys."""
    return current.unionByName(seed.dropDuplicates(key).join(current.select(*key), key, "left_anti").select(*current.columns))


def moved_keys(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Keys below one prefix, below another instead."""
    return df.withColumn(key, F.when(F.startswith(F.col(key), F.lit(old)), F.concat(F.lit(new), F.substring(F.col(key), F.lit(len(old) + 1), F.length(key)))).otherwise(F.col(key)))


def retry_queue(queue: DataFrame, outcomes: DataFrame, key: str = "key", most: int = 5) -> DataFrame:
    """Failed tries count; those done or out of tries leave."""
    out = queue.join(outcomes.select(F.col(key).alias("_k"), "ok"), F.col(key) == F.col("_k"), "left")
    tries = F.col("attempts") + F.when(F.col("ok") == F.lit(False), 1).otherwise(0)
    return out.withColumn("attempts", tries).where(~F.coalesce("ok", F.lit(False)) & (F.col("attempts") < most)).drop("_k", "ok")
