"""What the operators of this subpackage share: tables, scratch tables in the shared folder, bounded samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own checkpoint folder. Without either a cluster's
    session gets a ValueError, since no other folder is known to be seen by all; a local one, which is one process, a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor. `drop` frees the ones no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_root(spark)}/{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Frees all tables of this scratch; nothing may read them afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def id_marks(ids: DataFrame, column: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """A bitmap of the ids' hashes as rows (bucket, bits) of 4096 bytes, and its size in bits: 16 bits for each id, 2**30 bits
    (128 MB) at most; beyond that it grows no further, only tells less."""
    bits = 1 << min(30, max(15, (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(bits)) + 1
    marks = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    return scratch.keep(marks, "marks"), bits


def told_apart(rows: DataFrame, key: Column, marks: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the marked ids (all that are, and a few more), and the others, null keys among them: so that a
    later join need not shuffle the others. The bitmap is broadcast (its bound: see id_marks), rows never leave the JVM."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    packed = rows.select(F.struct("*").alias("_row"), F.bitmap_bucket_number(slot).alias("_own"), F.bitmap_bit_position(slot).alias("_place"), key.isNotNull().alias("_known"))
    both = packed.join(F.broadcast(marks), F.col("_own") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.col("_known") & F.coalesce(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))
    return both.where(hit).select("_row.*"), both.where(~hit).select("_row.*")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or it with underscores behind where the table has such a column."""
    while name in df.columns:
        name += "_"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, mod n; a null id counts as remainder -1, so that it is in no named fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def bounded(rows: DataFrame, by: str, each: int, id_column: str, seed: int = 7, most_rows: int = 8192, most_classes: int = 4096) -> DataFrame:
    """About `each` rows of every class in `by` (all, where there are fewer, and one at least), fewer of each where all classes together would give more than
    `most_rows`; picked by a hash of the id, twice as many and one more of each in all at the very most. Of more than `most_classes` classes the commonest are taken
    (equal counts: in order of value), a bound on the sample.

    One grouped count, then a filter on the scan: nothing is shuffled by class, so a class with most of the rows does no harm.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(1 << 30))
    named = rows.where(F.col(by).isNotNull())
    counts = named.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("first")).orderBy(F.desc("n"), by).limit(most_classes).collect()
    each = min(each, max(1, most_rows // max(1, len(counts))))
    if not counts:
        return named
    shares = {r[by]: max(int((1 << 30) * min(1.0, each / r["n"])), r["first"] + 1) for r in counts}
    listed = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    return named.where(draw < F.coalesce(F.try_element_at(listed, F.col(by)), F.lit(0))).limit((2 * each + 1) * len(counts))


def per_text(docs: DataFrame, fields: str, fn: Callable[[list], list], text: str = "text", id_column: str = "doc_id", rows: int = 1024, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and `fields` of every row: `fn` gets the texts (and the `more` columns' values) of some rows and returns one list
    or Arrow array for each field. At most `rows` rows are held as Python objects at once; ids keep their type, nulls too."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), *T.StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(part.column(k).to_pylist() for k in range(1, part.num_columns)))
                cols = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type), *cols], schema=arrow)

    return docs.select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(more))).mapInArrow(run, schema)
