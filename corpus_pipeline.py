"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept. All but the last return the columns of documents.
Rows of null, empty or very long texts, repeated rows and further columns go through each stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, decontaminate, neardup, pieces, toxicity
from tidemark.llm.common import Scratch, crc_mod, id_marks, table, told_apart


BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of BATCH_ROWS rows at most, as `tidemark.session` sets them: executors keep what the largest batches of any stage took."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on four fifths of the labelled rows) scores below 0.5; rows without an id stay if no such row is rejected."""
    _small_batches(spark)
    model = toxicity.fit(docs.where(crc_mod("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return toxicity.kept(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group. Rows without an id stay, rows that repeat an id are judged by their own text, and of
    rows that repeat id and text one stays."""
    _small_batches(spark)
    scratch, own = Scratch(spark), Scratch(spark)
    judged = neardup.near_duplicates(docs, scratch=scratch, hashed=True).where("doc_id is not null")
    fate = judged.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    fate = own.keep(fate.where("not _kept or _n > 1").select("_id", "_hash", "_kept"), "fate")
    scratch.clear()
    maybe, others = told_apart(docs, F.col("doc_id").cast("long"), *id_marks(fate, "_id", own))  # texts of documents that surely stay are not shuffled
    maybe = maybe.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    stay = maybe.join(fate, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left").where("_kept is null or _kept")
    return stay.dropDuplicates(["_own", "_text"]).select("_row.*").union(others)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut."""
    _small_batches(spark)
    return chunks.deduplicated(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly such passages go."""
    _small_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip. Remembers less than the query alone does, since executors have the other stages' memory too."""
    _small_batches(spark)
    return pieces.encode(docs, most_bytes=16 << 20, most_pairs=1 << 16)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeats),
    ("benchmark_leaks", without_leaks),
    ("tokens", tokens),
]

#: SQL can't express the learned, hashed and merged stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again, so that a lost executor costs one stage at most."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
