"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents; null or empty texts, repeated rows
and empty tables pass through every stage as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm import toxicity as tox
from epispark.llm.common import MADE, only_newest, table, written
from epispark.llm.decontamination import leaks
from epispark.llm.packing import packed
from epispark.llm.secrets import redacted, with_secrets
from epispark.llm.simhash import near_duplicates

ORACLE_SQL = None  # kernels, fingerprints and tokenizers have no SQL form; tests compare with brute force


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents judged toxic. Rows travel as one struct, so own columns such as score keep their values."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    return tox.toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group. Of rows that repeat this id one stays: that of the
    smallest text hash, then the smallest in the order of its columns. Rows without id stay."""
    groups = near_duplicates(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.count(F.lit(1)).alias("rows"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = rows.join(written(groups), (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("least")))
    again = kept.where("rows > 1").groupBy("id").agg(F.min("row").alias("row"))
    one = kept.where("rows = 1").select("row.*").unionByName(again.select("row.*"))
    return one.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, with all rows of their id."""
    found = written(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; n_chars follows the new text."""
    rows = with_secrets(docs.select("doc_id", "text", F.struct("*").alias("row")), out="spans")
    size = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    clean = rows.withColumn("clean", redacted(F.col("text"), F.col("spans"))).withColumn("size", size)
    return clean.select(*[{"text": F.col("clean"), "n_chars": F.col("size")}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids."""
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("secrets", secret_removal),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again by the next. Once that is done, the tables
    of the stage before and those in between are removed, so one copy of the kept documents is left on disk."""
    before = MADE.set([])
    try:
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir))
            only_newest(spark)
    finally:
        MADE.reset(before)
    return STAGES[-1][1](spark, docs, sf_dir)
