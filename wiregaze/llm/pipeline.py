"""Corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
documents, whatever their names; the last returns the packed pieces. Every result is written as Parquet and read again.

Defined results of the stages: null and empty texts score like any other text of no words; a document of which line
dedup leaves only blanks goes, one that was blank before stays; blank documents are copies of each other; of rows alike
in doc_id and text one stays, rows that share a doc_id alone are documents of their own; rows without doc_id come last
among copies; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontam, lines, packing, quality, simhash
from .common import saved, table

#: Documents below this score go; clean ones score far above it.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labels, drop documents scored under LEAST_QUALITY."""
    return quality.at_least(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; documents of which only blanks are left go, others keep their place."""
    found = lines.dedup_rows(docs).where((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(lines.SPACE)) != ""))
    same = F.col("n_dropped") == 0
    new = {"text": F.when(same, F.col("row.text")).otherwise(F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by doc_id of each group of similar documents (five words, 0.8) stays, once."""
    keep = saved(simhash.similar_groups(docs).where("row = first").select("row").distinct(), "keep")
    left = docs.select(simhash.row_key().alias("key"), F.struct(*docs.columns).alias("doc")).join(keep.withColumnRenamed("row", "key"), "key", "left_semi")
    one = Window.partitionBy("key").orderBy(F.xxhash64("doc"))  # rows alike in doc_id and text
    left = left.withColumn("copy", F.row_number().over(one)).where("copy = 1")
    return left.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    keyed = docs.select(simhash.row_key().alias("key"), F.col("text"), F.struct(*docs.columns).alias("doc"))
    found = decontam.leaks(keyed.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaked = saved(found.select(F.col("doc_id").alias("key")).distinct(), "leaked")
    return keyed.join(leaked, "key", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
