"""The corpus pipeline: documents are classified, deduplicated, decontaminated, mixed and written as token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Every stage keeps null and empty texts unless it says otherwise, takes texts of any length whole, returns no row for an empty table, and keeps
extra columns, also under names that operators use inside.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql.llm import common, decontaminate, jaccard, mixing, quality, sstable


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; without labels nothing. Repeated rows share their fate."""
    return quality.resample(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies, that of the smallest doc_id; rows without doc_id or words stay."""
    return jaccard.keep_one(docs, width=5, share=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or a template of one. An empty benchmark drops nothing."""
    return decontaminate.remove(docs, common.read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows until sources have their targets; rows and files are in the order of training."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row from the token shards, and the row's place in training (from 0).

    Shards are in the order of doc_id. The place is that of the row in the Parquet files which ``docs`` was read from, and null for other frames.
    """
    try:
        placed = mixing.training_order(docs, common.add_unique(docs, "place"))
    except AnalysisException:
        placed = docs.withColumn(common.add_unique(docs, "place"), F.lit(None).cast("long"))
    read = sstable.encode_and_read(placed, place=placed.columns[-1])
    return read.withColumnRenamed(placed.columns[-1], "place")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID output", token_ids),
]

#: Several stages can't be said in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
