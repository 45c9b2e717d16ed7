"""A corpus pipeline: quality rules, exact and near copies, source mixing, packing into sequences.

Each stage takes what the one before it kept, as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm import exact_dedup, mixing, near_copies, packing, quality_rules
from colsight.llm.shared import stored

ORACLE_SQL = None  # SQL has neither the shingle hashes nor the tokenizer; tests use brute force


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule. A null or empty text has too few words and goes; repeated rows are judged alike; an empty table stays empty."""
    judged = quality_rules.judge(docs.select(F.struct("*").alias("row"), "text"))
    return judged.where("kept").select("row.*")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, null ids last and one row of repeated ones; null texts equal empty ones; an empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets have a cosine of 0.8 or more.

    Texts without words stay; of repeated rows and ties the first stays, null ids last; an empty table stays empty.
    """
    return near_copies.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Null sources are one source; ties and repeated rows are taken in one fixed order; null texts have no words; an empty table stays empty."""
    size = mixing.word_count(F.col("text"))
    return mixing.mixed_documents(docs, size, mixing.symbol_quality(F.col("text"), size))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. A null text is empty, one piece of one id; repeated rows are packed apart; an empty table gives no rows."""
    packed = packing.pack_documents(docs, ["doc_id"])
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", rules),
    ("exact_dedup", copies),
    ("near_dedup", near),
    ("mixing", mixture),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
