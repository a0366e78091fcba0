"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of documents; what a stage rejects is gone for the stages after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import clean
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.minhash_dedup import keep_one
from lodestone.llm.pieces import encode_documents
from lodestone.llm.quality import keep_good
from lodestone.llm.queries import MODEL_PATH
from lodestone.llm.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds neither poor nor toxic."""
    return keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines, n_chars following the text; a document that loses its last line goes."""
    less = dedup_lines(spark, docs)
    lost = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    kept = less.where(~lost).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near copies (shingles of five words, 0.8)."""
    return keep_one(spark, docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, lossless) of every document that is left."""
    return encode_documents(spark, docs, MODEL_PATH)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL expresses neither the fitted classifier nor the seeded segmentation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        scratch.release()  # the driver and the disks need not hold the plans and shuffles of a stage that is done
    return STAGES[-1][1](spark, docs, sf_dir)
