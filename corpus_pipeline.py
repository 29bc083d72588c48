"""A training-corpus pipeline of five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the rows are written as Parquet and read again, so a stage's work isn't repeated and survives lost
executors.

Awkward rows have the operators' results: a null or empty text fails the quality rules; a row without a doc_id is nobody's
copy and is kept by near_dedup_stage; repeated rows are copies of each other, and rows that share a doc_id but not the text
are documents of their own; in the mix, rows that share doc_id and source, or have none, share their copies evenly.  Empty tables give empty tables.  Further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import mixing, near_dup, pii, quality, sentencepiece
from lodestack.llm.queries import piece_model
from lodestack.shared import settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ratios = quality.log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality(docs, ratios).filter("__quality.kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row, of the least doc_id, stays."""
    return near_dup.without_near_duplicates(docs, shingle_words=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in texts are replaced; n_chars follows."""
    found = pii.find_personal_data(docs, pii.term_table(docs)).withColumn("text", F.when(F.col("text").isNotNull(), F.col("__pii.clean")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the sources' words come near their targets."""
    return mixing.taken(docs, mixing.mix(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return sentencepiece.encode(docs, piece_model())


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("pii_sanitisation", pii_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = settled(docs, name)
    return docs
