"""A corpus made ready for training: toxic documents go, then repeated lines, then near-duplicates; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of ``documents``. Null and empty texts pass every stage and are packed as an end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import toxicity
from topicloom.llm.line_dedup import drop_repeated_lines
from topicloom.llm.minhash import drop_near_duplicates
from topicloom.llm.packing import pack_documents
from topicloom.llm.scratch import Scratch

SEQUENCE_LENGTH = 2048
SIMILARITY_PERCENT = 80


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones of the training folds, doesn't take for toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; ``n_chars`` follows the text."""
    left = drop_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs, SIMILARITY_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, and the places in sequences that they are packed to."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_LENGTH)


STAGES = [("toxicity", keep_civil), ("line_dedup", drop_lines), ("minhash", keep_one_of_each), ("packing", pack)]

#: Learned weights and a packing can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
