"""The queries of the corpus operators, one for each, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, oracles, toxicity
from .ann import nearest
from .bpe import round_trip_digests
from .html_text import extract_text
from .line_dedup import deduplicated
from .minhash import near_duplicates
from .packing import pack_documents
from .scratch import Scratch
from .sharding import shard_documents
from .token_files import read_token_files, write_token_files


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into token files and returns what reading the files gives."""
    path = Scratch(spark, "op1").path("files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_token_files(spark, path, ids=False)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every row for the rows whose vec_id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from all documents the lines that an earlier line repeats."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, linked from a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents by speculative BPE, decodes the ids, and returns digests of both."""
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors, linked from a cosine of 0.95."""
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts all documents into 8 shards of nearly equal bytes, equal texts together."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with a classifier of the training folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("toxicity_score")
    return toxicity.score(docs, model).select("doc_id", (~toxicity.in_training_folds(F.col("doc_id"))).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_ann": op2_ann,
        "op3_line_dedup": op3_line_dedup,
        "op4_packing": op4_packing,
        "op5_minhash": op5_minhash,
        "op6_html": op6_html,
        "op7_bpe": op7_bpe,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_sharding": op9_sharding,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
