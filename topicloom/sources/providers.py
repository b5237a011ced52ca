"""Steps that a model answers: prompts, jobs that can be resumed, and what stands in for a model offline.

A provider answers prompts (id, prompt) with (id, ok, payload), payload being JSON. Answers are a table; the operators
read nothing else of a model. A job writes its answers to a folder as it goes, and, run again, asks only for what is
not answered yet.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.words import KINDS
from topicloom.sources import files

ANSWER = "id string, ok boolean, payload string"
Provider = Callable[[list[str], list[str]], list[tuple[bool, str]]]


def classify_prompt(chars: int = 1500) -> Column:
    ask = "Which one of these is the record's main purpose: " + ", ".join(KINDS) + '? Answer with JSON {"primary_type": ..., "rationale": at most 12 words}.'
    return F.concat(F.lit(ask + "\nTITLE: "), "title", F.lit("\nABSTRACT: "), F.substring("abstract", 1, chars))


def extract_prompt(chars: int = 2500) -> Column:
    ask = 'Name 3 to 12 specific keyphrases of the record, in lower case, the most central first, with a salience from 1 (mentioned) to 5 (core). Answer with JSON {"keywords": [{"text": ..., "salience": ...}]}.'
    return F.concat(F.lit(ask + "\nTITLE: "), "title", F.lit("\nABSTRACT: "), F.substring("abstract", 1, chars))


def label_prompt() -> Column:
    """Of ``topics.label_payload`` with terms: one prompt for each node."""
    ask = 'Name this group of keyphrases in 2 to 5 words. Answer with JSON {"label": ...}.'
    return F.concat(F.lit(ask + "\nLEVEL: "), "level", F.lit("\nKEYPHRASES: "), F.array_join("keywords", ", "))


def answered(prompts: DataFrame, provider: Provider) -> DataFrame:
    """(id, ok, payload) of each prompt (id, prompt). A provider that raises fails its batch's prompts, not the job."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            try:
                found = provider(ids, texts)
            except Exception as e:  # what a remote service may do is unknown
                found = [(False, f"{type(e).__name__}: {e}")] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([ok for ok, _ in found], pa.bool_()), pa.array([p for _, p in found], pa.string())], names=["id", "ok", "payload"])

    return prompts.select(F.col("id").cast("string"), "prompt").mapInArrow(run, ANSWER)


def job(prompts: DataFrame, provider: Provider, path: str, chunks: int = 16) -> DataFrame:
    """Answers of all prompts, in the folder ``path``: those that are there already are not asked for again, unless they
    failed. Prompts are asked in ``chunks`` that are committed one by one, so a run that ends early leaves what it had;
    ``forget`` ends the job."""
    spark = prompts.sparkSession
    if files.exists(spark, path):
        prompts = prompts.join(spark.read.schema(ANSWER).parquet(path).where("ok").select("id"), "id", "left_anti")
    for k in range(chunks):
        answered(prompts.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == k), provider).write.mode("append").parquet(path)
    found = spark.read.schema(ANSWER).parquet(path)
    return found.groupBy("id").agg(F.max(F.struct("ok", "payload")).alias("a")).select("id", "a.ok", "a.payload")


def forget(spark, path: str) -> None:
    files.remove(spark, path)


def replay(results: dict[str, str]) -> Provider:
    """Answers that are known beforehand; others fail."""
    return lambda ids, prompts: [(i in results, results.get(i, "")) for i in ids]
