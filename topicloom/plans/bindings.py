"""The engine's inputs as views of the driver's tables: records of ``documents``, results of ``labels``, clusters by the
first letters of a keyphrase."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import clean_long, clean_ws
from topicloom.operators import corpus, topics
from topicloom.sources.staging import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, by: str) -> DataFrame:
    """df over all cores where it is read by fewer tasks than there are: a table in one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if df.rdd.getNumPartitions() < cores else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``documents``, with their raw text and its ``chars``: what needs no cleaned abstract makes none."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    year = (F.lit(1995) + F.col("doc_id") % 32).cast("int")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), clean_ws(F.substring("text", 1, 80)).alias("title"), clean_long(F.col("text")).alias("abstract"), F.col("source").alias("funder"), F.upper("source").alias("funder_code"), year.alias("year"), "text", corpus.least_chars("text").alias("chars"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a classifier as labels give them; some failed, some with bad JSON or without a type."""
    i = F.col("doc_id")
    kind = F.when(F.col("quality") == 1, "research").otherwise("other")
    payload = F.when(i % 7 == 3, F.lit('{"primary_type": ')).when(i % 7 == 5, F.lit('{"rationale":"none"}')).otherwise(F.concat(F.lit('{"primary_type":"'), kind, F.lit('","rationale":"label"}')))
    return table(spark, sf_dir, "labels").select(i.cast("string").alias("id"), (i % 11 != 4).alias("ok"), payload.alias("payload"))


class Run:
    """The tables of one run over a folder, each computed once: what is used again is written to the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.scratch = spark, sf_dir, Scratch(spark, "run")
        self.all = records(spark, sf_dir)

    @cached_property
    def heads(self) -> DataFrame:
        """The records without their texts: what is asked of texts' beginnings is read from them once."""
        return self.scratch.stage(self.all.drop("abstract", "text"), "heads")

    @cached_property
    def later(self) -> DataFrame:
        return self.scratch.stage(corpus.repeated_titles(self.heads), "later")

    @property
    def judged(self) -> DataFrame:
        """The records without their texts, with their reason."""
        return corpus.with_reason(self.heads, later=self.later)

    @property
    def kept(self) -> DataFrame:
        return self._kept.drop("text", "chars")

    @property
    def _kept(self) -> DataFrame:
        return corpus.with_reason(self.all, later=self.later).where("reason = 'kept'").drop("reason")

    @cached_property
    def chunks(self) -> DataFrame:
        """Counted tokens: texts are cut into tokens for this table alone. White space is in no token, so the raw texts have
        the same."""
        return self.scratch.stage(corpus.token_chunks(self._kept, "text"), "chunks", rows=2)

    @cached_property
    def meta(self) -> DataFrame:
        """The kept records without their abstracts."""
        return self.scratch.stage(self.judged.where("reason = 'kept'").drop("reason", "chars"), "meta")

    @cached_property
    def n(self) -> int:
        return self.meta.count()

    @cached_property
    def df(self) -> DataFrame:
        return self.scratch.stage(corpus.chunks_df(self.chunks), "df")

    @cached_property
    def stop(self) -> DataFrame:
        return self.scratch.stage(corpus.stoplist(self.df, self.n), "stop")

    @cached_property
    def raw(self) -> DataFrame:
        return self.scratch.stage(corpus.statistical_keyphrases(self.chunks, self.df, self.stop, self.n), "raw")

    @cached_property
    def links(self) -> DataFrame:
        return self.scratch.stage(corpus.normal_keyphrases(self.raw), "links")

    @cached_property
    def vocab(self) -> DataFrame:
        return self.scratch.stage(corpus.vocabulary(self.links), "vocab")

    @property
    def linked(self) -> DataFrame:
        """The links of the vocabulary's texts, one for each id and text."""
        return self.links.join(self.vocab.select("text"), "text", "left_semi")

    @property
    def assigned(self) -> DataFrame:
        """The vocabulary in clusters by its first letters."""
        return self.vocab.withColumn("l1", F.substring("text", 1, 1)).withColumn("l2", F.substring("text", 1, 2))

    @property
    def found(self) -> DataFrame:
        return topics.node_links(self.links, self.assigned, self.meta)
