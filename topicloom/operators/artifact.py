"""The tree of topics, subtopics and keyphrases as one nested table, and as the document that is published."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.operators import topics
from topicloom.sources.files import put_text


def _ordered(df: DataFrame, by: str, place: str, fields: list, name: str) -> DataFrame:
    """(by, name): structs of fields in the order of place."""
    each = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("_place"), F.struct(*fields).alias("_it")))).alias("_all"))
    return each.select(by, F.transform("_all", lambda x: x["_it"]).alias(name))


def _mix(found: DataFrame, level: str) -> DataFrame:
    """(cluster, funder_mix): funder codes with their shares, the greatest first."""
    return _ordered(topics.funder_mix(found, level), "cluster", "rank", ["funder_code", "share"], "funder_mix")


def tree(links: DataFrame, assigned: DataFrame, records: DataFrame, labels: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """A row for each topic: (n, id, label, llm_label, terms, score, funder_mix, seed, doc_count, subtopics).

    Subtopics are structs (id, label, llm_label, terms, score, funder_mix, doc_count, docs, keywords), keywords structs
    (text, weight, doc_freq, docs, funder), each in the order of their numbers. labels (node, llm_label) and seeds (l1, x,
    y) may be absent or lack nodes: llm_label then is the label, the seed null. The arrays make this the form of a
    document; ``topics.covered_docs`` and ``corpus.leaves`` hold the same as rows.
    """
    found = topics.node_links(links, assigned, records)
    tops, subs = topics.nodes(assigned)
    leaf = topics.ranked_leaves(assigned)
    docs = found.groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("docs"))
    leaf = leaf.join(docs, "text").join(topics.dominant_funder(found).withColumnRenamed("funder_code", "funder"), "text")
    keywords = _ordered(leaf, "sub_id", "leaf_rank", ["text", F.col("rounded").alias("weight"), "doc_freq", "docs", "funder"], "keywords")
    spark = links.sparkSession
    labels = labels if labels is not None else spark.createDataFrame([], "node string, llm_label string")
    seeds = seeds if seeds is not None else tops.select("l1", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def named(nodes: DataFrame, level: str, node: str) -> DataFrame:
        of = nodes.join(topics.terms(assigned, level).withColumnRenamed("cluster", level), level, "left").join(_mix(found, level).withColumnRenamed("cluster", level), level)
        of = of.join(labels.select(F.col("node").alias(node), "llm_label"), node, "left")
        of = of.withColumn("label", F.coalesce("label", F.lit(""))).withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
        return of.withColumn("llm_label", F.coalesce("llm_label", "label")).withColumn("score", F.round("score", 3))

    covered = found.groupBy("l2").agg(F.array_sort(F.collect_set("id")).alias("docs"))
    subs = named(subs, "l2", "sub_id").join(covered, "l2").join(keywords, "sub_id")
    subs = subs.withColumn("n", F.substring_index("sub_id", ".", -1).cast("int")).withColumn("doc_count", F.size("docs").cast("long"))
    below = _ordered(subs, "l1", "n", [F.col("sub_id").alias("id"), "label", "llm_label", "terms", "score", "funder_mix", "doc_count", "docs", "keywords"], "subtopics")
    count = topics.coverage(found).where("l2 IS NULL").select("l1", "doc_count")
    whole = named(tops, "l1", "topic_id").join(count, "l1").join(below, "l1").join(seeds.select("l1", F.when(F.col("x").isNotNull(), F.array("x", "y")).alias("seed")), "l1", "left")
    return whole.select(F.substring("topic_id", 2, 9).cast("int").alias("n"), F.col("topic_id").alias("id"), "label", "llm_label", "terms", "score", "funder_mix", "seed", "doc_count", "subtopics")


def digests(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, digest): how many distinct values each key has, and the MD5 of them in their order, joined by commas. Both
    are strings. Values pass by sorted, so no task holds those of a key."""

    def run(batches):
        last = seen = md5 = None
        n = 0
        for batch in batches:
            done = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if md5 is None or k != last:
                    if md5 is not None:
                        done.append((last, n, md5.hexdigest()))
                    last, n, md5 = k, 0, hashlib.md5(usedforsecurity=False)
                elif v == seen:
                    continue
                md5.update(f"{',' if n else ''}{v}".encode())
                seen, n = v, n + 1
            yield rows(done)
        if md5 is not None:
            yield rows([(last, n, md5.hexdigest())])

    def rows(done):
        k, n, digest = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=[key, "n", "digest"])

    return df.select(key, value).repartition(key).sortWithinPartitions(key, value).mapInArrow(run, f"{key} string, n long, digest string")


def _named(nodes: DataFrame, assigned: DataFrame, found: DataFrame, level: str) -> DataFrame:
    """nodes with label (of terms; empty without any), funder_mix and doc_count of their level: a row each."""
    count = found.select(level, "id").distinct().groupBy(level).agg(F.count("*").alias("doc_count"))
    of = nodes.join(topics.terms(assigned, level).select(F.col("cluster").alias(level), "label"), level, "left")
    of = of.join(_mix(found, level).withColumnRenamed("cluster", level), level).join(count, level)
    return of.withColumn("label", F.coalesce("label", F.lit("")))


def topic_rows(links: DataFrame, assigned: DataFrame, records: DataFrame) -> DataFrame:
    """(l1, n, id, label, llm_label, score, funder_mix, doc_count): a row for each topic, as ``tree`` has them, without
    what is below."""
    of = _named(topics.nodes(assigned)[0], assigned, topics.node_links(links, assigned, records), "l1")
    return of.select("l1", F.substring("topic_id", 2, 9).cast("int").alias("n"), F.col("topic_id").alias("id"), "label", F.col("label").alias("llm_label"), F.round("score", 3).alias("score"), "funder_mix", "doc_count")


def subtopic_rows(links: DataFrame, assigned: DataFrame, records: DataFrame) -> DataFrame:
    """(l1, l2, sub_n, id, label, llm_label, score, funder_mix, doc_count): a row for each subtopic."""
    of = _named(topics.nodes(assigned)[1], assigned, topics.node_links(links, assigned, records), "l2")
    return of.select("l1", "l2", F.substring_index("sub_id", ".", -1).cast("int").alias("sub_n"), F.col("sub_id").alias("id"), "label", F.col("label").alias("llm_label"), F.round("score", 3).alias("score"), "funder_mix", "doc_count")


def tree_rows(links: DataFrame, assigned: DataFrame, records: DataFrame) -> DataFrame:
    """``tree`` as a row for each keyphrase, with its topic and subtopic; documents are told by ``digests``. No row grows
    with the documents."""
    found = topics.node_links(links, assigned, records)
    top = topic_rows(links, assigned, records).select(F.col("id").alias("topic_id"), F.col("label").alias("topic_label"), F.col("score").alias("topic_score"), F.col("doc_count").alias("topic_docs"), F.col("funder_mix").alias("topic_mix"))
    sub = subtopic_rows(links, assigned, records).join(digests(found, "l2", "id").select("l2", F.col("digest").alias("sub_digest")), "l2")
    sub = sub.select(F.col("id").alias("sub_id"), F.col("label").alias("sub_label"), F.col("score").alias("sub_score"), F.col("doc_count").alias("sub_docs"), "sub_digest", F.col("funder_mix").alias("sub_mix"))
    leaf = topics.ranked_leaves(assigned).select("topic_id", "sub_id", F.col("leaf_rank").alias("place"), "text", F.col("rounded").alias("weight"), "doc_freq")
    leaf = leaf.join(digests(found, "text", "id").select("text", "digest"), "text").join(topics.dominant_funder(found).withColumnRenamed("funder_code", "funder"), "text")
    return leaf.join(F.broadcast(top), "topic_id").join(F.broadcast(sub), "sub_id")


def best_covered(tree_: DataFrame, k: int = 6) -> DataFrame:
    """(doc_count, llm_label) of the k topics (of ``tree`` or ``topic_rows``) with the most documents; ties in the order of
    topics."""
    return tree_.orderBy(F.desc("doc_count"), "n").limit(k).select("doc_count", "llm_label")


def review(tops: DataFrame, subs: DataFrame, leaf: DataFrame, k: int = 8, funders: int = 3) -> DataFrame:
    """A row for each subtopic (of ``topic_rows``, ``subtopic_rows`` and ``topics.ranked_leaves``), as a person reviews them: (place, topic, label, doc_count, n_subtopics, funders, sub_n,
    subtopic, sub_label, sub_doc_count, keywords). Topics go by their documents; funders are the greatest with their
    percentage; keywords are the first k."""
    below = subs.groupBy("l1").agg(F.count("*").alias("n_subtopics"))
    shown = F.array_join(F.transform(F.slice("funder_mix", 1, funders), lambda m: F.concat(m["funder_code"], F.lit(" "), F.round(m["share"] * 100).cast("int").cast("string"), F.lit("%"))), ", ")
    place = F.row_number().over(Window.orderBy(F.desc("doc_count"), "n"))  # a row a topic
    top = tops.join(below, "l1").select("l1", place.alias("place"), F.col("llm_label").alias("topic"), "label", "doc_count", "n_subtopics", shown.alias("funders"))
    first = leaf.where(F.col("leaf_rank") <= k).groupBy(F.col("sub_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("leaf_rank", "text"))).alias("all"))
    words = first.select("id", F.array_join(F.transform("all", lambda x: x["text"]), ", ").alias("keywords"))
    sub = subs.select("l1", "id", "sub_n", F.col("llm_label").alias("subtopic"), F.col("label").alias("sub_label"), F.col("doc_count").alias("sub_doc_count"))
    return sub.join(F.broadcast(top), "l1").join(words, "id").select("place", "topic", "label", "doc_count", "n_subtopics", "funders", "sub_n", "subtopic", "sub_label", "sub_doc_count", "keywords")


def write_artifact(path: str, meta: DataFrame, tree_: DataFrame, index: DataFrame, limit: int = 200_000) -> dict:
    """Writes {meta, topics, docs} as one JSON document, and returns it. It passes through the driver, so more than
    ``limit`` documents in the index are refused; the tables themselves have no such bound."""
    spark = tree_.sparkSession
    if index.limit(limit + 1).count() > limit:
        raise ValueError(f"over {limit} documents: publish the tables, not one document")

    def plain(df: DataFrame) -> list[dict]:
        return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]

    def node(x: dict) -> dict:
        x["funder_mix"] = {m["funder_code"]: m["share"] for m in x["funder_mix"]}
        return x

    whole = []
    for topic in sorted(plain(tree_), key=lambda x: x["n"]):
        topic["subtopics"] = [node(s) for s in topic["subtopics"]]
        whole.append(node({k: v for k, v in topic.items() if k != "n"}))
    docs = {d["id"]: {k: v for k, v in d.items() if k != "id"} for d in plain(index.select("id", "title", "funder", "funder_code", "year", "abstract"))}
    found = {"meta": plain(meta)[0], "topics": whole, "docs": docs}
    put_text(spark, path, json.dumps(found, ensure_ascii=False, indent=2))
    return found
