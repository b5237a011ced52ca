"""Operators on clustered keyphrases: labels, tree, coverage, mixes, and what is shown of them.

``assigned`` is (vocab_idx, text, weight, doc_freq, l1, l2): a vocabulary with its clusters of both levels. ``links`` is
(id, text, score, pos), one row for each id and text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.functions.text import escape_html, phrase_tokens

LABEL_TERMS, TOP_KEYWORDS, PAGE, DRILL = 6, 10, 5, 60


def token_weights(assigned: DataFrame, level: str) -> DataFrame:
    """(cluster, token, w): occurrences of tokens in a cluster's keyphrases, each times the keyphrase's documents."""
    found = assigned.select(F.col(level).alias("cluster"), "doc_freq", F.explode(phrase_tokens(F.col("text"))).alias("token"))
    return found.groupBy("cluster", "token").agg(F.sum("doc_freq").alias("w"))


def class_tfidf(weights: DataFrame, clusters: DataFrame, k: int = LABEL_TERMS) -> DataFrame:
    """(cluster, rank, token, score): the k greatest w * ln(1 + A / f), f being a token's weight in all clusters, A the
    mean weight of a cluster (of those in clusters (cluster), with tokens or without)."""
    f = weights.groupBy("token").agg(F.sum("w").alias("f"))
    a = weights.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("all")).crossJoin(clusters.agg(F.greatest(F.count_distinct("cluster"), F.lit(1)).alias("n"))).select(F.when(F.col("all") > 0, F.col("all") / F.col("n")).otherwise(1.0).alias("a"))
    scored = weights.join(f, "token").crossJoin(F.broadcast(a)).withColumn("score", F.round(F.col("w") * F.log(1 + F.col("a") / F.col("f")), 6))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "token"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("cluster", "rank", "token", "score")


def terms(assigned: DataFrame, level: str) -> DataFrame:
    """(cluster, terms, label): a cluster's terms, and the first three of them as its label."""
    top = class_tfidf(token_weights(assigned, level), assigned.select(F.col(level).alias("cluster")))
    each = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("terms"))
    return each.withColumn("label", F.array_join(F.slice("terms", 1, 3), " "))


def nodes(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics (l1, topic_id, score) and subtopics (l1, l2, topic_id, sub_id, score), numbered by score, then by their
    first keyphrase."""
    tops = assigned.groupBy("l1").agg(F.round(F.sum("weight"), 6).alias("score"), F.min("vocab_idx").alias("first"))
    tops = tops.withColumn("topic_id", F.concat(F.lit("t"), F.row_number().over(Window.orderBy(F.desc("score"), "first")))).select("l1", "topic_id", "score")
    subs = assigned.groupBy("l1", "l2").agg(F.round(F.sum("weight"), 6).alias("score"), F.min("vocab_idx").alias("first"))
    j = F.row_number().over(Window.partitionBy("l1").orderBy(F.desc("score"), "first"))
    subs = subs.withColumn("j", j).join(tops.select("l1", "topic_id"), "l1")
    return tops, subs.select("l1", "l2", "topic_id", F.concat("topic_id", F.lit("."), "j").alias("sub_id"), "score")


def node_links(links: DataFrame, assigned: DataFrame, records: DataFrame) -> DataFrame:
    """Links of clustered keyphrases with their clusters, and their document's place (ord) and funder_code (unknown: ?)."""
    found = links.join(assigned.select("text", "vocab_idx", "l1", "l2"), "text")
    return found.join(records.select("id", "ord", "funder_code"), "id", "left").withColumn("funder_code", F.coalesce("funder_code", F.lit("?")))


def funder_mix(found: DataFrame, level: str) -> DataFrame:
    """(cluster, rank, funder_code, share): shares of the links, the greatest first; ties go by the first link, in the
    order of keyphrases, then of records."""
    n = found.groupBy(F.col(level).alias("cluster"), "funder_code").agg(F.count("*").alias("n"), F.min(F.struct("vocab_idx", "ord")).alias("first"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cluster")), 3)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))
    return n.select("cluster", rank.alias("rank"), "funder_code", share.alias("share"))


def coverage(found: DataFrame) -> DataFrame:
    """(l1, l2, doc_count): distinct documents of each topic (l2 null) and each subtopic."""
    return found.groupingSets([["l1"], ["l1", "l2"]], "l1", "l2").agg(F.count_distinct("id").alias("doc_count")).select("l1", "l2", "doc_count")


def covered_docs(found: DataFrame) -> DataFrame:
    """(l1, l2, id): the documents of each subtopic, a row each."""
    return found.select("l1", "l2", "id").distinct()


def dominant_funder(found: DataFrame) -> DataFrame:
    """(text, funder_code) that most of a keyphrase's documents have; ties go to that of the smallest id."""
    each = found.select("text", "id", "funder_code").distinct().groupBy("text", "funder_code").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return each.groupBy("text").agg(F.min_by("funder_code", F.struct(-F.col("n"), "first")).alias("funder_code"))


def meta(records: DataFrame, assigned: DataFrame, min_df: int) -> DataFrame:
    docs = records.agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_set("funder_code")).alias("funders"))
    tree = assigned.agg(F.count("*").alias("n_keywords"), F.count_distinct("l1").alias("n_topics"), F.count_distinct("l2").alias("n_subtopics"))
    return docs.crossJoin(tree).withColumn("min_df", F.lit(min_df))


def ranked_leaves(assigned: DataFrame) -> DataFrame:
    """assigned with topic_id, sub_id, sub_n (the subtopic's number), rounded (weight) and leaf_rank, a keyphrase's place in
    its subtopic."""
    _, subs = nodes(assigned)
    leaf = assigned.withColumn("rounded", F.round("weight", 3)).join(subs.select("l1", "l2", "topic_id", "sub_id"), ["l1", "l2"])
    leaf = leaf.withColumn("sub_n", F.substring_index("sub_id", ".", -1).cast("int"))
    order = [F.desc("doc_freq"), F.desc("rounded"), F.col("vocab_idx")]
    return leaf.withColumn("leaf_rank", F.row_number().over(Window.partitionBy("sub_id").orderBy(*order)))


def label_payload(assigned: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """(node, level, keywords): what a labelling model is shown of each topic and subtopic."""
    leaf = ranked_leaves(assigned)
    top = leaf.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("rounded"), "sub_n", "leaf_rank")))
    rows = top.where(F.col("rank") <= k).select(F.col("topic_id").alias("node"), F.lit("topic").alias("level"), "rank", "text")
    rows = rows.union(leaf.where(F.col("leaf_rank") <= k).select("sub_id", F.lit("subtopic"), "leaf_rank", "text"))
    return rows.groupBy("node", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("keywords"))


def merged_labels(node_terms: DataFrame, labels: DataFrame) -> DataFrame:
    """node_terms (node, label) with llm_label of labels (node, llm_label); where there is none, the label."""
    return node_terms.join(labels, "node", "left").withColumn("labelled", F.col("llm_label").isNotNull()).withColumn("llm_label", F.coalesce("llm_label", "label"))


def docs_index(records: DataFrame, abstracts: DataFrame, found: DataFrame) -> DataFrame:
    """Records that links refer to, with their abstract or an empty one."""
    used = records.join(found.select("id").distinct(), "id", "left_semi")
    return used.drop("abstract").join(abstracts, "id", "left").withColumn("abstract", F.coalesce("abstract", F.lit("")))


def unlabelled(node_terms: DataFrame, labels: DataFrame) -> int:
    """How many nodes have no label."""
    return node_terms.join(labels, "node", "left_anti").count()


# --- exploration ---


def _dated(records: DataFrame) -> DataFrame:
    return records.where("year IS NOT NULL AND year <> 0").select("id", "year")


def year_counts(links: DataFrame, records: DataFrame, excluded: list[int]) -> DataFrame:
    """(text, year, n): documents of each keyphrase of links in each year that it has some in, but excluded ones; null and
    zero years count nowhere."""
    dated = _dated(records)
    dated = dated.where(~F.col("year").isin(excluded)) if excluded else dated
    return links.select("text", "id").join(dated, "id").groupBy("text", "year").agg(F.count("*").alias("n"))


def year_histogram(links: DataFrame, records: DataFrame, excluded: list[int]) -> DataFrame:
    """(text, year, n): ``year_counts`` with zeros, in each year from the first to the last of all records."""
    spine = _dated(records).agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    spine = spine.where(~F.col("year").isin(excluded)) if excluded else spine
    every = links.select("text").distinct().crossJoin(F.broadcast(spine))  # a row for each keyphrase and year is the result
    n = year_counts(links, records, excluded)
    return every.join(n, ["text", "year"], "left").select("text", "year", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_pages(assigned: DataFrame, page: int = PAGE) -> DataFrame:
    """(topic_id, text, doc_freq, place, page, pages): keyphrases of each topic, most documents first, then in the order of
    subtopics and of their keyphrases. A text that stands in several subtopics counts once, where its documents are most."""
    order = [F.desc("doc_freq"), F.col("sub_n"), F.col("leaf_rank")]
    leaf = ranked_leaves(assigned).withColumn("own", F.row_number().over(Window.partitionBy("topic_id", "text").orderBy(*order))).where("own = 1")
    leaf = leaf.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(*order)))
    pages = F.ceil(F.count("*").over(Window.partitionBy("topic_id")) / page).cast("int")
    return leaf.select("topic_id", "text", "doc_freq", "place", F.ceil(F.col("place") / page).cast("int").alias("page"), pages.alias("pages"))


def page_of(paged: DataFrame, number: int, page: int = PAGE) -> DataFrame:
    """The rows of ``keyword_pages`` on that page of each topic, or on its first or last one if there is no such; pager says
    which of how many they are, and is null where a topic has one page alone."""
    total = F.count("*").over(Window.partitionBy("topic_id"))
    rows = paged.withColumn("total", total).where(F.col("page") == F.greatest(F.lit(1), F.least(F.col("pages"), F.lit(number))))
    last = F.least(F.col("page") * page, F.col("total"))
    return rows.withColumn("pager", F.when(F.col("pages") > 1, F.format_string("%d–%d of %d", (F.col("page") - 1) * page + 1, last, "total"))).drop("total")


def drill_down(links: DataFrame, records: DataFrame, n: int = DRILL) -> DataFrame:
    """(text, rank, id, year, title): the newest n documents of each keyphrase of links; those without a year last."""
    docs = links.select("text", "id").join(records.select("id", "year", "title"), "id")
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.coalesce("year", F.lit(0)).desc(), "id"))
    return docs.withColumn("rank", rank).where(F.col("rank") <= n).select("text", "rank", "id", "year", "title")


def highlighted(abstracts, words: list[str], selected: str):
    """Escaped text with the words marked, the selected one apart; longer words are tried first."""
    text = escape_html(abstracts)
    pattern = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    text = F.regexp_replace(text, rf"(?i)\b({pattern})\b", "<mark>$1</mark>") if words else text
    return F.regexp_replace(text, rf"(?i)<mark>({re.escape(selected)})</mark>", '<mark class="selected">$1</mark>')



def grid(boxes: DataFrame, ratio: float, gap: float = 40.0) -> DataFrame:
    """Offsets of boxes (i, w, h), i from 0, in a grid of about that ratio: columns as wide, rows as high as their
    largest box, each set off from those before it."""
    n = boxes.agg(F.count("*").alias("n")).select(F.greatest(F.lit(1), F.round(F.sqrt(F.col("n") * ratio)).cast("int")).alias("cols"))
    at = boxes.crossJoin(F.broadcast(n)).withColumn("col", (F.col("i") % F.col("cols")).cast("int")).withColumn("row", F.floor(F.col("i") / F.col("cols")).cast("int"))
    out = at
    for name, size, offset in (("col", "w", "x"), ("row", "h", "y")):
        before = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        each = at.groupBy(name).agg((F.max(size) + gap).alias("s")).select(name, F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias(offset))
        out = out.join(each, name)
    return out.select("i", "col", "row", "x", "y")
