"""The engine's queries against SQL, and its operators on the edge cases of their inputs."""

import hashlib
import json
import os
import shutil
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators import artifact, corpus, phrases, topics, vectors
from topicloom.plans import bindings, registry
from topicloom.sources import files, providers, publishing
from topicloom.sources import records as R

TABLES = ("documents", "labels", "pages", "embeddings")


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, small, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = registry.queries()[name](spark, small)
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(float(x) if type(x).__name__ == "Decimal" else x for x in row) for row in result.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == expected


def values(spark, column, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c string")
    return [r[1] for r in df.select("k", column(F.col("c"))).orderBy("k").collect()]


def test_scalar_functions(spark):
    assert values(spark, T.parse_year, ["1949", "1950", "2100", "2101", "FY20", "", None, "²", "99999999999999"]) == [None, 1950, 2100, None, None, None, None, None, None]
    assert values(spark, T.clean_ws, [" a\xa0 b\x1c\n", None, ""]) == ["a b", "", ""]
    assert values(spark, T.clean_phrase, ["extra - cellular", " - a  b -", "x"]) == ["extra-cellular", "a b", "x"]
    assert values(spark, T.is_phrase, ["a", "12", "a1", "éé"]) == [False, False, True, True]
    assert values(spark, T.escape_html, ["a<b>&c"]) == ["a&lt;b&gt;&amp;c"]
    assert values(spark, T.routed, ["a b", "1 2 3 4 5 6 7 8 9"]) == ["query: a b", "passage: 1 2 3 4 5 6 7 8 9"]


def test_structural_noise(spark):
    rows = ["1234567  Doe, Jane We study x.", "Doe, Jane We study x.", "a andlt br andgt b <br/> c br/ d Br e", "One. It reflects NSF's statutory mission here. Two.", "p &lt; 0.05 and q &gt; 3", None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    found = [tuple(r)[1:] for r in T.strip_structural(df, "t").orderBy("k").collect()]
    assert found[:5] == [("We study x.", True, False), ("Doe, Jane We study x.", False, False), ("a b c d Br e", False, False), ("One. Two.", False, True), ("p 3", False, False)]


def test_long_sentences_cost_their_length(spark):
    mark = "It reflects NSF's statutory mission"
    rows = ["x y " * 100_000 + f"here. {mark} now", f"a {mark} b. " + "c d " * 100_000, f"{mark}.{mark}. a. b {mark}"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    began = time.time()
    found = [r.t for r in T.strip_structural(df, "t").orderBy("k").collect()]
    assert found == ["x y " * 100_000 + "here.", ("c d " * 100_000).strip(), "a."] and time.time() - began < 30


LONG = "long enough text " * 8


def test_first_wins(spark):
    rows = [("a", 0, "T", ""), ("b", 1, "t", LONG), ("c", 2, "T", LONG), ("d", 3, "", LONG), ("e", 4, "", LONG), ("f", 5, "u", "x" * 99), ("g", 6, "u", "x" * 100), ("h", 7, "T", "")]
    found = {r.id: r.reason for r in corpus.with_reason(spark.createDataFrame(rows, "id string, ord long, title string, abstract string")).collect()}
    assert found == {"a": "no_abstract", "b": "kept", "c": "duplicate", "d": "kept", "e": "kept", "f": "short", "g": "kept", "h": "duplicate"}


def test_verdicts(spark):
    records = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    results = spark.createDataFrame([("a", True, '{"primary_type": "training", "rationale": "r"}'), ("b", True, "{bad"), ("c", True, '{"rationale": "r"}'), ("d", False, "")], "id string, ok boolean, payload string")
    verdicts = corpus.parse_verdicts(results)
    assert sorted(r.id for r in corpus.research_kept(records, verdicts).collect()) == ["b", "d", "e"]
    assert sorted((r.id, r.excluded_type) for r in corpus.research_excluded(records, verdicts).collect()) == [("a", "training"), ("c", "other")]


def test_small_corpus_stops_all_words(spark):
    docs = spark.createDataFrame([("1", "alpha data"), ("2", "beta"), ("3", "gamma")], "id string, abstract string")
    stop = {r.token for r in corpus.stoplist(corpus.token_df(docs), 3).collect()}
    assert {"alpha", "beta", "gamma", "research"} <= stop and "data" not in stop


def test_csv_and_adapters(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes('﻿grant_id,grantname,title_from_abstract,agencyname,agencycode,abstract,startdateyear\n1,,"T ""q"" u",X - SubAward,ab,"line one\nline two",1999\n\n2,N\n'.encode())
    found = R.records(R.read_csv(spark, f"file://{path}")).orderBy("ord").collect()
    assert [(r.id, r.title, r.abstract, r.funder, r.funder_code, r.year) for r in found] == [("1", 'T "q" u', "line one line two", "X", "AB", 1999), ("2", "N", "", "", "", None)]
    with pytest.raises(ValueError):
        R.adapt(spark.createDataFrame([("1",)], "x string"))
    with pytest.raises(FileNotFoundError):
        R.read_csv(spark, f"file://{tmp_path}/none.csv")


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([("1", None), ("2", 5)], "id string, year int")
    R.write_jsonl(df, f"{root}/j")
    assert sorted(map(tuple, R.read_jsonl(spark, f"{root}/j", "id string, year int").collect())) == [("1", None), ("2", 5)]
    assert R.read_optional(spark, f"{root}/none", "id string").count() == 0
    R.write_split(df, F.col("year") > 3, f"{root}/a", f"{root}/b")
    assert R.read_jsonl(spark, f"{root}/a", "id string").count() == R.read_jsonl(spark, f"{root}/b", "id string").count() == 1
    R.write_word_list(spark.createDataFrame([("b",), ("a",)], "w string"), f"{root}/w", ["list"])
    assert sorted(r.word for r in R.read_word_list(spark, f"{root}/w").collect()) == ["a", "b"]
    files.put_json(spark, f"{root}/d/x/topics.json", {"é": [1]})
    assert files.get_json(spark, f"{root}/d/x/topics.json") == {"é": [1]} and publishing.datasets(spark, f"{root}/d") == ["x"]
    assert "&lt;b&gt;" in publishing.landing_page("t", [{"slug": "s", "label": "<b>", "description": None, "n_docs": 1000, "n_topics": 2}])
    page = publishing.dataset_page('D="x";\n  const ENTRY={};\n', {"id": "a"}, 'D="x";', 'D=".";')
    assert page == 'D=".";\n  const ENTRY={"id": "a"};\n'
    for template in ("", 'D="x";', "const ENTRY={};", 'D="x";\nconst ENTRY={};\nconst ENTRY={};'):
        with pytest.raises(ValueError):
            publishing.dataset_page(template, {"id": "a"}, 'D="x";', 'D=".";')


def test_from_csv_to_pages(spark, tmp_path):
    root = f"file://{tmp_path}"
    words = ["graph theory", "protein folding", "solar cells", "deep learning", "coral reefs", "plasma physics"]
    rows = ["grant_id,grantname,agencyname,agencycode,abstract,startdateyear"]
    rows += [f'R01-{k},Title {k},Agency - SubAward,ag{k % 2},"{LONG} {words[k % 6]} and {words[(k + 1) % 6]}, of {words[(k * 5) % 6]}.",{2000 + k % 5}' for k in range(36)]
    (tmp_path / "raw.csv").write_text("\n".join(rows))
    records = corpus.kept_records(R.records(R.read_csv(spark, f"{root}/raw.csv")))
    def extract(ids, prompts):
        assert all("TITLE: Title" in p for p in prompts)
        return [(i != "R01-7", json.dumps({"keywords": [{"text": w.upper(), "salience": 4} for w in words if w in p]})) for i, p in zip(ids, prompts)]

    prompts = records.select("id", providers.extract_prompt().alias("prompt"))
    answers = providers.job(prompts, extract, f"{root}/answers", chunks=3)
    assert answers.where("ok").count() == 35
    answers = providers.job(prompts, providers.replay({"R01-7": "{bad"}), f"{root}/answers", chunks=2)  # asks for the failed one alone
    assert answers.where("ok").count() == 36 and spark.read.parquet(f"{root}/answers").count() == 37
    links = corpus.normal_keyphrases(corpus.parse_extractions(answers))
    assert corpus.keyworded(records, links).where("size(keywords) = 0").count() == 1
    vocab = corpus.vocabulary(links)
    clusters = vectors.ward_clusters(vocab, 2, 4)
    assigned = vocab.join(clusters.select("vocab_idx", "l1", "l2"), "vocab_idx")
    tops, _ = topics.nodes(assigned)
    labels = tops.where("topic_id = 't1'").select(F.col("topic_id").alias("node"), F.lit("First").alias("llm_label"))
    centroids = vectors.centroids(vectors.embedded(assigned), "l1")
    whole = artifact.tree(links, assigned, records, labels, vectors.seeds(centroids, "l1"))
    index = topics.docs_index(records, records.select("id", "abstract"), topics.node_links(links, assigned, records))
    found = artifact.write_artifact(f"{root}/data/set-one/topics.json", topics.meta(records, assigned, 3), whole, index)
    assert [t["id"] for t in found["topics"]] == ["t1", "t2"] and found["topics"][0]["llm_label"] == "First" and found["topics"][1]["llm_label"] == found["topics"][1]["label"]
    assert found["meta"]["n_subtopics"] == sum(len(t["subtopics"]) for t in found["topics"]) == 4 and found["meta"]["funders"] == ["AG0", "AG1"]
    for t in found["topics"]:
        assert t["doc_count"] == len({i for s in t["subtopics"] for i in s["docs"]}) and len(t["seed"]) == 2
        for s in t["subtopics"]:
            assert set(s["docs"]) == {i for k in s["keywords"] for i in k["docs"]} and s["docs"] == sorted(s["docs"])
            assert abs(sum(s["funder_mix"].values()) - 1) < 0.01 and set(s["docs"]) <= set(found["docs"])
    assert {k["text"] for t in found["topics"] for s in t["subtopics"] for k in s["keywords"]} == set(words)
    with pytest.raises(ValueError):
        artifact.write_artifact(f"{root}/x.json", topics.meta(records, assigned, 3), whole, index, limit=3)
    entries = publishing.write_manifest(spark, f"{root}/data", {"set-one": {"description": "d"}})
    assert [(e["id"], e["label"], e["slug"], e["n_docs"], e["description"], e["excluded_years"]) for e in entries] == [("set-one", "Set One", "set-one", 36, "d", [])]
    template = 'const DATA_DIR="data";\nconst ENTRY={};\n'
    pages = publishing.publish(spark, f"{root}/data", template, f"{root}/site", "All", 'const DATA_DIR="data";', 'const DATA_DIR=".";', ("old.html",))
    assert pages == ["index.html", "set-one.html"] and files.get_json(spark, f"{root}/site/datasets/set-one.json") == found
    assert '"file": "datasets/set-one.json"' in (tmp_path / "site/set-one.html").read_text()
    with pytest.raises(FileNotFoundError):
        publishing.publish(spark, f"{root}/none", template, f"{root}/site", "All", "", "")


def test_extractions(spark):
    payloads = ['{"keywords": [{"text": "A b", "salience": 5}, {"text": "c"}, {"text": "dd"}, {"text": "ee", "salience": "x"}]}', '{"keywords": [', '{"other": 1}', "[]", None]
    results = spark.createDataFrame([(str(k), True, p) for k, p in enumerate(payloads)] + [("f", False, payloads[0])], "id string, ok boolean, payload string")
    found = corpus.parse_extractions(results)
    assert sorted((r.id, r.pos, r.text, r.salience) for r in found.collect()) == [("0", 0, "A b", 5), ("0", 1, "c", None), ("0", 2, "dd", None), ("0", 3, "ee", None)]
    whole = corpus.keyworded(spark.createDataFrame([(str(k), "x") for k in range(5)], "id string, abstract string"), corpus.normal_keyphrases(found)).collect()
    assert {r.id: [tuple(k) for k in r.keywords] for r in whole} == {"0": [("a b", 1.0), ("dd", 0.6), ("ee", 0.6)], "1": [], "2": [], "3": [], "4": []}


def test_marginal_relevance(spark):
    assert phrases.candidates("Deep learning of graph neural networks, and the deep learning.", frozenset(["of", "and", "the"])) == ["deep learning", "graph neural networks"]
    assert phrases.candidates("one two three four five", frozenset(), 3) == ["one two three", "two three four", "three four five"]
    own, each = np.array([1.0, 0.0]), np.array([[0.8, 0.6], [0.9, 0.43589], [0.91, 0.41461], [0.7, -0.71414]])
    assert phrases.marginal(own, each, 3) == [2, 3, 1] and phrases.marginal(own, each[:0]) == []
    found = phrases.marginal_keyphrases(spark.createDataFrame([("a", "Solar cells and plasma physics."), ("b", None), ("c", "the")], "id string, abstract string"), ["and", "the"]).collect()
    assert {(r.id, r.text) for r in found} == {("a", "solar cells"), ("a", "plasma physics")} and sorted(r.pos for r in found) == [1, 2]
    stop = phrases.english_stoplist(spark.createDataFrame([("the",), ("grant",)], "token string"))
    assert stop.where("word = 'the'").count() == 1 and {"grant", "is"} <= {r.word for r in stop.collect()}


def test_mix_counts_links_and_ties_go_to_the_first(spark):
    rows = [("k", 0, "R01-AG1", 5, "A"), ("k", 1, "R01-AG1", 5, "A"), ("k", 0, "2", 9, "B"), ("m", 2, "10", 1, "D"), ("m", 2, "9", 2, "C"), ("m", 1, "x y", 7, "E")]
    found = spark.createDataFrame(rows, "l1 string, vocab_idx long, id string, ord long, funder_code string")
    mix = {(r.cluster, r["rank"]): (r.funder_code, r.share) for r in topics.funder_mix(found, "l1").collect()}
    assert mix == {("k", 1): ("A", 0.667), ("k", 2): ("B", 0.333), ("m", 1): ("E", 0.333), ("m", 2): ("D", 0.333), ("m", 3): ("C", 0.333)}


def test_pages_go_by_documents_then_subtopics_then_leaves(spark):
    rows = [(0, "b1", 2.0, 4, "b", "b1"), (1, "a1", 9.0, 4, "b", "a1"), (2, "a2", 1.0, 4, "b", "a1"), (3, "z", 1.0, 7, "b", "b1"), (4, "c1", 0.5, 4, "b", "b1"), (5, "c2", 0.5, 4, "b", "b1"), (6, "q", 1.0, 3, "q", "q")]
    assigned = spark.createDataFrame(rows, "vocab_idx long, text string, weight double, doc_freq long, l1 string, l2 string")
    paged = topics.keyword_pages(assigned)
    assert [r.text for r in paged.where("topic_id = 't1'").orderBy("place").collect()] == ["z", "a1", "a2", "b1", "c1", "c2"]
    assert {(r.topic_id, r.pager) for r in topics.page_of(paged, 9).collect()} == {("t1", "6–6 of 6"), ("t2", None)}
    assert {(r.topic_id, r.pager) for r in topics.page_of(paged, -1).collect()} == {("t1", "1–5 of 6"), ("t2", None)}


def test_one_tokenisation_and_no_text_in_the_join_of_titles(spark, small):
    run = bindings.Run(spark, small)
    assert run.links.count() > 0 and run.found.count() > 0
    plan = run.found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents.parquet" not in plan
    join = corpus.repeated_titles(run.all)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = join[: next(k for k, line in enumerate(join) if "Join" in line) + 1]
    assert not any("abstract" in line or "title" in line for line in above)


def test_tokens_are_counted_where_they_are_read(spark, small):
    df = spark.createDataFrame([("a", "Deep deep K\u212ann x-y-z ab deep"), ("b", None), ("c", "İon")], "id string, abstract string")
    counts = corpus.token_counts(df)
    assert {(r.id, r.token): r.tf for r in counts.collect()} == {("a", "deep"): 3, ("a", "kknn"): 1, ("a", "x-y-z"): 1}
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    plan = bindings.Run(spark, small)._kept.select("id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS abstract" not in plan


def test_keyphrases_come_from_chunks_of_documents(spark, small, monkeypatch):
    texts = {"a": "beta alpha beta -gamma-- --", "b": "alpha K\u212ann", "c": None, "d": "delta " * 9 + "Beta", "e": "-- ab a-", "f": "zeta eta theta iota kappa alpha"}
    docs = spark.createDataFrame(list(texts.items()), "id string, abstract string").coalesce(1)
    counts = {(r.id, r.token): r.tf for r in corpus.token_counts(docs).collect()}
    df = {r.token: r.df for r in corpus.token_df(docs).collect()}
    stop = spark.createDataFrame([("delta",)], "token string")
    parts = corpus._parts
    for size in (corpus.CHUNK, 40):
        monkeypatch.setattr(corpus, "_parts", lambda batch, size=size, parts=parts: parts(batch, size))
        chunks = bindings.Scratch(spark, "test").stage(corpus.token_chunks(docs), "chunks")
        assert {r.token: r.df for r in corpus.chunks_df(chunks).collect()} == df
        raw = corpus.statistical_keyphrases(chunks, corpus.chunks_df(chunks), stop, len(texts), 3)
        plan = raw._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Join Inner") == plan.count("strategy=merge") == 2
        expected = set()
        for i in texts:
            weighed = sorted((-round(n * np.log(1 + len(texts) / df[t]), 9), t) for (j, t), n in counts.items() if j == i and t != "delta")
            expected |= {(i, k + 1, t, 5 - k * 5 // 3) for k, (_, t) in enumerate(weighed[:3])}
        assert {tuple(r) for r in raw.select("id", "pos", "text", "salience").collect()} == expected
    monkeypatch.undo()
    run = bindings.Run(spark, small)
    assert 0 < run.chunks.count() < run.meta.count() / 10


def test_tokens_meet_their_frequencies_in_buckets(spark, small):
    seen = {}
    for tokens in ([], ["abc"], sorted({f"w{chr(97 + k % 26)}{'x' * (k % 40)}-{chr(97 + k // 26 % 26)}" for k in range(900)}), ["abc", "zzz"]):
        array = pa.array(tokens, pa.string())
        bucket, lengths, letters, values = corpus._dealt(array, np.arange(len(tokens), dtype="<i4"), 7)
        found = []
        for k, b in enumerate(bucket.to_pylist()):
            part, place = corpus._tokens(*(corpus._numbers(c.slice(k, 1), t) for c, t in ((lengths, "<i4"), (letters, "u1")))), corpus._numbers(values.slice(k, 1), "<i4")
            assert array.take(pa.array(place)).equals(part) and all(seen.setdefault(t, b) == b for t in part.to_pylist())
            found += part.to_pylist()
        assert sorted(found) == tokens and set(bucket.to_pylist()) == {seen[t] for t in tokens}
    run = bindings.Run(spark, small)
    for df in (corpus.chunks_df(run.chunks), corpus.statistical_keyphrases(run.chunks, run.df, run.stop, run.n)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(tokens" not in plan and "explode(arrays_zip" not in plan
        assert set(run.chunks.columns).isdisjoint({"tokens"})


def test_contenders_hold_all_of_the_greatest():
    rng = np.random.default_rng(5)
    doc = np.sort(rng.integers(0, 60, 9000))
    doc = doc[doc % 7 != 3]
    for weight in (rng.random(len(doc)), rng.integers(0, 4, len(doc)).astype(float)):
        kept = corpus._contenders(weight, doc, 60, 12)
        for d in range(60):
            mine = np.flatnonzero(doc == d)
            least = np.sort(weight[mine])[-12] if len(mine) >= 12 else -np.inf
            assert set(mine[weight[mine] >= least - 2e-9]) <= set(kept)
    assert len(corpus._contenders(rng.random(len(doc)), doc, 60, 12)) < len(doc) / 3
    assert len(corpus._contenders(np.zeros(0), np.zeros(0, np.int64), 3, 12)) == 0


def test_runs_across_blocks_and_texts(monkeypatch):
    texts = ["Deep-", "-deep", "--", "a-bc", None, "", "K\u212ann", "İon", "x--yz ab abc", "-", "abc", "de-"]
    expected = [{}, {"deep": 1}, {}, {"a-bc": 1}, {}, {}, {"kknn": 1}, {}, {"x--yz": 1, "abc": 1}, {}, {"abc": 1}, {"de-": 1}]
    expected[0] = {"deep-": 1}
    for block in (1, 4, 9, 1 << 18):
        monkeypatch.setattr(corpus, "BLOCK", block)
        for first in range(len(texts) + 1):
            found, text, code, tf = corpus._numbered(pa.array(texts, pa.string()).slice(first))
            each = [{} for _ in texts[first:]]
            for t, c, n in zip(text, code, tf):
                each[t][found[int(c)].as_py()] = n
            assert each == expected[first:] and found.to_pylist() == sorted(set().union(*each, []))


def test_links_are_counted_and_ranked_without_being_told_apart_again(spark, small):
    run = bindings.Run(spark, small)
    unique = run.links.groupBy("id", "text").agg(F.count("*").alias("n")).where("n > 1")
    assert unique.isEmpty()
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert "Aggregate" not in corpus.leaves(run.links, run.vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in registry.queries()["q_kw_drilldown"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    counts = topics.year_counts(run.linked, run.meta, [2020])
    assert exchanges(counts) <= 3 and "sequence(" not in registry.queries()["q_hist_max"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    links = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), (None, "b"), ("4", "a")], "id string, text string")
    records = spark.createDataFrame([("1", 2019), ("2", 2020), ("3", None), ("4", 0)], "id string, year int")
    assert {tuple(r) for r in topics.year_counts(links, records, [2020]).collect()} == {("a", 2019, 1)}
    assert {tuple(r) for r in topics.year_histogram(links, records, [2020]).collect()} == {("a", 2019, 1), ("b", 2019, 0)}
    vocab = corpus.vocabulary(links.withColumn("score", F.lit(0.5)), 1)
    assert {(r.vocab_idx, r.text, r.weight, r.doc_freq) for r in vocab.collect()} == {(0, "a", 1.5, 3), (1, "b", 1.0, 1)}


def test_files_of_large_rows_have_few(spark):
    staged = bindings.Scratch(spark, "test").stage(spark.range(9, numPartitions=1), "few", rows=2)
    assert staged.count() == 9 and staged.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] == 2


def test_weights_that_round_alike_are_all_taken():
    tokens = ["aaa", "bbb", "ccc", "ddd", "zzz"]
    known = [{"pos": p, "idf": x} for p, x in ((1, 1.0), (2, 1.0), (3, 0.5), (4, 1.0000000001))]
    packed = {c: pa.array([np.array(x, "<i4").tobytes()], pa.binary()) for c, x in (("ends", [5, 5, 6]), ("codes", [0, 1, 2, 3, 4, 3]), ("tf", [9, 1, 1, 1, 1, 2]))}
    batch = pa.RecordBatch.from_pydict({"ids": [["x", "y", "z"]], "tokens": [tokens], "known": [known], **packed})
    found = [(r["id"], [t["token"] for t in r["top"]]) for b in corpus._heaviest(1)([batch]) for r in b.to_pylist()]
    assert found == [("x", ["zzz", "bbb"]), ("y", []), ("z", ["ddd"])]


def test_texts_are_read_for_heads_and_tokens_alone(spark, small):
    run = bindings.Run(spark, small)
    for df in (run.judged, run.meta):
        assert "documents.parquet" not in df._jdf.queryExecution().optimizedPlan().toString() and "text" not in df.columns
    assert run.judged.count() == run.all.count()


def test_whole_texts_are_cleaned_as_their_beginnings(spark):
    spaces = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace())
    texts = [None, "", " ", spaces, f"a{spaces}b  c\u200bd\u180ee ", "x\n\ny", " é\u3000日本 "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert all(r.a == r.b for r in df.select(T.clean_long(F.col("t")).alias("a"), T.clean_ws(F.col("t")).alias("b")).collect())
    plan = bindings.Run(spark, "/root/testdata/sf0.001").kept.select("id", "abstract")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(coalesce(text" not in plan.replace("length(trim(regexp_replace(coalesce(text", "")


def test_least_chars_tell_short_texts(spark):
    texts = ["x" * 99, "x" * 100, " x" * 60, "\n \t" * 400 + "y" * 99, "\n \t" * 400 + "y" * 100, "z" + " " * 500, "  ", "", None, "ab " * 300]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = df.select(corpus.least_chars("t").alias("n"), F.length(T.clean_ws(F.col("t"))).alias("m")).collect()
    assert all(r.n == r.m if r.m < 100 else 100 <= r.n <= r.m for r in found)


def test_tree_rows_hold_no_array_of_documents(spark, small):
    df = spark.createDataFrame([("a", x) for x in ("10", "9", "10", "é")] + [("b", "1"), ("c", "1")], "k string, v string").repartition(3)
    found = {r.k: (r.n, r.digest) for r in artifact.digests(df, "k", "v").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert found == {"a": (3, md5("10,9,é")), "b": (1, md5("1")), "c": (1, md5("1"))}
    for name in ("q_tree", "q_best_covered", "q_review_report"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set(id" not in plan and "docs" not in plan.replace("topic_docs", "").replace("sub_docs", "")


def test_hashed_vectors_are_those_of_single_texts():
    texts = ["graph neural networks", "", "é", "ab", "aaaa", "Größe und Maß", "x" * 300, "日本語 text", "\U0001f600 a"] + [f"w{k} of {k * k}" for k in range(500)]
    found = vectors.hashed_vectors(texts)
    assert (found == np.stack([vectors.hashed_vector(t) for t in texts])).all()
    began = time.time()
    vectors.hashed_vectors(["graph neural networks"] * 20_000)
    many = time.time() - began
    began = time.time()
    [vectors.hashed_vector("graph neural networks") for _ in range(20_000)]
    assert many < time.time() - began


def test_ward_nests_and_matches_a_plain_loop():
    x = np.random.default_rng(1).normal(size=(40, 5))
    merges = vectors.ward(x)
    groups, heights = [[k] for k in range(len(x))], []
    while len(groups) > 1:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum() * 2
        h, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(h)
        groups[i] = groups[i] + groups.pop(j)
    assert np.allclose([m[2] for m in merges], heights, rtol=1e-3)
    top, sub = vectors.cut(40, merges, 4), vectors.cut(40, merges, 12)
    assert len(set(top)) == 4 and len(set(sub)) == 12
    assert all(len({top[k] for k in range(40) if sub[k] == s}) == 1 for s in set(sub))
    assert len(vectors.cut(1, vectors.ward(x[:1]), 18)) == 1


def test_ward_of_equal_places():
    x = np.repeat(np.random.default_rng(3).normal(size=(30, 5)), 7, axis=0)
    merges = vectors.ward(x)
    assert [round(h, 9) for _, _, h in merges[:180]] == [0] * 180 and merges[180][2] > 0.01
    assert (vectors.cut(210, merges, 30) == np.repeat(np.arange(30), 7)).all()


def test_ward_clusters_of_many_keyphrases(spark):
    texts = [f"{k * 7919 % 10_007:05d} {k:05d}" for k in range(10_050)]
    vocab = spark.createDataFrame(list(enumerate(texts)), "vocab_idx long, text string")
    found = sorted(map(tuple, vectors.ward_clusters(vocab).collect()))
    merges = vectors.ward(np.array([vectors.hashed_vector(t) for t in texts]))
    l1, l2 = (vectors.cut(len(texts), merges, k) for k in (18, 90))
    assert found == [(k, t, a, b) for k, (t, a, b) in enumerate(zip(texts, l1.tolist(), l2.tolist()))]


def test_places_keep_distances():
    at = np.random.default_rng(2).normal(size=(6, 2))
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    found = vectors.classical_mds(d)
    assert found.min() >= 0 and found.max() <= 1 and found.shape == (6, 2)


def test_queries_that_sql_cannot_state(spark, small):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, small).count() > 0
    assert registry.flagship(spark, small).columns == ["cluster", "rank", "token", "score"]


@pytest.mark.parametrize("gone", [("topicloom/llm", "tests/llm", "corpus_pipeline.py"), ("topicloom/llm", "tests/llm"), ("topicloom/llm/minhash.py",)])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    root = Path(__file__).parent.parent
    for name in ("topicloom", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).exists():
            (shutil.rmtree if (tmp_path / name).is_dir() else os.remove)(tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and set(s) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split()[-1]) == len(registry.queries())
