"""Sharding, toxicity scores, and the pipeline as a whole."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicloom.llm import queries as Q
from topicloom.llm import sharding, toxicity
from topicloom.llm.sharding import CapacityTree, best_fit_decreasing, shard_documents

from .common import docs_of, odd_rows
from .test_lines import by_brute_force, key
from .test_near import near_by_brute_force
from .test_tokens import check_packing

# --- sharding ---


def test_capacity_tree_against_a_list():
    rng, tree, held = random.Random(1), CapacityTree(), set()
    for _ in range(5000):
        what = rng.random()
        if what < 0.5 or not held:
            x = (rng.randrange(50), rng.randrange(10_000))
            if x not in held:
                tree.add(*x)
                held.add(x)
        elif what < 0.9:
            least = rng.randrange(55)
            expected = min((x for x in held if x[0] >= least), default=None)
            assert tree.take(least) == expected
            held.discard(expected)
        else:
            most = max(x[0] for x in held)
            expected = min(x for x in held if x[0] == most)
            assert tree.take_most() == expected
            held.remove(expected)


def place_one_by_one(sizes, capacity, shards=None):
    room, place = [capacity] * (shards or 0), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(r, s) for s, r in enumerate(room) if r >= sizes[k]]
        if fits:
            s = min(fits)[1]
        elif shards:
            s = max(range(len(room)), key=lambda s: (room[s], -s))
        else:
            room.append(max(capacity, sizes[k]))
            s = len(room) - 1
        room[s] -= sizes[k]
        place[k] = s
    return place


def test_best_fit_decreasing_against_a_list():
    rng = random.Random(2)
    for _ in range(100):
        sizes = sorted((rng.randint(1, rng.choice([5, 10, 100, 150])) for _ in range(rng.randint(0, 80))), reverse=True)
        shards = rng.choice([None, 1, 4, 8])
        counts = Counter(sizes)
        place = []
        runs = best_fit_decreasing(list(counts), list(counts.values()), 100, shards)
        for k, (size, first, shard) in enumerate(runs):
            until = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == size else counts[size]
            place += [shard] * (until - first)
        assert place == place_one_by_one(sizes, 100, shards)


def check_shards(found, rows, shards=None, capacity=None):
    expected = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=key) == expected
    slots, filled, of = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
        of[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in of.values())
    total, largest = sum(filled.values()), defaultdict(int)
    for r in found:
        largest[r.size, r.text_crc32] += r.size
    if capacity:
        assert all(x <= max(capacity, max(largest.values())) for x in filled.values())
        assert len(filled) <= 1.25 * -(-total // capacity) + 1
    else:
        assert set(filled) <= set(range(shards))
        assert max(filled.values()) <= max(1.01 * total / shards + 100, max(largest.values()))


def expected_shards(rows, capacity, shards=None):
    """The shard of each text, placed group by group."""
    groups = defaultdict(int)
    for _, t in rows:
        groups[(t or "").encode()] += len((t or "").encode()) + 1
    order = sorted(groups, key=lambda t: (-groups[t], hashlib.md5(t).digest()))
    return dict(zip(order, place_one_by_one([groups[t] for t in order], capacity, shards)))


@pytest.mark.parametrize("frequent", [4096, 3])
def test_shards_of_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(sharding, "FREQUENT", frequent)
    rows = odd_rows(long_words=500)
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    for shards, capacity in ((4, None), (None, 9000)):
        found = shard_documents(docs_of(spark, rows), shards, capacity).collect()
        check_shards(found, rows, shards, capacity)
        shard = expected_shards(rows, capacity or -(-total // shards), shards)
        of = {(len(t) + 1, zlib.crc32(t)): s for t, s in shard.items()}
        assert all(r.shard == of[r.size, r.text_crc32] for r in found)
        each = sorted((r.shard, r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in found)
        assert each == sorted(each, key=lambda x: (x[0], x[2:]))  # slots go by doc_id


def test_many_shards(spark):
    rows = [(k, f"text {k} " * (1 + k % 7)) for k in range(6000)]
    total = sum(len(t) + 1 for _, t in rows)
    found = shard_documents(docs_of(spark, rows), None, 2000).collect()
    check_shards(found, rows, capacity=2000)
    assert len({r.shard for r in found}) <= 1.02 * total / 2000 + 1


def test_shards_of_nothing(spark):
    assert shard_documents(docs_of(spark, []), 8).collect() == []
    assert shard_documents(docs_of(spark, []), None, 10).collect() == []
    with pytest.raises(ValueError):
        shard_documents(docs_of(spark, []), 8, 10)


def test_a_text_that_a_third_of_all_rows_have(spark):
    rows = [(k, "copied text " * 20 if k % 3 else f"own text {k} " * 30) for k in range(900)]
    check_shards(shard_documents(docs_of(spark, rows), 8).collect(), rows, 8)


def test_op9_on_documents(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    found = Q.op9_sharding(spark, medium).collect()
    check_shards(found, docs, 8)
    assert all(r.law == "bytes" and r.grown_shard is None for r in found)


# --- toxicity ---


def auc(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    p = np.asarray(labels, dtype=bool)
    return (order[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_op10_ranks_held_out_documents(spark):
    big = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in Q.op10_toxicity(spark, big).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    held = [i for i in labels if i in found and found[i].held_out]
    truth, scores = [labels[i] for i in held], [found[i].score for i in held]
    assert auc(truth, scores) > 0.95
    assert sum((s >= 0.5) == bool(t) for t, s in zip(truth, scores)) / len(held) > 0.95
    assert sum(r.predicted for r in found.values()) < 0.3 * len(found)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores_of_odd_rows(spark):
    rows = odd_rows(long_words=2000) + [(5000 + k, ("vile nasty words here " if k % 2 else "kind gentle words here ") + f"w{k}") for k in range(200)]
    labels = labelled(spark, [(5000 + k, 1, k % 2) for k in range(200)] + [(5000, 0, 0), (None, 1, 1), (10, None, None), (99, 1, 1)])
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, labels, l1=0.1)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(rows) and all(0 <= r.toxicity_score <= 1 for r in scores)
    by = {r.doc_id: r.toxicity_score for r in scores}
    assert all((by[5000 + k] >= 0.5) == bool(k % 2) for k in range(200))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    assert len(kept.collect()) == sum(r.toxicity_score < 0.5 for r in scores)
    assert all(r.d == "D" for r in kept.collect())


def test_what_is_not_in_the_training_folds_is_not_learned(spark):
    rows = [(k, f"toxic words {k}" if k % 2 else f"nice words {k}") for k in range(300)]
    labels = [(k, 1, k % 2) for k in range(300)]
    turned = [(k, 1, t if zlib.crc32(str(k).encode()) % 5 else 1 - t) for k, _, t in labels]
    a, b = (toxicity.fit(docs_of(spark, rows), labelled(spark, x), l1=0.1) for x in (labels, turned))
    assert a.bias == b.bias and (a.weights == b.weights).all() and len(a.weights)


@pytest.mark.parametrize("labels, expected", [([], 0.0), ([(k, 1, 0) for k in range(20)], 0.0), ([(k, 1, 1) for k in range(20)], 1.0), ([(k, 1, None) for k in range(20)], 0.0)])
def test_nothing_to_learn_from(spark, labels, expected):
    docs = docs_of(spark, [(k, f"text {k}") for k in range(20)])
    model = toxicity.fit(docs, labelled(spark, labels))
    assert {r.toxicity_score for r in toxicity.score(docs, model).collect()} == {expected}
    assert toxicity.score(docs_of(spark, []), model).collect() == []


def test_sparse_weights():
    rng = random.Random(1)
    rows = [(k % 2, np.unique(toxicity.features(" ".join(rng.choices("abcdefgh", k=20)) + (" awful" if k % 2 else " lovely")))) for k in range(400)]
    kept, weights, _ = toxicity._train(rows, toxicity.BITS, 2, 1.0, 1.0, 5.0, 0.1)
    assert 0 < len(kept) < 0.5 * len(np.unique(np.concatenate([f for _, f in rows])))
    assert set(toxicity.features("awful").tolist()) | set(toxicity.features("lovely").tolist()) <= set(kept.tolist())


# --- the pipeline ---


def test_pipeline_stage_by_stage(spark, small, tmp_path):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "packing"]
    inputs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
        out = stage(spark, docs, small)
        if k < 3:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    all_, civil, lines, kept = inputs
    scores = {r.doc_id: r.score for r in Q.op10_toxicity(spark, small).collect()}
    assert sorted(civil) == sorted(r for r in all_ if scores[r[0]] < 0.5)
    assert [(i, t) for i, t, *_ in sorted(lines)] == [(i, t) for i, _, _, t in by_brute_force([r[:2] for r in civil])]
    assert sorted(r[2:] for r in lines) == sorted(r[2:] for r in civil)
    stay = {i for i, _, c in near_by_brute_force([r[:2] for r in lines], 80) if i == c}
    assert sorted(kept) == sorted(r for r in lines if r[0] in stay)
    check_packing(docs.collect(), [r[:2] for r in kept], 2048, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    whole = sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert whole == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())


def test_pipeline_of_odd_rows(spark, tmp_path):
    labelled(spark, [(5000 + k, 1, k % 2) for k in range(50)]).write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, t) for i, t in odd_rows(long_words=2000)]
    for name, given in (("odd", rows), ("none", [])):
        docs = docs_of(spark, given)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert bool(packed) == bool(given), name
        assert {r.doc_id for r in packed} <= {i for i, _ in given}
    assert re.search("toxic", corpus_pipeline.__doc__)


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """Weights other than zero and the bias, by loops over single coordinates."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        shrink = 0.0 if i == "bias" else l1
        if abs(z[i]) <= shrink:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * shrink) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for label, at in rows:
            weights = {i: weight(i) for i in [*at, "bias"]}
            g = 1 / (1 + np.exp(-sum(weights.values()))) - label
            for i, w in weights.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w
                n[i] += g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i) != 0}, weight("bias")


def test_training_against_a_plain_loop():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefg", k=4)) for _ in range(60)]
    rows = []
    for _ in range(150):
        toxic = rng.random() < 0.4
        text = " ".join(rng.choices(words[:25] if toxic else words[15:], k=rng.randint(0, 12)))
        rows.append((int(toxic), np.unique(toxicity.features(text, 10))))
    for settings in ((4, 1.0, 1.0, 8.0, 0.1), (2, 0.3, 0.5, 0.2, 1.0)):
        kept, weights, bias = toxicity._train(rows, 10, *settings)
        expected, own = plain_ftrl([(label, at.tolist()) for label, at in rows], *settings)
        assert expected and kept.tolist() == sorted(expected)
        assert np.allclose(weights, [expected[i] for i in kept.tolist()], rtol=1e-9) and abs(bias - own) < 1e-9
