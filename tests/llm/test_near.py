"""Near-duplicates of documents and vectors, and nearest neighbours, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from topicloom.llm import ann, embedding_dedup, hot, itq, minhash
from topicloom.llm import queries as Q
from topicloom.llm.ann import nearest
from topicloom.llm.components import components
from topicloom.llm.scratch import Scratch

from .common import docs_of, odd_rows


def labels_of(nodes, links):
    """The least node reachable, for each node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingle_set(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(table))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def near_by_brute_force(rows, percent):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    by = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                by.setdefault(x, []).append(k)
    links = set()
    for a, (i, s) in enumerate(sets):
        if i is None:
            continue
        shared = Counter(b for x in s for b in by[x] if b > a)
        links |= {(i, sets[b][0]) for b, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[b][1]) - n)}
    label = labels_of({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(s), label.get(i)) for i, s in sets), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def found_near(rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_of_odd_rows(spark, percent):
    rows = odd_rows()
    found = minhash.near_duplicates(docs_of(spark, rows), percent).collect()
    assert found_near(found) == near_by_brute_force(rows, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def chained(seed, groups=6, size=14, words=60):
    """Groups in which neighbours are near and ends are not."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        text = [f"w{rng.randrange(10_000)}" for _ in range(words)]
        for k in range(size):
            rows.append((100 * g + k, " ".join(text)))
            if k % 2:
                text = [*text, f"w{rng.randrange(10_000)}"]
            else:
                text[rng.randrange(words // 2)] = f"w{rng.randrange(10_000)}"
    rng.shuffle(rows)
    return rows


def test_chains_of_near_duplicates(spark, monkeypatch):
    rows = chained(2)
    expected = near_by_brute_force(rows, 80)
    assert found_near(minhash.near_duplicates(docs_of(spark, rows), 80).collect()) == expected
    monkeypatch.setattr(minhash, "BLOCK", 3)  # many blocks in each group
    monkeypatch.setattr(hot, "HOT", 2)
    assert found_near(minhash.near_duplicates(docs_of(spark, rows), 80, None).collect()) == expected
    monkeypatch.setattr(minhash, "BLOCK", 512)
    monkeypatch.setattr(minhash, "ELEMENTS", 300)  # blocks bounded by the size of their sets
    monkeypatch.setattr(minhash, "_AT_ONCE", 5000)
    assert found_near(minhash.near_duplicates(docs_of(spark, rows), 80).collect()) == expected


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_join_of_frequent_keys(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hot, "small", lambda df: df.limit(broadcast) if broadcast else df)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(400)], "key long, x long")
    table = spark.createDataFrame([(k, 10 * k, n) for k, n in ((0, 172), (1, 38), (2, 38), (9, 1))], "key long, y long, n long")
    expected = sorted(map(tuple, rows.join(table.drop("n"), "key").collect()))
    for limit in (1, 50, 1000):
        assert sorted(map(tuple, hot.join_hot(rows, table, "key", "n", limit).collect())) == expected


def test_near_duplicates_that_stay(spark):
    rows = chained(4) + odd_rows()
    docs = docs_of(spark, rows)
    stay = {i for i, _, c in near_by_brute_force(rows, 80) if i is not None and i == c}
    kept = minhash.drop_near_duplicates(docs, 80)
    assert kept.schema == docs.schema
    found = kept.collect()
    assert {r.doc_id for r in found if r.doc_id is not None} == stay
    assert sum(r.doc_id is None for r in found) == sum(i is None for i, _ in rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).collect() == []
    assert minhash.drop_near_duplicates(docs_of(spark, [])).collect() == []


def test_registers_merge_by_maximum_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)) for _ in range(2))
    union = np.union1d(a, b)
    regs = [np.frombuffer(minhash.registers(x), dtype=np.uint8) for x in (a, b, union)]
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    half = np.frombuffer(minhash.registers(np.union1d(a[:2900], b[:100])), dtype=np.uint8)
    near = minhash.likely(np.stack([regs[0]] * 2), np.stack([half, regs[1]]), np.array([3000, 3000]), np.array([3000, 3000]), 0.85)
    assert near.tolist() == [True, False]


def test_op5_on_documents(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    assert found_near(Q.op5_minhash(spark, medium).collect()) == near_by_brute_force(docs, 85)


def test_components_of_paths(spark):
    links = [(k, k + 1) for k in range(60)] + [(200, 100), (200, 150), (7, 7), (None, 3)] + [(1000, 1001 + k) for k in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components(df, Scratch(spark, "t"), "x").collect()}
    assert found == labels_of(set(range(61)) | {100, 150, 200} | set(range(1000, 1051)), [x for x in links if None not in x])


# --- vectors ---

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("block", T.StringType()), T.StructField("codes", T.StringType())])


def odd_vectors(spark, seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(300, dim)).tolist())]
    centre = rng.normal(size=dim)
    rows += [(1000 + k, (centre + 0.2 * rng.normal(size=dim)).tolist()) for k in range(80)]
    rows += [(2000 + k, centre.tolist()) for k in range(30)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [None] * dim), (3050, [float("nan")] * dim), (3100, [float("inf")] + [1.0] * (dim - 1)), (3150, [1.0, 2.0]), (None, [1.0] * dim)]
    rows += [(50, rows[50][1]), (4000, (3 * centre).tolist())]
    return spark.createDataFrame([(i, x, 1, "b", "c") for i, x in rows], VECTORS)


def sound(rows):
    """(ids, unit vectors in double precision) of rows (vec_id, embedding) that take part."""
    fine = [(r.vec_id, r.embedding) for r in rows if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    most = Counter(len(x) for _, x in fine).most_common(1)
    fine = [(i, x) for i, x in fine if len(x) == most[0][0]]
    x = np.array([x for _, x in fine], dtype=np.float64)
    return np.array([i for i, _ in fine]), x / np.linalg.norm(x, axis=1, keepdims=True)


def recall_of(found, rows, k=5):
    ids, x = sound(rows)
    expected, scores = {}, {}
    for at in np.flatnonzero(ids % 50 == 0):
        others = np.flatnonzero(ids != ids[at])
        cosine = x[others] @ x[at]
        order = np.lexsort((ids[others], -np.round(cosine, 12)))[:k]
        expected.setdefault(int(ids[at]), {int(i) for i in ids[others][order]})
        scores[int(ids[at])] = {int(i): c for i, c in zip(ids[others], cosine)}
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == expected.keys()
    hit = 0
    for q, got in by.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(expected[q]) + 1))
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
        assert all(r.vec_id != q and abs(r.score - scores[q][r.vec_id]) < 1e-12 for r in got)
        hit += len({r.vec_id for r in got} & expected[q])
    return hit / max(1, sum(map(len, expected.values())))


@pytest.mark.parametrize("prefix, reach, radius", [(0, 1, 384), (3, 2, 384), (5, 3, 100), (2, 0, 384), (4, 16, 90)])
def test_probing_retrieves_all_codes_within_reach_of_a_table(prefix, reach, radius):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24))
    x[:300] = x[0] + 0.2 * rng.normal(size=(300, 24))
    tables = ann.Tables(itq.learn(x, 30, 3), 6, reach, radius, 10_000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(900)), pa.array([v.tobytes() for v in x], pa.binary())], names=["node", "vector"])

    def items(spread, chosen):
        return [(r["key"], r["data"]) for part in ann._grouped(tables, 24, prefix, spread)([batch.take(pa.array(chosen))]) for r in part.to_pylist()]

    queries = [0, 3, 5, 700, 899]
    rows = sorted([(key, 0, data) for key, data in items(True, queries)] + [(key, 1, data) for key, data in items(False, list(range(900)))])
    zeros = pa.array(np.zeros(len(rows), dtype=np.int32))
    block = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), zeros, zeros, pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["key", "i", "j", "side", "data"])
    found = {(r["asked"], r["node"]) for part in ann._probed(tables, prefix)([block]) for r in part.to_pylist()}
    subs, codes = tables.cut(itq.unit(x))
    near = lambda a, b: np.bitwise_count(a ^ b)
    expected = {(q, k) for q in queries for k in range(900) if near(subs[q], subs[k]).min() <= reach and near(codes[q], codes[k]).sum() <= radius}
    assert found == expected
    within = (6 * (reach + 1) - 1) if radius == 384 else -1  # the pigeonhole principle
    assert {(q, k) for q in queries for k in range(900) if near(subs[q], subs[k]).sum() <= within} <= found


@pytest.mark.parametrize("codes", [700, 131_072])
def test_nearest_over_several_blocks(spark, tmp_path, monkeypatch, codes):
    monkeypatch.setattr(ann, "CODES", codes)
    monkeypatch.setattr(ann, "QUERIES", 16)
    monkeypatch.setattr(ann, "BLOCK", 1000)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall_of(nearest(table, "vec_id % 50 = 0").collect(), table.collect()) >= 0.9


def test_copies_and_several_vectors_of_an_id(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8)).tolist()
    rows = [(k, x[0] if k % 3 == 0 else x[k]) for k in range(400)] + [(50, x[1]), (50, x[1]), (7, x[0]), (7, x[2]), (100, x[0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {q: [] for q in range(0, 400, 50)}
    for r in sorted(nearest(table, table.vec_id % 50 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r.vec_id)
    assert all(len(ids) == 5 and q not in ids for q, ids in found.items())
    assert found[0] == [3, 6, 7, 9, 12] and found[150] == [0, 3, 6, 7, 9] and found[50][0] == 1


def test_nearest_of_all(spark, tmp_path):
    big = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{big}/embeddings.parquet").collect()
    assert recall_of(Q.op2_ann(spark, big).collect(), rows) >= 0.9


def test_nearest_of_odd_vectors(spark):
    table = odd_vectors(spark)
    assert recall_of(nearest(table, table.vec_id % 50 == 0).collect(), [r for r in table.collect()]) >= 0.9


def test_nearest_of_few(spark):
    table = odd_vectors(spark).limit(0)
    assert nearest(table, table.vec_id % 50 == 0).collect() == []
    table = spark.createDataFrame([(0, [1.0, 0.0], 1, "", ""), (1, [1.0, 1.0], 1, "", ""), (2, [0.0, 1.0], 1, "", "")], VECTORS)
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(table, table.vec_id % 50 == 0).collect())
    assert found == [(0, 1, 1), (0, 2, 2)]


def vector_links(rows, threshold=0.95):
    ids, x = sound(rows)
    linked = x @ x.T >= threshold
    n, links = Counter(), []
    for i in set(ids.tolist()):
        others = {int(j) for at in np.flatnonzero(ids == i) for j in ids[linked[at]]} - {i}
        n[i] = len(others)
        links += [(i, j) for j in others]
    label = labels_of({r.vec_id for r in rows if r.vec_id is not None}, links)
    return {i: (n[i], c) for i, c in label.items()}


def test_vector_links_of_odd_vectors(spark, monkeypatch):
    table = odd_vectors(spark)
    expected = vector_links(table.collect())
    for few, block in ((64, 1024), (4, 8)):
        monkeypatch.setattr(embedding_dedup, "FEW", few)
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        found = embedding_dedup.near_duplicates(table).collect()
        assert len(found) == table.count()
        for r in found:
            if r.vec_id is None:
                assert r.n_links == 0 and r.component_id is None and r.kept
            else:
                assert (r.n_links, r.component_id) == expected[r.vec_id]
                assert r.kept == (r.vec_id == r.component_id)


def test_vector_links_of_nothing(spark):
    assert embedding_dedup.near_duplicates(odd_vectors(spark).limit(0)).collect() == []


def test_op8_on_embeddings(spark):
    big = "/root/testdata/sf0.1"
    expected = vector_links(spark.read.parquet(f"{big}/embeddings.parquet").collect())
    found = {r.vec_id: (r.n_links, r.component_id) for r in Q.op8_embedding_dedup(spark, big).collect()}
    linked = sum(n for n, _ in expected.values())
    assert found.keys() == expected.keys()
    assert all(found[i][0] <= expected[i][0] for i in found)
    assert sum(n for n, _ in found.values()) >= 0.99 * linked
    assert sum(found[i] == expected[i] for i in found) >= 0.99 * len(found)


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.7, 0.9])
def test_planted_pairs_meet_whatever_all_vectors_share(spark, shared):
    rng = np.random.default_rng(6)
    made = lambda n: itq.unit(rng.normal(size=(n, 64)))
    x = itq.unit(shared**0.5 * made(1) + (1 - shared) ** 0.5 * made(1500))
    side = made(1500)
    side = itq.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    cosine = rng.uniform(0.951, 0.96, size=(1500, 1))
    both = np.concatenate([x, cosine * x + (1 - cosine**2) ** 0.5 * side])
    table = spark.createDataFrame([(k, v, 1, "", "") for k, v in enumerate(both.tolist())], VECTORS)
    expected = vector_links(table.collect())
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert all(found[i] <= n for i, (n, _) in expected.items())
    assert sum(found.values()) >= 0.99 * sum(n for n, _ in expected.values()) >= 2900


def test_vectors_of_several_dimensions(spark):
    rng, rows = np.random.default_rng(7), []
    for dim, first, n in ((16, 0, 60), (8, 1000, 40), (1, 2000, 3), (5, 3000, 1)):
        x = rng.normal(size=(n, dim))
        rows += [(first + k, x[k // 2 * 2].tolist()) for k in range(n)]
    rows += [(4000, rows[0][1]), (4000, rows[60][1])]  # links groups of two dimensions
    table = spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], VECTORS)
    unit = [(i, np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float))) for i, v in rows]
    cosines = {(a, b): u @ v for p, (a, u) in enumerate(unit) for q, (b, v) in enumerate(unit) if p != q and a != b and len(u) == len(v)}
    links = [pair for pair, cosine in cosines.items() if cosine >= 0.95]
    n, label = Counter(a for a, _ in links), labels_of({i for i, _ in rows}, links)
    found = embedding_dedup.near_duplicates(table).collect()
    assert sorted({(r.vec_id, r.n_links, r.component_id) for r in found}) == sorted((i, n[i], c) for i, c in label.items())
    assert len(found) == len(rows) and n[4000] == 4 and label[1000] == 0
    near = nearest(table, "vec_id % 50 = 0 AND vec_id < 4000").collect()
    got = {}
    for r in near:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: len(x) for q, x in got.items()} == {0: 5, 50: 5, 1000: 5, 2000: 2}
    assert all(abs(min(x)[2] - 1) < 1e-12 for x in got.values() if len(x) == 5)
    assert all(abs(score - cosines[q, v]) < 1e-12 for q, x in got.items() for _, v, score in x if v != 4000)


def test_rotation_balances_bits():
    x = np.random.default_rng(1).normal(size=(2000, 32)) * np.linspace(1, 4, 32)
    codec = itq.learn(x, 2)
    codes = codec.codes(itq.unit(x))
    bits = np.unpackbits(codes.view(np.uint8).reshape(len(x), -1), axis=1)[:, :32].mean(axis=0)
    assert (abs(bits - 0.5) < 0.1).all()
