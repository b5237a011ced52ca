"""Token files, packing and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicloom.llm import queries as Q
from topicloom.llm.bpe import bpe, decode_documents, encode_documents, round_trip_digests
from topicloom.llm.packing import pack_documents, plan_bins, sequences
from topicloom.llm.token_files import decode_ranks, encode_ranks, read_token_files, write_token_files

from .common import ODD_TEXTS, docs_of, odd_rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_ranks_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
    control, data = encode_ranks(ranks)
    assert (decode_ranks(control, data, n) == ranks).all()
    assert len(control) == -(-n // 4) and len(data) <= 4 * n


def test_small_ranks_take_a_byte():
    control, data = encode_ranks(np.arange(256, dtype="<u4"))
    assert len(data) == 256 and set(control) == {0}


def token_files(spark, tmp_path, rows, **sizes):
    path = f"file://{tmp_path}/files"
    write_token_files(docs_of(spark, rows), WORD, path, **sizes)
    return [tuple(r) for r in read_token_files(spark, path, ids=False).collect()], read_token_files(spark, path).collect()


def test_token_files_of_odd_rows(spark, tmp_path):
    rows, tokenizer = odd_rows(), library(WORD)
    for sizes in ({}, {"ids_per_file": 5_000, "ids_per_block": 500}):
        digests, whole = token_files(spark, tmp_path, rows, **sizes)
        expected = sorted((i, len(ids_of(tokenizer, t)) + 1, crc([*ids_of(tokenizer, t), 1])) for i, t in rows if i is not None)
        assert sorted((i, n, c) for i, _, n, c in digests if i is not None) == expected
        assert len(digests) == len(rows)
        at = 0
        for i, start, n, _ in sorted(digests, key=lambda r: r[1]):
            assert start == at
            at += n
        order = [i for i, *_ in sorted(digests, key=lambda r: r[1])]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
        assert sorted(crc(r.ids) for r in whole) == sorted(c for *_, c in digests)


def test_token_files_of_nothing(spark, tmp_path):
    digests, whole = token_files(spark, tmp_path, [])
    assert digests == whole == []


def test_op1_on_documents(spark, medium):
    tokenizer = library(WORD)
    docs = sorted(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect())
    at, expected = 0, []
    for i, t in docs:
        ids = [*ids_of(tokenizer, t), 1]
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, Q.op1_token_files(spark, medium).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected


# --- packing ---


def bins_one_by_one(lengths, capacity):
    """Best-two-fit as it is told: one bin after another, over a plain list."""
    left, bins = sorted(lengths, reverse=True), []

    def take(limit):
        for k, x in enumerate(left):
            if x <= limit:
                return left.pop(k)
        return None

    while left:
        items, gap = [], capacity
        while gap and (x := take(gap)):
            items.append(x)
            gap -= x
        if gap and len(items) > 1:
            smallest, best = items[-1], None
            room = gap + smallest
            for a in range(len(left)):
                for b in range(a + 1, len(left)):
                    if left[a] + left[b] <= room and (best is None or left[a] + left[b] > best[0]):
                        best = (left[a] + left[b], a, b)
            if best and best[0] > smallest:
                items = [*items[:-1], left[best[1]], left[best[2]]]
                for k in (best[2], best[1]):
                    left.pop(k)
                left = sorted([*left, smallest], reverse=True)
        bins.append(items)
    return bins


def test_plan_is_as_good_as_bins_filled_one_by_one():
    rng = random.Random(3)
    for trial in range(40):
        capacity = rng.choice([7, 20, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 90))]
        counts = {x: lengths.count(x) for x in lengths}
        plan = plan_bins(counts, capacity)
        planned = [x for times, items in plan for x in items * times]
        assert sorted(planned) == sorted(lengths)
        assert all(sum(items) <= capacity for _, items in plan)
        assert sum(times for times, _ in plan) <= len(bins_one_by_one(lengths, capacity)) + 1, trial


def check_packing(found, texts, capacity, tokenizer):
    """found: rows of pack_documents; texts: (doc_id, text)."""
    expected = []
    for i, t in texts:
        ids = [*ids_of(tokenizer, t), 0]
        expected += [(i, p, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for p, s in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(expected, key=key)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r[3] for r in expected)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing_odd_rows(spark, capacity):
    rows = odd_rows()
    found = pack_documents(docs_of(spark, rows), WORD, capacity, per_group=50).collect()
    bins, total = check_packing(found, rows, capacity, library(WORD))
    assert bins <= -(-total // capacity) * 1.1 + 2


def test_packing_nothing(spark):
    assert pack_documents(docs_of(spark, []), WORD).collect() == []


def test_sequences_hold_the_ids(spark):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)]
    packed = pack_documents(docs_of(spark, rows), WORD, 64, with_ids=True)
    found = sequences(packed).collect()
    n = {r.sequence_id: r.n_tokens for r in found}
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * 64 for r in found)
    tokenizer = library(WORD)
    assert sum(n.values()) == sum(len(ids_of(tokenizer, t)) + 1 for _, t in rows)


def test_op4_on_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    bins, total = check_packing(Q.op4_packing(spark, medium).collect(), docs, 2048, library(WORD))
    assert bins <= -(-total // 2048) * 1.01 + 1


# --- byte-level BPE ---


def digests_of(tokenizer, text):
    ids = ids_of(tokenizer, text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_rows(spark):
    rows, tokenizer = odd_rows(), library(BYTE)
    rows += [(5000 + k, t) for k, t in enumerate(["  two  spaces ", "\n\n a\n b", " 's 't'LL '", "aaaa" * 3000, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "\x1c\x1d \x1e", "12 345  6789 x9"])]
    found = round_trip_digests(docs_of(spark, rows), BYTE).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(((i, *digests_of(tokenizer, t)) for i, t in rows), key=key)


def test_bpe_of_random_words():
    enc, tokenizer, rng = bpe(BYTE), library(BYTE), random.Random(5)
    letters = "aeinorstlhd" * 4 + "AEINORST'’-_.,;:!?0123456789éèüßñçøåæœłşğıžšč中文日本語한글كتابабвгд 😀👍\t\n  "
    for _ in range(400):
        text = "".join(rng.choices(letters, k=rng.randint(1, 300)))
        assert enc.encode(text).tolist() == ids_of(tokenizer, text), text
    assert 0 < enc.exact < enc.proposed


def test_long_words_and_small_maps(monkeypatch):
    from topicloom.llm import bpe as module

    enc, tokenizer, rng = module.BpeEncoder(BYTE), library(BYTE), random.Random(6)
    monkeypatch.setattr(module, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(module, "_AT_ONCE", 2000)
    texts = ["".join(rng.choices("abcdeinot", k=n)) for n in (1, 200, 256, 257, 3000, 100_000)]
    texts += [" ".join("".join(rng.choices("etaoin shrdlu", k=9)) for _ in range(60)) for _ in range(40)] + [None, "", " ", "a  b", "\n"]
    assert [x.tolist() for x in enc.encode_many(texts)] == [ids_of(tokenizer, t) for t in texts]
    flat, _ = enc.propose([t.encode() for t in texts[:5]])
    assert flat.tolist() == [i for t in texts[:5] for i in enc.propose_long(t.encode())]
    words = [t.encode() for t in texts[:4]]
    flat, sizes = enc.merge_many(words)
    assert flat.tolist() == [i for w in words for i in enc.merge_long(w)] and sizes.sum() == len(flat)


def test_bpe_decodes_what_it_encodes(spark):
    docs = docs_of(spark, [(k, t) for k, t in enumerate(ODD_TEXTS)])
    back = {r.doc_id: r.text for r in decode_documents(encode_documents(docs, BYTE), BYTE).collect()}
    assert back == {k: t or "" for k, t in enumerate(ODD_TEXTS)}
    assert round_trip_digests(docs_of(spark, []), BYTE).collect() == []


def test_op7_on_documents(spark, medium):
    tokenizer = library(BYTE)
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, Q.op7_bpe(spark, medium).collect())) == sorted((i, *digests_of(tokenizer, t)) for i, t in docs)
