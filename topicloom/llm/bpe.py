"""Byte-level BPE by speculation: propose by longest match, verify adjacent pairs, merge exactly only where that fails.

A sequence of tokens is what BPE makes of a word if and only if every two neighbours are compatible: BPE makes the same
two tokens of their joint bytes. So the longest-match tokens of all unseen words of a batch are proposed, every distinct
neighbouring pair is tested at once with numpy, and only words with an incompatible pair are merged rank by rank. The
claim needs tokens that BPE makes of their own bytes; words with one of the few other tokens are merged exactly too.

Pre-tokens are those of the public pattern of byte-level BPE; the string of a special token is that token wherever it
stands, as the tokenizers library has it by default. Ids decode to the bytes of their tokens, read as UTF-8 with
replacement characters for what is no UTF-8.

Null texts count as empty and have no ids. Rows with null or repeated doc_id are encoded like others. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the library's pattern has it: Unicode's, without the separators U+001C to U+001F.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A text is cut at its single spaces before the pattern is applied, unless one of the parts is empty or has these.
_RUNS = regex.compile(rf"[{_S}][{_S}]|^[{_S}]|[{_S}]$")
#: Entries a worker keeps in its map of chunks and words (about 250 MB); a full map loses the half that came last, for
#: frequent ones are among those that were met first.
CACHE_ENTRIES = 1_000_000
#: Words of more characters are rare, and go down the trie one by one; those that fail are merged with a heap.
_LONG = 256
#: Characters of the texts that are encoded together.
_AT_ONCE = 4_000_000

_encoders: dict[str, "BpeEncoder"] = {}


def bpe(path: str) -> "BpeEncoder":
    """This process's encoder for a byte-level BPE file of the tokenizers library."""
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]


def _byte_of() -> dict[str, int]:
    """The public byte-to-character table of byte-level BPE, from character to byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return table


class BpeEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.size = 1 + max([*vocab.values(), *special.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        rank_of = np.full(self.size, -1, dtype=np.int64)
        left, right = np.arange(self.size), np.arange(self.size)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[a], vocab[b]
            c = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merged[a, b] = (rank, c)
            if rank_of[c] < 0:
                rank_of[c], left[c], right[c] = rank, a, b
        for text, i in special.items():
            self.bytes_of[i] = text.encode()
        self.rank, self.left, self.right = rank_of, left, right
        keys = np.array([a * self.size + b for a, b in self.merged], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merged.values()], dtype=np.int64)[order]
        # a trie of the tokens: (node * 256 + byte), sorted, to node; and each node's token or -1
        nodes: dict[bytes, int] = {b"": 0}
        for token in sorted(self.id_of):
            for k in range(1, len(token) + 1):
                nodes.setdefault(token[:k], len(nodes))
        steps = sorted((nodes[x[:-1]] * 256 + x[-1], n) for x, n in nodes.items() if x)
        self.step_keys, self.step_nodes = (np.array(x, dtype=np.int64) for x in zip(*steps))
        self.token_at = np.array([self.id_of.get(x, -1) for x in nodes], dtype=np.int64)
        self.pair_tokens = np.array([c for _, c in self.merged.values()], dtype=np.int64)[order]
        self.sound = np.ones(self.size, dtype=bool)  # tokens that BPE makes of their own bytes
        made, sizes = self.merge_many(list(self.id_of))
        self.sound[list(self.id_of.values())] = sizes == 1
        self.specials = special
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.known: dict[str, bytes | None] = {}  # None: the text is cut by the pattern alone
        # decimal ids, each with a comma, filled up with zero bytes
        self.decimal = np.array([f"{i}," for i in range(self.size)], dtype="S").view(np.uint8).reshape(self.size, -1)
        self.steps: dict[int, int] | None = None
        self.tokens: list[int] = []
        self.exact = self.proposed = 0  # words merged exactly, and words seen

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """BPE itself, on all words at once: in each round every word's pair of least rank is merged, the leftmost first,
        until no pair has one. The tokens of all words, and their number in each."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = np.asarray(self.single, dtype=np.int64)[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        none = np.iinfo(np.int64).max
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranks(at):
            inside = at[(at + 1 < len(ids)) & (at >= 0)]
            inside = inside[word[inside] == word[inside + 1]]
            return inside, self._rank_of_pairs(ids[inside], ids[inside + 1])

        rank = np.full(len(ids), none)
        inside, found = ranks(np.arange(len(ids)))
        rank[inside] = found
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            ended = np.repeat(least == none, sizes)
            done.append((word[ended], ids[ended]))
            ids, word, rank = ids[~ended], word[~ended], rank[~ended]
            if not len(ids):
                break
            sizes, least = sizes[least != none], least[least != none]
            starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hit[np.unique(word[hit], return_index=True)[1]]  # the leftmost of each word
            ids[at] = self._token_of_pairs(ids[at], ids[at + 1])
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one token fewer before each
            ids, word, rank = ids[keep], word[keep], rank[keep]
            rank[at] = none
            for near in (at - 1, at):
                inside, found = ranks(near)
                rank[inside] = found
        word, ids = (np.concatenate(x) for x in zip(*done)) if done else (word, ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: bytes) -> list[int]:
        """The same for one long word: pairs wait in a heap, so that the cost is n log n."""
        ids = [self.single[b] for b in word]
        n, merged = len(ids), self.merged
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(merged[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in merged]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            m = after[k] if ids[k] >= 0 else -1
            if m < 0 or (ids[k], ids[m]) != pair:
                continue
            ids[k], ids[m] = merged[pair][1], -1
            after[k] = after[m]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in merged:
                    heapq.heappush(heap, (merged[p][0], a, p))
        return [i for i in ids if i >= 0]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest-match tokens of all words, and their number in each. All words go down the trie side by side."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        stop = np.cumsum(lengths)
        at = stop - lengths  # where each word's next token begins
        word, found = np.flatnonzero(lengths), []
        at, stop = at[word], stop[word]
        node, place, best, best_end = np.zeros(len(word), np.int64), at.copy(), np.full(len(word), -1), at.copy()
        while len(word):
            key = node * 256 + raw[np.minimum(place, len(raw) - 1)]
            k = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            go = (self.step_keys[k] == key) & (place < stop)
            node = np.where(go, self.step_nodes[k], 0)
            place = np.where(go, place + 1, place)
            token = np.where(go, self.token_at[node], -1)
            better = token >= 0
            best, best_end = np.where(better, token, best), np.where(better, place, best_end)
            over = np.flatnonzero(~go)
            found.append((word[over], at[over], best[over]))
            at[over] = place[over] = best_end[over]
            best[over] = -1
            if (at[over] >= stop[over]).any():
                left = at < stop
                word, at, stop, node, place, best, best_end = (x[left] for x in (word, at, stop, node, place, best, best_end))
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, at, token = (np.concatenate(x) for x in zip(*found))
        return token[np.argsort(at)], np.bincount(word, minlength=len(words))

    def propose_long(self, word: bytes) -> list[int]:
        """The same for one long word, byte by byte."""
        if self.steps is None:
            self.steps = dict(zip(self.step_keys.tolist(), self.step_nodes.tolist()))
            self.tokens = self.token_at.tolist()
        step, token_at, out, at = self.steps.get, self.tokens, [], 0
        while at < len(word):
            node, k, best = step(word[at], 0), at + 1, -1
            while node:
                if token_at[node] >= 0:
                    best, end = token_at[node], k
                node, k = (step(node * 256 + word[k], 0), k + 1) if k < len(word) else (0, k)
            out.append(best)
            at = end
        return out

    # --- many words ---

    def _rank_of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a very large number where there is none."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.iinfo(np.int64).max)

    def _token_of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pair_tokens[np.searchsorted(self.pair_keys, a * self.size + b)]

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE keeps each two tokens apart.

        The merges that made both tokens are undone from the last to the first. If, before some of them was made, the
        tokens that then touched had a merge of lower rank (or of equal rank further left), BPE would have joined them.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        fine, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(open_):
            bad = self._rank_of_pairs(a, b) < limit
            fine[open_[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            done = bad | ((ra < 0) & (rb < 0))
            undo_a = ra > rb
            # what stands left is made first among merges of one rank: undoing b's, a pair of the same rank comes first
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            a, b, limit, open_ = a[~done], b[~done], limit[~done], open_[~done]
        return fine

    def _learn_words(self, new: list[str]) -> None:
        new = sorted(new, key=lambda w: len(w) > _LONG)
        short = sum(len(w) <= _LONG for w in new)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        flat, sizes = self.propose(raw[:short])
        if short < len(raw):
            each = [np.asarray(self.propose_long(w), dtype=np.int64) for w in raw[short:]]
            flat, sizes = np.concatenate([flat, *each]), np.concatenate([sizes, [len(x) for x in each]])
        word = np.repeat(np.arange(len(raw)), sizes)
        fails = np.zeros(len(raw), dtype=bool)
        fails[word[~self.sound[flat]]] = True
        if len(flat) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            pairs, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            fails[word[inner[~self.compatible(pairs // self.size, pairs % self.size)[which]]]] = True
        self.proposed += len(new)
        self.exact += int(fails.sum())
        self._keep([w for w, f in zip(new, fails.tolist()) if not f], flat[~fails[word]], sizes[~fails])
        failed = np.flatnonzero(fails).tolist()
        self._keep([new[k] for k in failed if k < short], *self.merge_many([raw[k] for k in failed if k < short]))
        for k in failed:
            if k >= short:
                self.known[new[k]] = np.asarray(self.merge_long(raw[k]), dtype=self.dtype).tobytes()

    def _keep(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        packed, width = flat.astype(self.dtype).tobytes(), self.dtype.itemsize
        stops = np.cumsum(sizes) * width
        for w, a, b in zip(words, (stops - sizes * width).tolist(), stops.tolist()):
            self.known[w] = packed[a:b]

    def _learn(self, new: set[str], whole: list[list[str]]) -> None:
        """Encodes unseen chunks, and the pre-tokens of texts that aren't cut into chunks."""
        mixed, words = {}, set()
        for chunk in new:
            bare = chunk[1:] if chunk[:1] == " " else chunk
            if bare.isalpha():
                words.add(chunk)
            elif not bare or _RUNS.search(bare):
                self.known[chunk] = None
            else:
                mixed[chunk] = parts = _PATTERN.findall(chunk)
                words.update(parts)
        for parts in whole:
            words.update(parts)
        self._learn_words([w for w in words if self.known.get(w) is None])
        known = self.known
        for chunk, parts in mixed.items():
            known[chunk] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        out: list[np.ndarray] = []
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > _AT_ONCE:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE_ENTRIES:
            self.known = dict(islice(self.known.items(), CACHE_ENTRIES // 2))
        parts: list[str] = []  # what stands between special tokens, and these
        counts = []
        for text in texts:
            split = self.special.split(text) if text and any(x in text for x in self.specials) else [text or ""]
            parts += split
            counts.append(len(split))
        cut, seen = [], set()
        for part in parts:
            first, *rest = part.split(" ")
            cut.append([first, *[" " + c for c in rest]] if part else [])
            seen.update(cut[-1])
        self._learn(seen.difference(self.known), [])
        known, packed, late = self.known.__getitem__, [], []
        for k, chunks in enumerate(cut):
            try:
                packed.append(b"".join(map(known, chunks)))
            except TypeError:  # a chunk that can't be encoded by itself
                packed.append(b"")
                late.append(k)
        whole = [_PATTERN.findall(parts[k]) for k in late]
        self._learn(set(), whole)
        for k, words in zip(late, whole):
            packed[k] = b"".join(map(known, words))
        out, at = [], 0
        for n in counts:
            raw = packed[at]
            for k in range(at + 1, at + n):
                raw += packed[k] if (k - at) % 2 == 0 else np.asarray([self.specials[parts[k]]], dtype=self.dtype).tobytes()
            out.append(np.frombuffer(raw, dtype=self.dtype))
            at += n
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self._encode([text])[0]

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        digits = self.decimal[ids].reshape(-1)
        return digits[digits != 0][:-1].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of docs (doc_id, text)."""

    def run(batches):
        enc = bpe(tokenizer)
        for batch in batches:
            ids = enc.encode_many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, ids); null ids give a null text."""

    def run(batches):
        enc = bpe(tokenizer)
        for batch in batches:
            texts = [None if x is None else enc.decode(np.asarray(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's decimal ids joined by commas, and of what
    those ids decode to. Both ways run in one pass, so ids need not leave the worker."""

    def run(batches):
        enc = bpe(tokenizer)
        for batch in batches:
            n, first, second = [], [], []
            for ids in enc.encode_many(batch.column(1).to_pylist()):
                n.append(len(ids))
                first.append(hashlib.sha256(enc.decimals(ids)).hexdigest())
                second.append(hashlib.sha256(enc.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
