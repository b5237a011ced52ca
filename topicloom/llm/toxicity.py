"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's words are its lower-cased runs of letters and digits. Its features are the words, pairs of neighbours and
pairs one word apart (skip-grams), each hashed to one of 2**BITS coordinates; a coordinate is in a text or not, so long
texts do not gain weight by repeating a word. Training sees one text after another: each coordinate has its own
learning rate, and L1 keeps at zero every weight that the texts do not insist on, so the weights that are left are few
and go to every task.

The classifier is fitted on a sample of labelled rows whose expected size is bounded by ``sample_rows`` (chosen by a
hash of doc_id, alike at every size); scores are computed for all texts. Labels, and every column but ``text``, are
never inputs of a score.

Null texts count as empty; a text without words gets the bias alone. A null doc_id is never a training row. Several
labels of a document count as toxic if one of them says so; null labels are left out. Without a labelled row of each
kind nothing can be learned: scores are then 0 where no row is toxic or none is labelled, and 1 where all are toxic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import release

#: Coordinates: 2**BITS.
BITS = 20
#: Expected number of labelled rows that are used for training, at most.
SAMPLE_ROWS = 20_000
CACHE_ENTRIES = 400_000

_WORD = re.compile(r"[^\W_]+")
_chunks: dict[str, bytes] = {}
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _word_hashes(text: str) -> np.ndarray:
    chunks = text.lower().split()
    if len(_chunks) > CACHE_ENTRIES:
        _chunks.clear()
    for chunk in set(chunks).difference(_chunks):
        _chunks[chunk] = b"".join([xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass"))[::-1] for w in _WORD.findall(chunk)])
    return np.frombuffer(b"".join([_chunks[c] for c in chunks]), dtype="<u8")


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Coordinates of a text's words, word pairs and skip-grams, with repeats."""
    words = _word_hashes(text or "")
    with np.errstate(over="ignore"):
        parts = [words * _A, words[:-1] * _B + words[1:] * _C, words[:-2] * _C + words[2:] * _A + _B]
        return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Coordinates (ascending) with a weight other than zero, and the bias; ``prior`` scores all if nothing was learned."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float | None = None
    bits: int = BITS

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        table = np.zeros(1 << self.bits)
        table[self.coordinates] = self.weights
        margins = np.empty(len(texts))
        for k, text in enumerate(texts):
            found = features(text, self.bits)
            margins[k] = self.bias + table[np.unique(found[table[found] != 0])].sum()
        return 1 / (1 + np.exp(-np.clip(margins, -35, 35)))


def _train(rows: list[tuple[int, np.ndarray]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal; rows: (label, distinct coordinates). The bias is the last coordinate and has no L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at, shrink):
        x = z[at]
        return np.where(np.abs(x) <= shrink, 0.0, -(x - np.sign(x) * shrink) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, at in rows:
            w, b = weight(at, l1), weight(size, 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            for where, w0 in ((at, w), (size, b)):
                sigma = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / alpha
                z[where] += g - sigma * w0
                n[where] += g * g
    w = weight(np.arange(size), l1)
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept], float(weight(size, 0.0))


def _featured(bits: int):
    def run(batches):
        for batch in batches:
            found = [np.unique(features(t, bits)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "toxic", "found"])
        _forget()

    return run


def _fitted(bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """One task's rows, in the order of a hash, as training sees them."""

    def run(batches):
        rows = [(t, np.frombuffer(f, dtype=np.int32)) for b in batches for t, f in zip(b.column("toxic").to_pylist(), b.column("found").to_pylist())]
        if rows:
            kept, weights, bias = _train(rows, bits, epochs, alpha, beta, l1, l2)
            rows.clear()
            release()
            yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["kept", "weights", "bias"])

    return run


def _forget() -> None:
    """Empties the map of chunks at a task's end, for later stages run in the same worker."""
    _chunks.clear()
    release()


def in_training_folds(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is not 0; the rows where it is 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1) -> Model:
    """A model of docs (doc_id, text) with labels (doc_id, toxic), from the training folds alone."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training_folds(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return Model(np.zeros(0, dtype=np.int32), np.zeros(0), 0.0, 1.0 if n and positive == n else 0.0, bits)
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id").select("doc_id", "toxic", "text")
    found = rows.mapInArrow(_featured(bits), "doc_id long, toxic int, found binary")
    order = F.xxhash64("doc_id", F.lit(7))
    fitted = found.repartition(1).sortWithinPartitions(order, "doc_id", "found").mapInArrow(_fitted(bits, epochs, alpha, beta, l1, l2), "kept binary, weights binary, bias double").collect()
    if not fitted:
        return Model(np.zeros(0, dtype=np.int32), np.zeros(0), 0.0, 0.0, bits)
    return Model(np.frombuffer(fitted[0].kept, dtype=np.int32), np.frombuffer(fitted[0].weights), fitted[0].bias, None, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity_score) of each row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_scored_ids(model), "doc_id long, toxicity_score double")


def _scored_ids(model: Model):
    def run(batches):
        for batch in batches:
            scores = pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), scores], names=["doc_id", "toxicity_score"])
        _forget()

    return run


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < threshold))
        _forget()

    return docs.mapInArrow(run, docs.schema)
