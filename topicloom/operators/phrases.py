"""Keyphrases without a service: candidates between stop words, ranked by likeness to the text and unlikeness to each other."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.vectors import hashed_vector, hashed_vectors

TOP, DIVERSITY, WORDS = 15, 0.5, 4
_PART = re.compile(r"[^\w\s'\-]+")
_WORD = re.compile(r"[^\W\d_][\w'\-]*")


def english_stoplist(domain: DataFrame) -> DataFrame:
    """(word): the English stop words that come with Spark, and those of domain, each once."""
    english = [(w,) for w in StopWordsRemover.loadDefaultStopWords("english")]
    return domain.sparkSession.createDataFrame(english, "word string").union(domain.select(F.col(domain.columns[0]))).distinct()


def candidates(text: str, stop: frozenset[str], words: int = WORDS) -> list[str]:
    """Runs of words, in lower case, that neither a stop word nor punctuation parts; of longer runs, all parts of
    ``words`` words. In the order of the text, each once."""
    found: dict[str, None] = {}
    for part in _PART.split(text.lower()):
        run: list[str] = []
        for word in [*_WORD.findall(part), ""]:
            if word and word not in stop:
                run.append(word)
                continue
            for k in range(max(1, len(run) - words + 1) if run else 0):
                found[" ".join(run[k : k + words])] = None
            run = []
    return list(found)


def marginal(own: np.ndarray, vectors: np.ndarray, k: int = TOP, diversity: float = DIVERSITY) -> list[int]:
    """Places of k vectors by maximal marginal relevance: the one nearest to own first, then each with the greatest
    (1 - diversity) * nearness to own - diversity * greatest nearness to one chosen. Ties go to the first."""
    if not len(vectors):
        return []
    near, most = vectors @ own, np.full(len(vectors), -np.inf)
    chosen = [int(near.argmax())]
    while len(chosen) < min(k, len(vectors)):
        most = np.maximum(most, vectors @ vectors[chosen[-1]])
        worth = (1 - diversity) * near - diversity * most
        worth[chosen] = -np.inf
        chosen.append(int(worth.argmax()))
    return chosen


def marginal_keyphrases(records: DataFrame, stop: list[str], k: int = TOP, diversity: float = DIVERSITY, embed=hashed_vector) -> DataFrame:
    """(id, pos, text, score) of each record (id, abstract): its k keyphrases by ``marginal``, their nearness to the
    abstract as score. A null or empty abstract, or one of stop words alone, has none."""
    words = frozenset(stop)
    all_of = hashed_vectors if embed is hashed_vector else lambda texts: np.stack([embed(t) for t in texts])

    def run(batches):
        for batch in batches:
            ids, places, texts, scores = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = candidates(text or "", words)
                if not found:
                    continue
                vectors = all_of([text, *found])
                own, each = vectors[0], vectors[1:]
                near = each @ own
                for place, at in enumerate(marginal(own, each, k, diversity), 1):
                    ids.append(i)
                    places.append(place)
                    texts.append(found[at])
                    scores.append(round(float(near[at]), 4))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(places, pa.int32()), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], names=["id", "pos", "text", "score"])

    return records.select(F.col("id").cast("string"), "abstract").mapInArrow(run, "id string, pos int, text string, score double")
