"""Small tables with the cases that every operator has to bear."""

import random

from pyspark.sql import types as T

#: Columns whose names the operators use inside.
CLASHING = ("n", "key", "grp", "row", "d", "th", "q", "w", "part", "salt", "size", "shard", "node", "kept", "ids", "score", "_gone")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])

ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "\n\n\n",
    "one",
    "Tab\tand\r\nCRLF line\rlone CR \x0b\x0c",
    "Ünïcödé façade — “quotes” ’s don’t 日本語のテキスト 한국어 مرحبا 😀👩‍👩‍👧 é",
    "don't we'll I'm THEY'VE it's <|endoftext|> <|startoftext|> 12345 3.14 ½ ²",
    "a b c​d﻿ \u0000 \x1c\x1d end",
    "İstanbul ǅ ß ſ Σίσυφος ΣΑΣ",
    "x" * 5000,
    "!?" * 700,
]


def odd_rows(seed: int = 1, long_words: int = 30_000):
    """(doc_id, text) with nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(400)]
    rows = [(10 * k, t) for k, t in enumerate(ODD_TEXTS)]
    rows.append((None, "a row without an id that has some words in it"))
    rows.append((None, None))
    rows.append((7, " ".join(rng.choices(vocabulary, k=long_words))))
    base = " ".join(rng.choices(vocabulary, k=120))
    rows += [(1000 + k, base) for k in range(5)]
    rows += [(1000, base), (40, "one")]  # repeated rows
    for k in range(20):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1100 + k, " ".join(words)))
    for k in range(40):
        rows.append((2000 + k, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6)))))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *(c.upper() for c in CLASHING)) for i, t in rows], DOCS)
