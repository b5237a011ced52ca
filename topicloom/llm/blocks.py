"""Rows of a group beside each other in blocks of bounded size, and what leaves a block: links along its components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.sources.staging import small

from .scratch import Scratch


def stars(adjacent: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node with the least node of its component in a block of rows and columns."""
    label_r, label_c = rows.copy(), columns.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_c = np.minimum(label_c, np.where(adjacent, label_r[:, None], top).min(axis=0))
        new_r = np.minimum(label_r, np.where(adjacent, new_c[None, :], top).min(axis=1))
        if (new_r == label_r).all() and (new_c == label_c).all():
            break
        label_r, label_c = new_r, new_c
    nodes, labels = np.concatenate([rows, columns]), np.concatenate([label_r, label_c])
    kept = nodes != labels
    return nodes[kept], labels[kept]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, least place of its component) that join what the links a - b between n places join."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def paired(rest: DataFrame, all_: DataFrame, key: str, columns: list[str], number: Column, scratch: Scratch, name: str) -> DataFrame:
    """Each row of rest beside each row of all_ with its key, in blocks (key, i, j): rows of rest carry side 0, those of
    all_ side 1. Both have key, node and columns; ``number`` is an aggregate, how many blocks a key's rows are dealt to."""
    size = lambda df, n: df.groupBy(key).agg(number.cast("int").alias(n))
    sizes = small(scratch.stage(size(rest, "n_i").join(size(all_, "n_j"), key), f"{name}-sizes"))  # one row a key
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.join(sizes, key).select(key, block("n_i").alias("i"), each("n_j").alias("j"), F.lit(0).alias("side"), "node", *columns)
    right = all_.join(sizes, key).select(key, each("n_i").alias("i"), block("n_j").alias("j"), F.lit(1).alias("side"), "node", *columns)
    return left.union(right).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "side", "node")
