"""Shards of fixed capacity by best-fit-decreasing bin packing of indivisible groups.

A group is all rows of one text (null counts as the empty text); it goes to one shard whole. A row's size is the UTF-8
bytes of its text plus 1. Groups, largest first, enter the shard with the least remaining capacity that still holds
them, found in a balanced tree of remaining capacities; ties go to the smaller shard number, groups of one size go by
the MD5 of their text.

Packing is done on how many groups there are of each size. What enters the tightest shard leaves it the tightest, so all
groups of a size that still fit enter it in one step, and the plan is that of placing group by group. Sizes that differ
add up to all bytes at most, so there are fewer than the square root of twice the bytes: that bounds what the driver
holds (245,000 sizes of 30 GB, 14 million of 100 TB, in the worst case). Groups are then numbered within their size, in
parts by their hash, and each number is looked up in the plan.

With ``capacity`` as many shards are opened as are needed, none over its capacity unless a single group is; with
``shards`` their number is fixed, capacity is an equal share, and what fits nowhere goes where most room is left.

Null and repeated doc_ids are rows like others. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, ranges
from .scratch import Scratch

#: A text that more than one in so many rows have is placed by a broadcast: there are fewer texts of that kind.
FREQUENT = 4096
#: Ranges of doc_ids that a shard is numbered in.
RANGES = 128


class CapacityTree:
    """A treap of (remaining capacity, shard): least sufficient and greatest remaining capacity in logarithmic time."""

    def __init__(self):
        self.left, self.right, self.key, self.rank = [0], [0], [(0, 0)], [-1]
        self.root, self.state = 0, 0x2545F491

    def _merge(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def _split(self, t: int, key: tuple[int, int]) -> tuple[int, int]:
        """Keys under ``key``, and the others."""
        if not t:
            return 0, 0
        if self.key[t] < key:
            self.right[t], b = self._split(self.right[t], key)
            return t, b
        a, self.left[t] = self._split(self.left[t], key)
        return a, t

    def add(self, remaining: int, shard: int) -> None:
        self.state = (self.state * 1103515245 + 12345) & 0x7FFFFFFF
        for x, value in ((self.left, 0), (self.right, 0), (self.key, (remaining, shard)), (self.rank, self.state)):
            x.append(value)
        a, b = self._split(self.root, (remaining, shard))
        self.root = self._merge(self._merge(a, len(self.key) - 1), b)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the least (remaining, shard) with remaining >= least."""
        a, b = self._split(self.root, (least, -1))
        if not b:
            self.root = a
            return None
        t = b
        while self.left[t]:
            t = self.left[t]
        found = self.key[t]
        _, rest = self._split(b, (found[0], found[1] + 1))
        self.root = self._merge(a, rest)
        return found

    def take_most(self) -> tuple[int, int] | None:
        """Removes and returns the smallest shard of those with the greatest remaining capacity."""
        t = self.root
        if not t:
            return None
        while self.right[t]:
            t = self.right[t]
        return self.take(self.key[t][0])


def best_fit_decreasing(sizes: list[int], counts: list[int], capacity: int, shards: int | None = None) -> list[tuple[int, int, int]]:
    """Runs (size, number of the first, shard) of ``counts`` items of each of ``sizes``, which differ. With ``shards`` that
    many are there from the start and no other is opened."""
    tree, runs = CapacityTree(), []
    opened = shards or 0
    for s in range(opened):
        tree.add(capacity, s)
    for size, n in sorted(zip(sizes, counts), reverse=True):
        first = 0
        while first < n:
            found = tree.take(size)
            if found:
                times = found[0] // size
            elif shards:
                found, times = tree.take_most(), 1
            else:
                found, opened, times = (max(capacity, size), opened), opened + 1, max(1, capacity // size)
            times = min(times, n - first)
            runs.append((size, first, found[1]))
            tree.add(found[0] - times * size, found[1])
            first += times
    return runs


def _placed(runs: list[tuple[int, int, int]]):
    """Of (text_key, rows, size, number): the shard of each group."""
    size, first, shard = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3).T
    sizes = np.unique(size)
    stride = int(first.max(initial=0)) + 1  # numbers of all sizes in one ascending line
    line = np.searchsorted(sizes, size) * stride + first

    def run(batches):
        for batch in batches:
            own, number = batch.column("size").to_numpy(), np.minimum(batch.column("number").to_numpy(), stride - 1)
            at = np.searchsorted(line, np.searchsorted(sizes, own) * stride + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("rows"), pa.array(shard[at], pa.int32())], names=["text_key", "rows", "shard"])

    return run


def shard_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of docs (doc_id, text); slot counts from 0 in its shard, by
    doc_id, then text_crc32.

    Texts are read once: ids, sizes and 128-bit hashes of texts are written and worked on. A text that many rows have
    isn't shuffled by its hash.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    rows = scratch.stage(rows, "rows")
    groups = scratch.stage(rows.groupBy("text_key").agg(F.count("*").alias("rows"), F.sum("size").alias("size")), "groups")
    counts = groups.groupBy("size").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).toArrow().to_pydict()
    total, n = sum(s * c for s, c in zip(counts["size"], counts["n"])), sum(counts["rows"])
    limit = capacity if capacity is not None else -(-total // shards)
    plan = best_fit_decreasing(counts["size"], counts["n"], limit, shards)
    parts = groups.withColumn("part", F.substring("text_key", 1, 1))
    placed = numbered(parts, "size", ["part"], ["text_key"], "number").select("text_key", "rows", "size", "number")
    placed = scratch.stage(placed.mapInArrow(_placed(plan), "text_key binary, rows long, shard int"), "placed")
    frequent = placed.where(F.col("rows") * FREQUENT > n).select("text_key", "shard")  # fewer than FREQUENT
    marked = rows.join(F.broadcast(frequent), "text_key", "left")
    kept = ["doc_id", "size", "text_crc32", "shard"]
    found = marked.where("shard IS NOT NULL").select(*kept).union(marked.where("shard IS NULL").drop("shard").join(placed, "text_key").select(*kept))
    found = scratch.stage(found, "found")
    scratch.drop("rows", "groups", "placed")
    found = found.withColumn("part", ranges(found, "doc_id", RANGES)).withColumn("hash", F.when(F.col("part") % 2 != 0, F.shiftright("text_crc32", 24)).otherwise(0))
    return numbered(found, "shard", ["part", "hash"], [F.asc_nulls_first("doc_id"), "text_crc32", "size"], "slot").select(*kept, "slot")
