"""Best-two-fit packing of documents into sequences of bounded length.

Texts become ids and an end id each; only documents longer than a sequence are cut, into pieces of full length and a
last one. Pieces are then packed: a bin is filled greedily, longest piece first; then its smallest piece gives way to
the two unpacked pieces that fill the expanded gap most tightly, if they fill it more tightly than that piece did.

There are at most ``capacity`` different lengths, whatever the number of documents. So the packing is planned on the
count of each length: what fills one bin fills the next one alike until some length runs out, and the plan is a list of
patterns with a multiplicity, as exact as if bins were filled one by one. Its size is bounded by ``capacity``, not by
the corpus. Pieces are then numbered within their length (by salted groups, so that a length that a third of all pieces
have is split) and each number is looked up in the plan.

Null texts count as empty: one piece with the end id alone. Rows with null or repeated doc_id are packed like others.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoder import encoder
from .memory import released
from .scratch import Scratch

#: Pieces that one salted group of a length should hold at most, about.
PER_GROUP = 200_000


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, lengths from the longest) of each pattern of best-two-fit over so many pieces of each length."""
    left = np.zeros(capacity + 1, dtype=object)
    left[:] = 0
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        left[length] += n
    some = np.array([bool(n) for n in left])
    below = np.maximum.accumulate(np.where(some, np.arange(capacity + 1), 0))  # longest length left, not above
    patterns: list[tuple[int, list[int]]] = []
    while below[capacity]:
        used: Counter[int] = Counter()
        items: list[int] = []

        def longest(limit: int) -> int:
            at = int(below[limit])
            while at and left[at] == used[at]:
                at = int(below[at - 1])
            return at

        gap = capacity
        while gap and (at := longest(gap)):
            items.append(at)
            used[at] += 1
            gap -= at
        if gap and len(items) > 1:
            smallest = items[-1]
            room = gap + smallest
            spare = np.array(some)
            for length, n in used.items():
                spare[length] = left[length] > n
            first = np.flatnonzero(spare[: room])  # the longer of the two
            if len(first):
                fits = np.maximum.accumulate(np.where(spare, np.arange(capacity + 1), 0))
                second = np.minimum(fits[room - first], fits[first])
                for k in np.flatnonzero(second == first):  # a pair of one length needs two pieces
                    length = int(first[k])
                    if left[length] - used[length] < 2:
                        second[k] = fits[length - 1]
                sums = np.where(second > 0, first + second, 0)
                best = int(sums.argmax())
                if sums[best] > smallest:
                    pair = [int(first[best]), int(second[best])]
                    used[smallest] -= 1
                    items = sorted([*items[:-1], *pair], reverse=True)
                    used.update(pair)
        used = +used
        times = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
            if not left[length]:
                some[length] = False
        if not all(some[length] for length in used):
            below = np.maximum.accumulate(np.where(some, np.arange(capacity + 1), 0))
        patterns.append((int(times), items))
    return patterns


def _slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Runs of pieces of one length, sorted: length, number of the first, its sequence, its offset."""
    runs, taken, sequence = [], Counter(), 0
    for times, items in patterns:
        offset = 0
        for length in items:
            runs.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            tokens, stops = enc.encoded(batch.column(1), end_id)
            tokens, sizes = tokens.astype("<u4"), np.diff(stops, prepend=0)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            at = ((stops - sizes)[doc] + start) * 4
            raw = memoryview(tokens).cast("B")
            parts = [raw[a:b] for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _placed(length, first, sequence, offset, schema_names):
    key = (length << 44) | first

    def run(batches):
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number = batch.column(batch.schema.get_field_index("number")).to_numpy()
            at = np.searchsorted(key, (size << 44) | number, side="right") - 1
            kept = [batch.column(batch.schema.get_field_index(name)) for name in schema_names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[at] + number - first[at], pa.int64()), pa.array(offset[at], pa.int64())], names=[*schema_names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, per_group: int = PER_GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of each piece of docs (doc_id, text).

    ``start`` is the piece's first id in its document, ``offset`` in its sequence; ``ids_crc32`` is that of its ids as
    little-endian unsigned 32-bit integers, which ``ids`` holds if asked for. The driver gets one count a length.
    """
    schema = _PIECES + (", ids binary" if with_ids else "")
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_cut(tokenizer, end_id, capacity, with_ids)), schema), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    groups = max(1, -(-max(counts.values(), default=0) // per_group), 16 if counts else 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["length", "salt"]).withColumn("number", F.col("before") + F.col("inside"))
    names = [c.split()[0] for c in schema.split(", ")]
    return numbered.select(*names, "number").mapInArrow(_placed(*_slots(plan_bins(counts, capacity)), names), f"{schema}, sequence_id long, offset long")


def _joined(key, rows):
    import pandas as pd

    rows = rows.sort_values("offset")
    return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [int(rows["length"].sum())], "doc_ids": [rows["doc_id"].tolist()], "ids": [b"".join(rows["ids"])]})


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids) of each sequence of ``pack_documents(..., with_ids=True)``; a group is
    one sequence, so at most ``capacity`` ids."""
    return packed.groupBy("sequence_id").applyInPandas(_joined, "sequence_id long, n_tokens long, doc_ids array<long>, ids binary")
