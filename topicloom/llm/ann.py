"""Nearest neighbours by multi-index hashing of learned binary codes.

Each vector has a code of several learned rotations' signs, cut into substrings of ``WIDTH`` bits, and each substring
has a table of buckets. The buckets within ``reach`` bits of a query's own substring are looked up in every table; by
the pigeonhole principle that retrieves every code within a Hamming radius of tables * (reach + 1) - 1 (and many beyond
it). Of the codes retrieved, those within the query's radius over the first ``FILTERED`` bits are ranked by cosine in
double precision on the original vectors. A query's radius is the least that holds ``depth`` codes, and never more than
one fitted to the data; all codes within it are ranked, however many lie on it.

Tables, reach and the greatest radius are fitted to the data: for ``CALIBRATED`` of the vectors the true neighbours among
all rows are computed, and the least reach, then the fewest tables, are taken that retrieve all but a fraction ``miss``.
Queries for which fewer than k rows are found are compared with all rows, in blocks, so every query gets k neighbours if
there are.

What is shuffled are codes, grouped by table and the first bits of the substring, in blocks of bounded size: a query goes
to the groups that hold buckets within its reach, not to all rows. Vectors are fetched for the pairs that passed the
radius alone. Equal vectors are one class and are searched once, however many they are.

Vectors that take no part (see ``itq``) give and get nothing; rows with a null id take none. Several rows of one id are
candidates of their own, but never of a query of the same id; as a query, an id with several vectors has each candidate
at its largest cosine. Vectors of one dimension are searched among themselves. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoder import spans
from .itq import BITS, Codec, by_dimension, learn, matrix, sampled, unit, vectors
from .runs import runs
from .scratch import Scratch

#: Bits of a substring; tables at most; bits of a code that the radius is measured on, at most.
WIDTH, TABLES, FILTERED = 16, 128, 384
#: Codes that a query's radius holds at least, if there are; those on it are all taken.
DEPTH = 200
#: Vectors whose true neighbours are computed, about; and vectors that rotations are learned on.
CALIBRATED, LEARNED = 256, 4_000
#: Codes, and queries, that are met at once, about; and rows of a block where queries are compared with all.
CODES, QUERIES, BLOCK = 131_072, 4_096, 16_384
_FOUND = "query_id long, vec_id long, score double"


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with that row of y, both unit vectors; the same for a pair wherever it stands."""
    return (x * y).sum(axis=1)


# --- codes -----------------------------------------------------------------------------------------------------------


class Tables:
    """A codec, and how its codes are cut and probed."""

    def __init__(self, codec: Codec, tables: int, reach: int, radius: int, depth: int):
        self.codec, self.tables, self.reach, self.radius, self.depth = codec, tables, reach, radius, depth
        self.masks = masks(WIDTH, reach)

    def cut(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors: substrings, a column a table, and what the radius is measured on, in words of 64 bits."""
        bits = signs(self.codec, x)
        return substrings(bits)[:, : self.tables], filtered(bits)


def masks(width: int, reach: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``reach`` of them set."""
    if reach * 2 >= width:
        every = np.arange(1 << width)
        return every[np.bitwise_count(every) <= reach].astype(np.uint32)
    return np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(width), n)], dtype=np.uint32)


def signs(codec: Codec, x: np.ndarray) -> np.ndarray:
    """The bits of all rotations side by side, filled up to whole substrings."""
    centred = x - codec.mean
    out = np.concatenate([centred @ r > 0 for r in codec.rotations], axis=1).astype(np.uint8)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % BITS)))


def substrings(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def filtered(bits: np.ndarray) -> np.ndarray:
    """At most FILTERED bits, always in as many words."""
    packed = np.packbits(bits[:, :FILTERED], axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, FILTERED // 8 - packed.shape[1]))).view("<u8")


def fitted(codec: Codec, queries: np.ndarray, found: np.ndarray, depth: int, miss: float) -> Tables:
    """The least reach, then the fewest tables, that find all but ``miss`` of the pairs of queries and neighbours."""
    own, other = signs(codec, unit(queries)), signs(codec, unit(found))
    apart = np.bitwise_count(substrings(own) ^ substrings(other))[:, :TABLES]
    distance = np.bitwise_count(filtered(own) ^ filtered(other)).sum(axis=1)
    radius = int(np.quantile(distance, 1 - miss / 6, method="higher")) if len(distance) else FILTERED
    best = np.minimum.accumulate(apart, axis=1)
    for reach in range(1, WIDTH + 1):
        share = ((best <= reach) & (distance <= radius)[:, None]).mean(axis=0) if len(best) else np.ones(apart.shape[1])
        enough = np.flatnonzero(share >= 1 - miss)
        if len(enough):
            break
    return Tables(codec, max(int(enough[0]) + 1, min(4, apart.shape[1])), reach, radius, depth)


# --- probing ---------------------------------------------------------------------------------------------------------

_ITEM = np.dtype([("sub", "<u2"), ("node", "<i8"), ("code", "<u8", FILTERED // 64)])


def _grouped(tables: Tables, dim: int, prefix: int, spread: bool):
    """A row for each table and prefix of a batch: (key, n, data), data holding its items. If ``spread``, items go to all
    prefixes within reach of their own."""
    near = masks(prefix, min(tables.reach, prefix)) if spread else np.zeros(1, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            subs, codes = tables.cut(unit(matrix(batch.column("vector"), dim)))
            items = np.empty(len(subs), dtype=_ITEM)
            items["node"], items["code"] = batch.column("node").to_numpy(), codes
            keys, sizes, data = [], [], []
            for t in range(tables.tables):
                items["sub"] = subs[:, t]
                group = ((subs[:, t].astype(np.uint32) >> (WIDTH - prefix))[:, None] ^ near[None, :]).ravel()
                of = np.repeat(np.arange(len(subs)), len(near))
                order = np.argsort(group, kind="stable")
                values, starts = np.unique(group[order], return_index=True)
                for value, part in zip(values.tolist(), np.split(of[order], starts[1:])):
                    keys.append((t << prefix) | value)
                    sizes.append(len(part))
                    data.append(items[part].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["key", "n", "data"])

    return run


def _counted(tables: Tables, dim: int, prefix: int, spread: bool):
    """(key, n) of ``_grouped``, without the items."""
    group = _grouped(tables, dim, prefix, spread)

    def run(batches):
        for batch in group(batches):
            yield batch.select(["key", "n"])

    return run


def _probed(tables: Tables, prefix: int):
    """Pairs (asked, node, apart) within each query's radius in a block (key, i, j), which is not less than its radius in all
    of them: queries have side 0, codes side 1."""
    at_once = max(1, 1_000_000 // len(tables.masks))
    low = WIDTH - prefix

    def run(batches):
        for block in runs(batches, 3):
            side = block.column("side").to_numpy()
            data = block.column("data").to_pylist()
            queries, codes = (np.frombuffer(b"".join([x for x, s in zip(data, side.tolist()) if s == which]), dtype=_ITEM) for which in (0, 1))
            if not len(queries) or not len(codes):
                continue
            table, group = divmod(block.column("key")[0].as_py(), 1 << prefix)
            codes = codes[np.argsort(codes["sub"], kind="stable")]
            starts = np.searchsorted(codes["sub"], (group << low) + np.arange((1 << low) + 1))  # of each bucket
            code, node = np.ascontiguousarray(codes["code"]), np.ascontiguousarray(codes["node"])
            for at in range(0, len(queries), at_once):
                part = queries[at : at + at_once]
                probes = part["sub"].astype(np.uint32)[:, None] ^ tables.masks[None, :]
                row, column = np.nonzero(probes >> low == group)
                bucket = probes[row, column] & ((1 << low) - 1)
                sizes = starts[bucket + 1] - starts[bucket]
                some = sizes > 0
                row, bucket, sizes = row[some], bucket[some], sizes[some]
                met, of = spans(starts[bucket], sizes), np.repeat(row, sizes)
                own, near = np.ascontiguousarray(part["code"]), np.zeros(len(met), dtype=np.uint16)
                for w in range(code.shape[1]):
                    near += np.bitwise_count(code[met, w] ^ own[of, w])
                kept = np.flatnonzero(near <= tables.radius)
                each = np.bitwise_count((code[met[kept]] ^ own[of[kept]]).view("<u2"))[:, :table]  # a pair is told by its first table
                kept = kept[~(each <= tables.reach).any(axis=1)]
                kept = kept[np.lexsort((near[kept], of[kept]))]
                of, met, near = of[kept], met[kept], near[kept]
                first = np.searchsorted(of, np.arange(len(part) + 1))
                last = np.minimum(first[:-1] + tables.depth, first[1:]) - 1  # of each query, the code that its radius ends at
                within = near <= near[last[of]] if len(of) else np.zeros(0, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(part["node"][of[within]]), pa.array(node[met[within]]), pa.array(near[within].astype(np.int32))], names=["asked", "node", "apart"])

    return run


def _ranked(dim: int):
    """Pairs with both vectors to (asked, node, score)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = cosines(unit(matrix(batch.column("own"), dim)), unit(matrix(batch.column("vector"), dim)))
                yield pa.RecordBatch.from_arrays([batch.column("asked"), batch.column("node"), pa.array(score)], names=["asked", "node", "score"])

    return run


def candidates(classes: DataFrame, n: int, tables: Tables, dim: int) -> DataFrame:
    """(asked, node): classes (node, asked, vector) that are within the radius of each of those asked, each pair once."""
    prefix = int(np.clip(np.ceil(np.log2(max(n, 1) / (CODES / 4))), 0, 12))
    rows, asked = classes.select("node", "vector"), classes.where("asked").select("node", "vector")

    def sizes(df, spread, each, name):
        found = df.mapInArrow(_counted(tables, dim, prefix, spread), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return found.select("key", F.ceil(F.col("n") / F.lit(each)).cast("int").alias(name))

    blocks = F.broadcast(sizes(asked, True, QUERIES, "n_i").join(sizes(rows, False, CODES, "n_j"), "key"))  # at most tables << 12 rows
    own = lambda n: F.pmod(F.xxhash64("data"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.mapInArrow(_grouped(tables, dim, prefix, True), "key long, n long, data binary").join(blocks, "key").select("key", own("n_i").alias("i"), each("n_j").alias("j"), F.lit(0).alias("side"), "data")
    right = rows.mapInArrow(_grouped(tables, dim, prefix, False), "key long, n long, data binary").join(blocks, "key").select("key", each("n_i").alias("i"), own("n_j").alias("j"), F.lit(1).alias("side"), "data")
    met = left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    met = met.mapInArrow(_probed(tables, prefix), "asked long, node long, apart int").distinct()
    nearest_first = Window.partitionBy("asked").orderBy("apart")
    return met.withColumn("rank", F.rank().over(nearest_first)).where(F.col("rank") <= tables.depth).select("asked", "node")


# --- queries against all rows ----------------------------------------------------------------------------------------


def _packed(batches):
    for batch in batches:
        if batch.num_rows:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(part.column("vector").to_pylist())], pa.binary())], names=["ids", "data"])


def _compared(dim: int, k: int):
    def run(batches):
        for block in runs(batches, 1):
            side = block.column("side").to_numpy()
            rows = block.filter(pa.array(side == 0))
            if not rows.num_rows:
                continue
            ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), dtype="<i8")
            raw = rows.column("data").to_pylist()
            x = unit(np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, dim))
            asked = block.filter(pa.array(side == 1))
            for q_ids, q_raw in zip(asked.column("ids").to_pylist(), asked.column("data").to_pylist()):
                q_ids, q = np.frombuffer(q_ids, dtype="<i8"), unit(np.frombuffer(q_raw, dtype="<f8").reshape(-1, dim))
                score = q @ x.T
                score[q_ids[:, None] == ids[None, :]] = -2
                least = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                row, column = np.nonzero((score >= np.maximum(least, -1.5)[:, None] - 1e-9) & (score > -1.5))
                exact = cosines(q[row], x[column])
                order = np.lexsort((ids[column], -exact, row))
                row, column, exact = row[order], column[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = place < k
                data = x[column[kept]].tobytes()
                each = [data[a : a + 8 * dim] for a in range(0, len(data), 8 * dim)]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[kept]]), pa.array(ids[column[kept]]), pa.array(exact[kept]), pa.array(each, pa.binary()), pa.array([q[r].tobytes() for r in row[kept]], pa.binary())], names=["query_id", "vec_id", "score", "vector", "own"])

    return run


def against_all(asked: DataFrame, rows: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, vector, own): the k nearest rows (vec_id, vector) of each block for each row of asked
    (vec_id, vector), both as unit vectors. A query set against all rows, in blocks of BLOCK."""
    blocks = max(1, -(-n // BLOCK))
    shape = "ids binary, data binary"
    left = rows.mapInArrow(_packed, shape).select(F.pmod(F.xxhash64("ids"), F.lit(blocks).cast("long")).alias("block"), F.lit(0).alias("side"), "ids", "data")
    right = asked.mapInArrow(_packed, shape).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("side"), "ids", "data")
    met = left.union(right).repartition("block").sortWithinPartitions("block", "side")
    return met.mapInArrow(_compared(dim, k), f"{_FOUND}, vector binary, own binary")


# --- the operator ----------------------------------------------------------------------------------------------------


def fit(rows: DataFrame, n: int, dim: int, k: int, depth: int, miss: float) -> Tables:
    """Rotations of a sample, and tables by the true neighbours of another, both of bounded size."""
    sample = sampled(rows, dim, LEARNED)
    bits = min(dim, BITS)
    codec = learn(sample, rotations=min(64, -(-TABLES * WIDTH // bits)), rounds=8)
    few = rows.where(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, CALIBRATED / n)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = against_all(few, rows, n, dim, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("own", "vector").collect()
    own, other = (np.frombuffer(b"".join(bytes(r[c]) for r in found), dtype="<f8").reshape(-1, dim) for c in ("own", "vector"))
    return fitted(codec, own, other, depth, miss)


def _classed(batches):
    for batch in batches:
        same = [xxhash.xxh3_128_digest(x) for x in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.binary())], names=[*batch.schema.names, "same"])


def nearest(table: DataFrame, is_query, k: int = 5, depth: int = DEPTH, miss: float = 0.05) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of table (vec_id, embedding) that is_query,
    a condition on vec_id, picks, among all rows but its own; nearest first, ties to the smaller vec_id."""
    scratch = Scratch(table.sparkSession, "ann")
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    sound = scratch.stage(vectors(table, F.coalesce(is_query, F.lit(False)).alias("asked")), "vectors", "none")
    found = table.sparkSession.createDataFrame([], _FOUND)
    for dim, rows in by_dimension(sound):
        found = found.union(_found(rows, dim, k, max(depth, 4 * k), miss, Scratch(table.sparkSession, f"ann-{dim}")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(rows: DataFrame, dim: int, k: int, depth: int, miss: float, scratch: Scratch) -> DataFrame:
    """(query_id, vec_id, score) of the rows found for each query, at least k if there are, among vectors of one
    dimension."""
    n = rows.count()
    tables = fit(rows, n, dim, k, depth, miss)
    marked = rows.mapInArrow(_classed, "vec_id long, asked boolean, vector binary, same binary")
    classes = marked.groupBy("same").agg(F.max("asked").alias("asked"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.stage(classes, "classes", "none")
    pairs = scratch.stage(candidates(classes, n, tables, dim), "pairs")
    of = classes.select("node", "vector")
    scored = pairs.join(of, "node").join(of.select(F.col("node").alias("asked"), F.col("vector").alias("own")), "asked")
    scored = scored.select("asked", "node", "own", "vector").mapInArrow(_ranked(dim), "asked long, node long, score double")

    members = marked.groupBy("same", "vec_id").agg(F.count("*").alias("copies"), F.max("asked").alias("is_asked")).join(classes.select("same", "node"), "same").select("node", "vec_id", "copies", "is_asked")
    members = scratch.stage(members, "members")
    first = Window.partitionBy("node").orderBy("vec_id")  # of a class, a query needs k rows beside its own at most
    few = members.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select("node", "vec_id", F.least("copies", F.lit(k)).cast("int").alias("copies"))
    queries = members.where("is_asked").select(F.col("node").alias("asked"), F.col("vec_id").alias("query_id"))
    found = scored.join(few, "node").join(queries, "asked").where("query_id <> vec_id")
    found = found.groupBy("query_id", "vec_id", "node").agg(F.max("score").alias("score"), F.first("copies").alias("copies"))
    found = scratch.stage(found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy"), "found")

    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    lacking = scratch.stage(rows.where("asked").join(enough, "vec_id", "left_anti").select("vec_id", "vector").distinct(), "lacking", "none")
    if lacking.isEmpty():
        return found
    exact = against_all(lacking, rows.select("vec_id", "vector"), n, dim, k).select("query_id", "vec_id", "score")
    return found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").union(exact)
