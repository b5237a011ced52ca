"""Near-duplicate vectors: learned binary codes, multi-index Hamming tables, links confirmed on the vectors.

Two rotations (see ``itq``) give each vector two codes of 64 bits. Each code is cut into substrings of 16 bits, and each
substring enters its table once for every pair of its bits, with that pair masked out: codes that differ in one bit of
a substring, or in two of a masked pair, meet under a key. Two vectors with a cosine of 0.95 miss each other in all 64
keys about once in 300 times; nearer ones far less. Signs are taken about the origin, for about the mean the angle of a
pair grows with what all vectors share. Where they share much, codes are alike and groups large.

Equal vectors are a class and stand for each other, with their number. Classes that meet and whose codes are within
``radius`` of each other belong to one group; a key under which few classes stand compares them all, a key under which
many stand compares them with its least class, and those far from that with all others of the key, in blocks of bounded
size. In a group all classes are compared by cosine in double precision, in blocks of bounded size, and what leaves a
block is one count for each class and links along the block's components. So no pairs are written out, and no task
holds a key or a group whole. The links counted are exact within groups; counting them takes all pairs of a group's
classes, which is what a number of links for every vector is.

Vectors of each dimension are compared among themselves; links of all dimensions make the components. A vec_id with
vectors of several dimensions has the sum of their links, so one that it is linked with in two counts twice.

Vectors that take no part (see ``itq``) have no links and are components of their own. Rows without a vec_id have
no links, no component, and are kept. Rows of one vec_id are one node: its links are those of all its vectors, except
with each other. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.sources.staging import small

from .blocks import paired, spanning, stars
from .components import components
from .itq import BITS, by_dimension, learn, matrix, sampled, unit, vectors
from .runs import runs
from .scratch import Scratch

ROTATIONS, TABLES, WIDTH, MASKED = 2, 4, 16, 2
#: Hamming distance over both codes (128 bits) up to which classes may be linked: beyond four deviations of the distance
#: at a cosine of 0.95 (13 bits, give or take 3.4).
RADIUS = 30
#: Classes under a key that are compared with each other at once; and classes of a block.
FEW, BLOCK = 64, 1024


def _coded(codec, dim: int):
    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            codes = codec.codes(unit(matrix(batch.column(1), dim))).astype("<u8").view("<i8") if batch.num_rows else np.zeros((0, ROTATIONS), dtype="<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(codes[:, 0], pa.int64()), pa.array(codes[:, 1], pa.int64()), batch.column(1)], names=["vec_id", "same", "c0", "c1", "vector"])

    return run


def _keys() -> F.Column:
    """A key for each rotation, table and masked pair: the substring without the pair, and which of them it is."""
    found = []
    for r in range(ROTATIONS):
        for t in range(TABLES):
            part = F.shiftrightunsigned(F.col(f"c{r}"), WIDTH * t).bitwiseAND(F.lit((1 << WIDTH) - 1))
            for g in range(WIDTH // MASKED):
                kept = ((1 << WIDTH) - 1) ^ (((1 << MASKED) - 1) << (MASKED * g))
                number = (r * TABLES + t) * (WIDTH // MASKED) + g
                found.append(part.bitwiseAND(F.lit(kept)) + F.lit(number << WIDTH))
    return F.array(*found)


def _window(radius: int):
    """Of (key, node, c0, c1), sorted: links that join what near classes, up to FEW places apart under a key, join, and a
    row (node, null, key) for each class under a key with more than FEW. Only the last FEW rows are carried from one batch to the next."""

    def run(batches):
        carried = None

        def compared(key, node, c0, c1, fresh):
            a, b = [], []
            for d in range(1, min(FEW, len(key) - 1) + 1):
                late = np.arange(max(fresh, d), len(key))
                late = late[key[late] == key[late - d]]
                late = late[np.bitwise_count(c0[late] ^ c0[late - d]).astype(np.int16) + np.bitwise_count(c1[late] ^ c1[late - d]) <= radius]
                a.append(late)
                b.append(late - d)
            if not a:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            at, least = spanning(len(key), np.concatenate(a), np.concatenate(b))
            return node[at], node[least]

        def crowded(key, until):
            """Of the first ``until`` rows: those with a row of the same key FEW places before or after."""
            mark = np.zeros(len(key), dtype=bool)
            if len(key) > FEW:
                same = key[FEW:] == key[:-FEW]
                mark[FEW:] |= same
                mark[:-FEW] |= same
            return mark[:until]

        def made(a, b, many_nodes, many_keys):
            none = pa.nulls(len(many_nodes), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, many_nodes]), pa.int64()), pa.concat_arrays([pa.array(b, pa.int64()), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(many_keys, pa.int64())])], names=["a", "b", "key"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(4)]
            fresh = before = 0
            if carried is not None:
                fresh, before, now = len(carried[0]), carried[4], [np.concatenate([x, y]) for x, y in zip(carried, now)]
            key, node, c0, c1 = now
            a, b = compared(key, node, c0.view(np.uint64), c1.view(np.uint64), fresh)
            until = max(before, len(key) - FEW)  # what follows the last rows isn't known yet
            mark = crowded(key, until)
            mark[:before] = False  # told with an earlier batch
            at = np.flatnonzero(mark)
            yield made(a, b, node[at], key[at])
            start = max(0, len(key) - 2 * FEW)
            carried = [key[start:], node[start:], c0[start:], c1[start:], until - start]
        if carried is not None:
            key, node, _, _, before = carried
            mark = crowded(key, len(key))
            mark[:before] = False
            at = np.flatnonzero(mark)
            none = np.zeros(0, np.int64)
            yield made(none, none, node[at], key[at])

    return run


def _near_blocks(radius: int):
    def run(batches):
        for table in runs(batches, 3):
            side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
            c0, c1 = (table.column(k).to_numpy().view(np.uint64) for k in ("c0", "c1"))
            r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = np.bitwise_count(c0[r][:, None] ^ c0[c][None, :]).astype(np.int16) + np.bitwise_count(c1[r][:, None] ^ c1[c][None, :]) <= radius
            a, b = stars(near, node[r], node[c])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _counted(threshold: float, dim: int):
    """Of blocks of groups: (node, links, b): the number of vectors linked with a class, and links of the block's
    components, with 0 links."""

    def run(batches):
        for table in runs(batches, 3):
            side, node, copies = (table.column(k).to_numpy() for k in ("side", "node", "copies"))
            x = unit(matrix(table.column("vector"), dim))
            r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(r) or not len(c):
                continue
            linked = (x[r] @ x[c].T >= threshold) & (node[r][:, None] != node[c][None, :])
            n = linked @ copies[c]
            a, b = stars(linked, node[r], node[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[r], a]), pa.int64()), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]), pa.int64()), pa.concat_arrays([pa.nulls(len(r), pa.int64()), pa.array(b, pa.int64())])], names=["node", "links", "b"])

    return run


def near_duplicates(table: DataFrame, threshold: float = 0.95, radius: int | None = RADIUS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of table (vec_id, embedding): vectors linked directly by a cosine
    of at least threshold, the least vec_id reachable by links, and whether that is the row's own."""
    scratch = Scratch(table.sparkSession, "vectors")
    radius = ROTATIONS * BITS if radius is None else radius  # without one, all that meet are compared
    sound = scratch.stage(vectors(table), "sound", "none")
    ids = table.select(F.col("vec_id").cast("long").alias("vec_id"))
    parts = [_linked(rows, dim, threshold, radius, Scratch(table.sparkSession, f"vectors-{dim}")) for dim, rows in by_dimension(sound)]
    if not parts:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows, links = (reduce(DataFrame.union, part) for part in zip(*parts))
    if len(parts) > 1:  # vec_ids of several dimensions link what their vectors stand for
        rows = scratch.stage(rows, "rows")
        several = rows.groupBy("vec_id").agg(F.count_distinct("dim").alias("dims")).where("dims > 1").select("vec_id")
        links = links.union(rows.join(several, "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    found = scratch.stage(components(links, scratch, "links"), "components")
    of = rows.join(found, "node", "left").groupBy("vec_id", "dim").agg(F.max("links").alias("links"), F.min(F.coalesce("component", "node")).alias("component"))
    if len(parts) > 1:
        of = of.groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = ids.join(of.select("vec_id", "links", "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _linked(sound: DataFrame, dim: int, threshold: float, radius: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of vectors of one dimension: (vec_id, dim, links, node) of each, node being the class it is of; and links (a, b)
    that make their components."""
    sample = sampled(sound, dim)
    codec = learn(sample, ROTATIONS, centred=False)
    coded = scratch.stage(sound.mapInArrow(_coded(codec, dim), "vec_id long, same binary, c0 long, c1 long, vector binary"), "coded", "none")
    classes = coded.groupBy("same").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"), *[F.first(c).alias(c) for c in ("c0", "c1", "vector")])
    classes = scratch.stage(classes, "classes", "none")

    keys = classes.select(F.explode(_keys()).alias("key"), "node", "c0", "c1")
    met = scratch.stage(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_window(radius), "a long, b long, key long"), "met")
    own = classes.select("node", "c0", "c1")
    crowd = met.where("key IS NOT NULL").select("key", F.col("a").alias("node"))
    hubs = scratch.stage(crowd.groupBy("key").agg(F.min("node").alias("hub")), "hubs")
    crowd = crowd.join(small(hubs), "key").where("node <> hub").join(own, "node").join(own.select(F.col("node").alias("hub"), F.col("c0").alias("h0"), F.col("c1").alias("h1")), "hub")
    apart = F.expr("bit_count(c0 ^ h0) + bit_count(c1 ^ h1)")
    crowd = scratch.stage(crowd.select("key", "node", "hub", "c0", "c1", (apart <= radius).alias("near")), "crowd")
    far = crowd.where("NOT near").select("key", "node", "c0", "c1")
    beside = crowd.join(far.select("key").distinct(), "key", "left_semi").select("key", "node", "c0", "c1")
    blocks = F.ceil(F.count("*") / F.lit(BLOCK))
    late = paired(far, beside, "key", ["c0", "c1"], blocks, scratch, "far").mapInArrow(_near_blocks(radius), "a long, b long")
    edges = met.where("key IS NULL").select("a", "b").union(crowd.where("near").select("node", "hub")).union(late)
    groups = components(edges, scratch, "groups").select(F.col("component").alias("grp"), "node")
    groups = scratch.stage(groups.join(classes.select("node", "copies", "vector"), "node").select("grp", "node", "copies", "vector"), "grouped", "none")
    counts = scratch.stage(paired(groups, groups, "grp", ["copies", "vector"], blocks, scratch, "groups").mapInArrow(_counted(threshold, dim), "node long, links long, b long"), "counts")
    links = counts.where("b IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").select("same", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    rows = coded.select("vec_id", "same").join(named, "same").select("vec_id", F.lit(dim).alias("dim"), "links", "node")
    return rows, counts.where("b IS NOT NULL").select(F.col("node").alias("a"), "b")
