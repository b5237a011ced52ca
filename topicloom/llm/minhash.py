"""Near-duplicate documents by SetSketch registers, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Its sketch has M registers; a register is
the exponent, to base B, of the least hash of the set under its own hash function, in one byte. Registers merge by
maximum, and equal ones are the likelier the more two sets share, so groups of ROWS registers serve as band keys. From
how many registers of two sketches are greater, less and equal, and from the sets' known sizes, the likelihood of a
similarity follows; pairs for which the wanted similarity is too unlikely (e**-margin of the best) are no candidates; without a margin, all
pairs that share a band are.

Documents with one set are a class and stand for each other. The work then follows classes:

1. each class meets the least class (hub) of each of its bands; likely pairs are near;
2. classes that are not near a hub meet all others of that band, in blocks of bounded size; near pairs join groups;
3. in each group all classes are compared with the group's hub on full sets; those that are not linked to it are
   compared on full sets with all of the group, in blocks of bounded size;
4. links make components.

So no pairs within a hot band or group are written out, no task holds a whole one, and no link is given up: what a
hub does not settle is compared with everything in its group. A pair with a similarity at the threshold shares no band
with a probability of (1 - T**ROWS)**BANDS, which is 1 in 80,000 at T = 0.85, and less above it.

Texts are lower-cased in A to Z; words are what ASCII white space parts. Fewer than five words make one shingle. Null
and empty texts, and texts without words, have an empty set and link with nothing. Rows without a doc_id link with
nothing and are kept. Rows with one doc_id count as one document in links. Other columns are not read by
``near_duplicates``; ``drop_near_duplicates`` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.sources.staging import small

from .blocks import paired, stars
from .components import components
from .hot import join_hot
from .memory import released
from .runs import runs
from .scratch import Scratch

WORDS = 5
BANDS, ROWS = 24, 6
M = BANDS * ROWS
B = 1.2
#: Natural logarithm of the likelihood ratio beyond which a pair is given up.
MARGIN = 12.0
#: Classes of a block, and elements of the sets in one, about.
BLOCK, ELEMENTS = 512, 2_000_000
#: Bytes of sets that are handed on at once.
_AT_ONCE = 16_000_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, M, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    digest = xxhash.xxh3_64_digest
    h = np.frombuffer(b"".join([digest(w) for w in words]), dtype="<u8")
    n = len(h) - WORDS + 1
    with np.errstate(over="ignore"):
        s = sum((h[k : k + n] ^ (h[k : k + n] >> np.uint64(29 + k))) * _MIX[k] for k in range(WORDS))
        s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ (s >> np.uint64(27)))


def registers(found: np.ndarray) -> bytes:
    """One byte for each register of a set that isn't empty."""
    least = np.full(M, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 1024):
            np.minimum(least, (found[None, at : at + 1024] * _FACTORS[:, None]).min(axis=1), out=least)
    u = (least.astype(np.float64) + 1.0) * 2.0**-64
    wait = -np.log1p(-np.minimum(u, 1 - 2.0**-53))  # of exponentially spaced minima
    return np.clip(np.floor(24 - np.log(wait) / np.log(B)), 0, 255).astype(np.uint8).tobytes()


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, margin: float | None = MARGIN) -> np.ndarray:
    """Whether sets of n_a and n_b elements with registers a and b (a row each) may have the threshold's similarity;
    without a margin, all whose sizes allow it may.

    The joint likelihood of the similarity is that of the numbers of greater, less and equal registers.
    """
    a, b = a.astype(np.int16), b.astype(np.int16)
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    same = a.shape[-1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(u, v)
    if margin is None:
        return most >= threshold - 1e-9
    best, wanted = np.full(more.shape, -np.inf), np.full(more.shape, -np.inf)
    for j in np.linspace(0, 1, 41):
        j = np.minimum(j, most)
        p, q = _p(u - v * j), _p(v - u * j)
        tiny = 1e-9
        score = more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, tiny))
        best = np.maximum(best, score)
        wanted = np.maximum(wanted, np.where(j >= threshold - 1e-9, score, -np.inf))
    return (most >= threshold - 1e-9) & (wanted >= best - margin)


# --- stages ----------------------------------------------------------------------------------------------------------


def _sketched(batches):
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        regs = [registers(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "regs"])


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _near_hub(threshold: float, margin: float | None):
    """Of pairs (node, hub, n, regs, hub_n, hub_regs): whether they are near."""

    def run(batches):
        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            near = likely(_bytes(c["regs"], M), _bytes(c["hub_regs"], M), c["n"].to_numpy(), c["hub_n"].to_numpy(), threshold, margin) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([c["node"], c["hub"], pa.array(near, pa.bool_())], names=["node", "hub", "near"])

    return run


def _edges(parts) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in parts]) if parts else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near_blocks(threshold: float, margin: float | None):
    def run(batches):
        parts = []
        for table in runs(batches, 3):
            side, nodes, n = (table.column(k).to_numpy() for k in ("side", "node", "n"))
            regs = _bytes(table.column("regs"), M)
            r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(r) or not len(c):
                continue
            adjacent = np.stack([likely(np.broadcast_to(regs[k], (len(c), M)), regs[c], np.full(len(c), n[k]), n[c], threshold, margin) for k in r])
            parts.append(stars(adjacent, nodes[r], nodes[c]))
            if len(parts) >= 1000:
                yield _edges(parts)
                parts = []
        yield _edges(parts)

    return run


def _full_sets(batches):
    def made(rows):
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["grp", "node", "n", "found"])

    for batch in batches:
        rows, size = [], 0
        for grp, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = shingles(text.as_py()).tobytes()
            rows.append((grp, node, len(found) // 8, found))
            size += len(found)
            if size > _AT_ONCE:
                yield made(rows)
                rows, size = [], 0
        yield made(rows)


def _shared(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of rows with each of columns, on the elements that both sides have."""
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    left, left_of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    right, right_of = np.concatenate(columns), np.repeat(np.arange(len(columns)), [len(x) for x in columns])
    both = np.intersect1d(left, right)
    if not len(both):
        return out
    at_l, at_r = np.minimum(np.searchsorted(both, left), len(both) - 1), np.minimum(np.searchsorted(both, right), len(both) - 1)
    ok_l, ok_r = both[at_l] == left, both[at_r] == right
    at_l, left_of, at_r, right_of = at_l[ok_l], left_of[ok_l], at_r[ok_r], right_of[ok_r]
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    at_l, left_of, at_r, right_of = at_l[order_l], left_of[order_l], at_r[order_r], right_of[order_r]
    width = 4096
    for start in range(0, len(both), width):
        (a, b), (c, d) = np.searchsorted(at_l, (start, start + width)), np.searchsorted(at_r, (start, start + width))
        x, y = np.zeros((len(rows), width), dtype=np.float32), np.zeros((len(columns), width), dtype=np.float32)
        x[left_of[a:b], at_l[a:b] - start] = 1
        y[right_of[c:d], at_r[c:d] - start] = 1
        out += x @ y.T
    return out


def _linked(shared, n_a, n_b, percent: int) -> np.ndarray:
    shared = np.rint(shared).astype(np.int64)
    return 100 * shared >= percent * (n_a + n_b - shared)


def _hub_links(percent: int):
    """Of (grp, node, n, found, hub_n, hub_found): whether the node is linked to its group's hub."""

    def run(batches):
        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            n, hub_n, linked = c["n"].to_numpy(), c["hub_n"].to_numpy(), []
            for k, (own, hub) in enumerate(zip(c["found"].to_pylist(), c["hub_found"].to_pylist())):
                shared = len(np.intersect1d(np.frombuffer(own, dtype=np.uint64), np.frombuffer(hub, dtype=np.uint64), assume_unique=True))
                linked.append(100 * shared >= percent * (int(n[k]) + int(hub_n[k]) - shared))
            yield pa.RecordBatch.from_arrays([c["grp"], c["node"], pa.array(linked, pa.bool_())], names=["grp", "node", "linked"])

    return run


def _link_blocks(percent: int):
    def run(batches):
        parts = []
        for table in runs(batches, 3):
            side, nodes, n = (table.column(k).to_numpy() for k in ("side", "node", "n"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("found").to_pylist()]
            r, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(r) or not len(c):
                continue
            shared = _shared([sets[k] for k in r], [sets[k] for k in c])
            parts.append(stars(_linked(shared, n[r][:, None], n[c][None, :], percent), nodes[r], nodes[c]))
            if len(parts) >= 1000:
                yield _edges(parts)
                parts = []
        yield _edges(parts)

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, margin: float | None = MARGIN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Documents are linked from a similarity of ``percent`` / 100; component_id is the least doc_id reachable, and the
    document that has it is kept.
    """
    threshold = percent / 100
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = scratch.stage(docs.mapInArrow(released(_sketched), "doc_id long, n_shingles long, set_key binary, regs binary"), "sketches")
    classes = sketches.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    classes = scratch.stage(classes, "classes")
    own = classes.select("node", "n", "regs")

    bands = classes.select("node", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("regs", b * ROWS + 1, ROWS)) for b in range(BANDS)])).alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size")).where("hub < last").select("key", "hub", "size")
    hubs = scratch.stage(hubs, "hubs")
    members = scratch.stage(join_hot(bands, hubs, "key", "size").select("key", "node", "hub"), "members")
    pairs = members.where("node <> hub").select("node", "hub").distinct()
    pairs = pairs.join(own, "node").join(own.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("regs").alias("hub_regs")), "hub")
    met = scratch.stage(pairs.select("node", "hub", "n", "regs", "hub_n", "hub_regs").mapInArrow(released(_near_hub(threshold, margin)), "node long, hub long, near boolean"), "met")
    far = members.join(met.where("NOT near").select("node", "hub"), ["node", "hub"]).select("key", "node")
    crowd = hubs.where("size > 2").select("key")  # of two, the hub is the other
    far = far.join(crowd, "key", "left_semi").join(own, "node").select("key", "node", "n", "regs")
    far = scratch.stage(far, "far")
    beside = members.where("node <> hub").select("key", "node").join(far.select("key").distinct(), "key", "left_semi").join(own, "node").select("key", "node", "n", "regs")
    late = paired(far, beside, "key", ["n", "regs"], F.ceil(F.count("*") / F.lit(BLOCK)), scratch, "far").mapInArrow(released(_near_blocks(threshold, margin)), "a long, b long")
    groups = components(met.where("near").select(F.col("node").alias("a"), F.col("hub").alias("b")).union(late), scratch, "groups")
    groups = scratch.stage(groups.select(F.col("component").alias("grp"), "node"), "grouped")
    scratch.drop("hubs", "members", "far", "far-sizes")

    sets = docs.join(classes.join(groups, "node").select(F.col("node").alias("doc_id"), "grp"), "doc_id").select("grp", F.col("doc_id").alias("node"), "text").mapInArrow(released(_full_sets), "grp long, node long, n long, found binary")
    sets = scratch.stage(sets, "sets")
    hub_sets = sets.where("grp = node").select("grp", F.col("n").alias("hub_n"), F.col("found").alias("hub_found"))
    judged = sets.where("grp <> node").join(hub_sets, "grp").select("grp", "node", "n", "found", "hub_n", "hub_found").mapInArrow(released(_hub_links(percent)), "grp long, node long, linked boolean")
    judged = scratch.stage(judged, "judged")
    rest = judged.where("NOT linked").select("grp", "node").distinct()
    several = groups.groupBy("grp").agg(F.count("*").alias("size")).where("size > 2").select("grp")
    rest = scratch.stage(rest.join(several, "grp", "left_semi"), "rest")
    open_groups = small(scratch.stage(rest.select("grp").distinct(), "open-groups"))  # so that sizes are counted before rows are dealt by group
    beside = sets.join(open_groups, "grp", "left_semi").where("grp <> node").select("grp", "node", "n", "found")
    rest = sets.join(rest, ["grp", "node"], "left_semi").select("grp", "node", "n", "found")
    of_sets = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(ELEMENTS)))
    more = paired(rest, beside, "grp", ["n", "found"], of_sets, scratch, "rest").mapInArrow(released(_link_blocks(percent)), "a long, b long")
    linked = judged.where("linked").select(F.col("node").alias("a"), F.col("grp").alias("b")).union(more)
    found = scratch.stage(components(linked, scratch, "links"), "components")
    scratch.drop("sets", "judged", "met", "rest", "open-groups", "rest-sizes")

    named = classes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, margin: float | None = MARGIN) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that are kept, with all their columns: of each group of linked
    documents that with the least doc_id. Rows of one doc_id stay or go together."""
    gone = near_duplicates(docs, percent, margin).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
