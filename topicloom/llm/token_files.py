"""Token ids in files: frequency-ranked ids, byte-aligned variable length, control bytes apart.

Ids are counted over the whole corpus and replaced by their rank (0: most frequent; ties to the smaller id). A rank
takes one to four bytes; two bits a rank in a separate control stream say how many. Four ranks share a control byte,
and a decoder looks up, for each control byte, where its 16 output bytes stand in the data: two table lookups and one
gather in numpy, no loop over ids.

Files are Parquet, so that Spark's commit protocol and any file system can hold them. A row is a block of whole
documents: ``start`` (ids before the block), ``doc_ids``, ``lengths``, ``control`` and ``data``. Part files, and blocks
in them, are in ascending order of doc_id. A second table ``ranks`` maps ranks to ids.

Null doc_ids come first; repeated doc_ids stand in the order of a hash of their ids; null texts count as empty.
Other columns of the input are not read. An empty table gives empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder
from .scratch import Scratch

#: Ids of a part file, about; and of a block, above which no more documents are added.
IDS_PER_FILE, IDS_PER_BLOCK = 8_000_000, 250_000

# --- the codec -------------------------------------------------------------------------------------------------------

_LENGTHS = np.stack([((np.arange(256) >> (2 * k)) & 3) + 1 for k in range(4)], axis=1)  # [control byte, rank] -> bytes
_TOTAL = _LENGTHS.sum(axis=1)
_FROM = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
#: [control byte, output byte] -> offset in the group's data; those of zero bytes are beyond any data.
_GATHER = np.where(np.arange(4)[None, None, :] < _LENGTHS[:, :, None], _FROM[:, :, None] + np.arange(4)[None, None, :], 1 << 30).reshape(256, 16).astype(np.int32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    width = int(extra.max(initial=0)) + 1
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width, dtype=np.uint8)[None, :] <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that ``encode_ranks`` took."""
    c = np.frombuffer(control, dtype=np.uint8)
    total = _TOTAL[c]
    start = (np.cumsum(total) - total).astype(np.int32)
    padded = np.zeros(len(data) + 16, dtype=np.uint8)  # the last group is padded with ranks that have no data
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return padded.take(_GATHER[c] + start[:, None], mode="clip").view("<u4").reshape(-1)[:n]


# --- writing ---------------------------------------------------------------------------------------------------------

_STAGED = "doc_id long, n_tokens long, tie long, packed binary"
#: Ids whose counts are added up at once.
_COUNTED_AT_ONCE = 4_000_000


def _tokenize(path: str, end_id: int):
    """A row for each document, and at the end of a task one with the counts of all its ids."""

    def run(batches):
        enc, zstd = encoder(path), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(enc.size, dtype=np.int64)

        def rows(ids, n, tie, packed, counts):
            return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(tie, pa.int64()), packed, pa.array(counts, pa.binary())], names=["doc_id", "n_tokens", "tie", "packed", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, stops = enc.encoded(batch.column(1), end_id)
            for at in range(0, len(tokens), _COUNTED_AT_ONCE):
                counts += np.bincount(tokens[at : at + _COUNTED_AT_ONCE], minlength=enc.size)
            n = np.diff(stops, prepend=0)
            places = np.concatenate([[0], stops]) * enc.dtype.itemsize
            raw = memoryview(tokens).cast("B")
            each = [raw[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
            packed = pa.array([zstd.compress(x) for x in each], pa.binary())
            yield rows(batch.column(0), n, [zlib.crc32(x) for x in each], packed, pa.nulls(len(n), pa.binary()))
        yield rows(pa.nulls(1), [None], [None], pa.nulls(1, pa.binary()), [counts.tobytes()])

    return run


def _counted(batches):
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            counts = np.frombuffer(raw, dtype=np.int64)
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], names=["token_id", "n"])


def _part(bounds: list[int]):
    """The part file of a doc_id; nulls are in the first."""
    edges = np.asarray(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        found[np.asarray(ids.is_null())] = 0
        return pa.array(found, pa.int32())

    return part(F.col("doc_id"))


_BLOCKS = "start long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def _blocks(path: str, rank_of: bytes, starts: dict[int, int], per_block: int):
    """Blocks of a part's documents, which come in order."""

    def run(batches):
        enc, unpack = encoder(path), zstandard.ZstdDecompressor()
        ranks = np.frombuffer(rank_of, dtype="<u4")
        part = None
        ids: list = []
        held: list[bytes] = []
        at = start = size = 0

        def block():
            control, data = encode_ranks(ranks[np.frombuffer(b"".join(held), dtype=enc.dtype)])
            return pa.RecordBatch.from_arrays(
                [pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) // enc.dtype.itemsize for x in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["start", "doc_ids", "lengths", "control", "data"],
            )

        for batch in batches:
            for p, doc_id, packed in zip(*(batch.column(k).to_pylist() for k in ("part", "doc_id", "packed"))):
                if p != part:
                    if held:
                        yield block()
                        ids, held, size = [], [], 0
                    part, at = p, starts[p]
                if not held:
                    start = at
                ids.append(doc_id)
                tokens = unpack.decompress(packed)
                held.append(tokens)
                n = len(tokens) // enc.dtype.itemsize
                size += n
                at += n
                if size >= per_block:
                    yield block()
                    ids, held, size = [], [], 0
        if held:
            yield block()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, ids_per_file: int = IDS_PER_FILE, ids_per_block: int = IDS_PER_BLOCK) -> None:
    """Encodes ``text`` of each row of docs (doc_id, text), appends end_id, and writes ``path``/blocks and ``path``/ranks.

    Each text is encoded once; its ids wait in the shared folder, compressed. What reaches the driver is bounded by
    the vocabulary (counts) and by the number of part files (their first doc_id and their size).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    staged = scratch.stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenize(tokenizer, end_id), f"{_STAGED}, counts binary"), "staged", "none")
    counts = staged.where("counts IS NOT NULL").select("counts").mapInArrow(_counted, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    staged = staged.where("n_tokens IS NOT NULL").drop("counts")
    counts = sorted(counts.collect(), key=lambda r: (-r.n, r.token_id))  # one row a token of the vocabulary
    size = encoder(tokenizer).size
    rank_of = np.zeros(size, dtype="<u4")
    for rank, row in enumerate(counts):
        rank_of[row.token_id] = rank
    total = sum(r.n for r in counts)
    files = max(1, -(-total // ids_per_file))
    bounds = []
    if files > 1:
        probs = [k / files for k in range(1, files)]
        bounds = sorted({int(x) for x in staged.approxQuantile("doc_id", probs, 0.1 / files)})
    dealt = staged.withColumn("part", _part(bounds))
    sizes = {r.part: r.n for r in staged.select("n_tokens", _part(bounds).alias("part")).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, at = {}, 0
    for part in range(len(bounds) + 1):
        starts[part] = at
        at += sizes.get(part, 0)
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    blocks = ordered.select("part", "doc_id", "packed").mapInArrow(_blocks(tokenizer, rank_of.tobytes(), starts, ids_per_block), _BLOCKS)
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    ranked = [(rank, int(r.token_id), int(r.n)) for rank, r in enumerate(counts)]
    spark.createDataFrame(ranked, "rank long, token_id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    scratch.drop()


# --- reading ---------------------------------------------------------------------------------------------------------


def _decoded(id_of: bytes, ids: bool):
    def run(batches):
        table = np.frombuffer(id_of, dtype="<u4")
        for batch in batches:
            for start, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.asarray(lengths, dtype=np.int64)
                tokens = table[decode_ranks(control, data, int(n.sum()))]
                stops = np.cumsum(n)
                each = [tokens[a:b] for a, b in zip((stops - n).tolist(), stops.tolist())]
                last = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())) if ids else pa.array([zlib.crc32(x) for x in each], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + stops - n, pa.int64()), pa.array(n, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids" if ids else "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document in the files; without ids, their crc32 (of little-endian
    unsigned 32-bit integers) as ids_crc32."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # one row a token of the vocabulary
    id_of = np.asarray([r.token_id for r in ranks] or [0], dtype="<u4").tobytes()
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    last = "ids array<long>" if ids else "ids_crc32 long"
    return blocks.mapInArrow(_decoded(id_of, ids), f"doc_id long, start long, n_tokens long, {last}")
