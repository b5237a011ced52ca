"""Binary codes by iterative quantisation: a rotation, learned on a sample, after which signs are balanced.

Vectors that are null, empty, zero or have null or non-finite components have no code. The others have one of their
dimension's: each dimension of a table has a codec of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that a rotation is learned on, about, whatever the table's size; rows are chosen by a hash of their id
#: and place, so that a third of all rows under one id are thinned out too.
SAMPLE = 10_000
BITS = 64


@dataclass(frozen=True)
class Codec:
    mean: np.ndarray
    rotations: list[np.ndarray]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, one column a rotation."""
        centred = unit - self.mean
        out = np.zeros((len(unit), len(self.rotations)), dtype=np.uint64)
        for k, r in enumerate(self.rotations):
            signs = np.zeros((len(unit), BITS), dtype=np.uint8)
            signs[:, : r.shape[1]] = centred @ r > 0
            out[:, k] = np.packbits(signs, axis=1, bitorder="little").view("<u8")[:, 0]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, rotations: int = 1, rounds: int = 30, centred: bool = True) -> Codec:
    """Principal axes of the sample's unit vectors, then rotations of them, each from another random start; about their
    mean, or, if not ``centred``, about the origin, where two vectors' angle is that of their cosine."""
    x = unit(sample)
    mean = x.mean(axis=0) if centred else np.zeros(x.shape[1])
    x = x - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[:BITS].T
    v, found = x @ axes, []
    for k in range(rotations):
        r, _ = np.linalg.qr(np.random.default_rng(k + 1).normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        found.append(axes @ r)
    return Codec(mean, found)


def _sound(batches):
    for batch in batches:
        out, dims = [], []
        for x in batch.column("embedding").to_pylist():
            v = np.array([np.nan if y is None else y for y in x or []], dtype="<f8")
            fine = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
            out.append(v.tobytes() if fine else None)
            dims.append(len(v) if fine else None)
        kept = [n for n in batch.schema.names if n != "embedding"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=[*kept, "dim", "vector"])


def vectors(table: DataFrame, *marks) -> DataFrame:
    """(vec_id, marks, dim, vector) with the components as doubles, for the vectors that take part; marks are boolean
    columns of table."""
    sound = table.select(F.col("vec_id").cast("long").alias("vec_id"), *marks, F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    shape = ", ".join(f"{n} boolean" for n in sound.columns[1:-1])
    return sound.mapInArrow(_sound, f"vec_id long, {shape + ', ' if shape else ''}dim int, vector binary").where("dim IS NOT NULL")


def by_dimension(sound: DataFrame) -> list[tuple[int, DataFrame]]:
    """The rows (vec_id, marks, vector) of each dimension of which there are two at least."""
    found = sound.groupBy("dim").count().where("count > 1").orderBy("dim").collect()
    return [(r["dim"], sound.where(F.col("dim") == r["dim"]).drop("dim")) for r in found]


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def sampled(rows: DataFrame, dim: int, sample: int = SAMPLE) -> np.ndarray:
    """About ``sample`` of the vectors, or all if there are fewer."""
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    found = rows.select("vec_id", "vector").orderBy("vec_id").collect()
    return np.frombuffer(b"".join(bytes(r.vector) for r in found), dtype="<f8").reshape(-1, dim) if found else np.zeros((0, max(dim, 1)))
