"""Runs of rows with equal keys in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches, keys: int) -> Iterator[pa.Table]:
    """One table for each run of rows that agree in the first ``keys`` columns (whole numbers without nulls)."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = [table.column(k).to_numpy() for k in range(keys)]
        cut = np.zeros(table.num_rows, dtype=bool)
        cut[0] = last is not None and last != tuple(v[0] for v in values)
        for v in values:
            cut[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(cut).tolist()
        at = 0
        for stop in starts:
            held.append(table.slice(at, stop - at))
            whole = [t for t in held if t.num_rows]
            if whole:
                yield pa.concat_tables(whole) if len(whole) > 1 else whole[0]
            held, at = [], stop
        held.append(table.slice(at))
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.concat_tables(held)
