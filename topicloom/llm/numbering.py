"""Gapless numbers within groups that no single task has to hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, by: str, parts: list[str], order: list, name: str) -> DataFrame:
    """rows with ``name``, counted from 0 in each value of ``by``, by the columns ``parts`` and then by ``order``.

    Each part of a group is numbered by itself and set off by the counts of the parts before it. None of by and parts
    may be null.
    """
    before = Window.partitionBy(by).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(by, *parts).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(by, *parts).orderBy(*order)
    found = rows.withColumn("_inside", F.row_number().over(inside) - 1).join(offsets, [by, *parts])
    return found.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")


def ranges(rows: DataFrame, column: str, n: int) -> Column:
    """A number for about n ranges of a column of longs, ascending with it and even; each of the values that part the
    ranges has an odd number of its own, and nulls have -1."""
    bounds = np.unique(np.asarray(rows.approxQuantile(column, [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], dtype=np.int64))

    @F.arrow_udf("int")
    def place(values: pa.Array) -> pa.Array:
        x = values.fill_null(0).to_numpy(zero_copy_only=False)
        left, right = np.searchsorted(bounds, x, side="left"), np.searchsorted(bounds, x, side="right")
        found = left + right
        found[np.asarray(values.is_null())] = -1
        return pa.array(found, pa.int32())

    return place(F.col(column))
