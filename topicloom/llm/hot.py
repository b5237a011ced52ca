"""Joins with a table of one row a key, without a task that holds all rows of a frequent key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.sources.staging import small

#: Rows of a key from which it is joined by a broadcast.
HOT = 20_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, hot: int | None = None) -> DataFrame:
    """rows joined with table, which has one row a key and, in ``size``, how many rows have that key; without ``size``.

    Keys of more than ``hot`` rows (without one: HOT) are joined where the rows are, by a broadcast whose size is checked (should there be
    more than a million of them, by a shuffle that adaptive execution may split); the others by a shuffle. Both should be
    written tables: they are read twice where there are frequent keys.
    """
    hot = HOT if hot is None else hot
    frequent, rest = table.where(F.col(size) > hot).drop(size), table.where(F.col(size) <= hot).drop(size)
    if frequent.isEmpty():
        return rows.join(table.drop(size), key)
    marked = rows.join(small(frequent.withColumn("_hot", F.lit(True))), key, "left")
    found = marked.where("_hot").drop("_hot")
    left = marked.where("_hot IS NULL").select(*rows.columns).join(rest, key)
    return found.select(*left.columns).union(left)
