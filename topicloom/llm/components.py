"""Connected components of links, in rounds of large-star and small-star over DataFrames.

A node that many hang on is no hot key: its links are joined by a broadcast (see ``hot``). Each round hangs every node's larger neighbours, then its smaller ones, on the least node it knows, until the links are
stars. Rounds grow with the logarithm of the longest path. A round's links are written to the shared folder, so the plan
stays short and lost executors cost one round at most; what reaches the driver is a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_hot
from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of links (a, b), component being the least node reachable.

    Rows with a null end, and links of a node with itself, say nothing.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u > v").distinct()
    edges = scratch.stage(edges, f"{name}-0")
    for k in range(1, 60):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), f"{name}-least-{k}")
        large = join_hot(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        edges = scratch.stage(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-least-{k}")
        # stars: each node hangs on one, and no node that others hang on hangs itself
        degrees = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not degrees.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
