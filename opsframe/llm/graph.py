"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: A node is heavy with more neighbours than LEAST_HEAVY and than a HEAVY_SHARE-th of the edges.
LEAST_HEAVY, HEAVY_SHARE = 1 << 16, 4096


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rows: int | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges that isn't its component's smallest; component is that smallest one.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller ones; the number
    of rounds grows with the log of the longest path. Minima are aggregated before the shuffle, and the
    minima of nodes with many neighbours, of which there can be only 2 * HEAVY_SHARE, go to their
    neighbours by broadcast, so they are no hot group. No edge gives no row. rows: about how many nodes there are, for the number of files.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges", rows)
    before = _mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("d"))
        heavy, above = max(LEAST_HEAVY, before[0] // HEAVY_SHARE), both.where("v > u")
        if before[0] <= heavy:
            large = above.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        else:
            above = above.join(F.broadcast(least.where(F.col("d") > heavy).select("u", F.col("m").alias("hub"))), "u", "left")
            light = above.where("hub is null").join(least.where(F.col("d") <= heavy), "u").select("v", "m")
            large = light.union(above.where("hub is not null").select("v", "hub")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges", rows)
        if (now := _mark(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
