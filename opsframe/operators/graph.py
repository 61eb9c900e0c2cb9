"""Operators on a typed graph of nodes and relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.storage import materialize

#: Relation types, and whether failure spreads along them.
EDGE_TYPES = {"depends_on": True, "deployed_on": True, "routes_to": True, "contains": False, "connects_to": False, "member_of": False, "owned_by": False}
MAX_DEPTH = 5


def expand(relations: DataFrame, start: DataFrame, depth: int = 3, direction: str = "both", propagating: bool = True) -> DataFrame:
    """(node, hops, via, type): what start (node) reaches within depth, at most 5, hops; the first visit is the least (hops, via, type).

    relations: (src, dst, type). A frontier is joined with the edges and what was seen is taken away; each
    hop is written to shared storage, so a lost executor costs one hop.
    """
    depth = max(1, min(depth, MAX_DEPTH))
    if direction not in ("both", "down", "up"):
        raise ValueError(f"unknown direction {direction!r}")
    if propagating:
        relations = relations.where(F.col("type").isin([k for k, v in EDGE_TYPES.items() if v]))
    down = relations.select(F.col("src").alias("via"), F.col("dst").alias("node"), "type")
    up = relations.select(F.col("dst").alias("via"), F.col("src").alias("node"), "type")
    edges = {"down": down, "up": up, "both": down.unionByName(up)}[direction]
    seen = materialize(start.select("node").distinct().select("node", F.lit(0).alias("hops"), F.lit(None).cast(dict(down.dtypes)["via"]).alias("via"), F.lit(None).cast("string").alias("type")), "hop0")
    hops = [seen]
    for k in range(1, depth + 1):
        step = edges.join(hops[-1].select(F.col("node").alias("via")), "via")
        every = reduce(DataFrame.unionByName, hops).select("node")
        step = step.join(every, "node", "left_anti").groupBy("node").agg(F.min(F.struct("via", "type")).alias("x"))
        step = materialize(step.select("node", F.lit(k).alias("hops"), "x.via", "x.type"), f"hop{k}")
        hops.append(step)
        if not step.take(1):
            break
    return reduce(DataFrame.unionByName, hops[1:])


def ordered(hits: DataFrame, names: DataFrame) -> DataFrame:
    """hits of expand() with names (node, name) in the order they are shown: fewer hops first, then by name; `place` counts from 1."""
    w = Window.partitionBy("hops").orderBy("name", "node")
    sizes = hits.groupBy("hops").agg(F.count(F.lit(1)).alias("__n"))
    # at most MAX_DEPTH rows tell where a hop's places begin
    before = sizes.select("hops", F.coalesce(F.sum("__n").over(Window.orderBy("hops").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    named = hits.join(names, "node").withColumn("__k", F.row_number().over(w)).join(F.broadcast(before), "hops")
    return named.withColumn("place", (F.col("__before") + F.col("__k")).cast("long")).drop("__k", "__before").orderBy("place")


def linked_devices(relations: DataFrame, node: str, kind: str, names: DataFrame, limit: int = 100) -> DataFrame:
    """(node, name, relation) at the other ends of a node's relations (id, src, dst, type) of one type, smallest ids first."""
    own = relations.where((F.col("type") == kind) & ((F.col("src") == node) | (F.col("dst") == node))).orderBy("id").limit(limit)
    return own.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("node"), F.col("id").alias("relation")).join(names, "node").select("node", "name", "relation")


def neighbours(relations: DataFrame) -> DataFrame:
    """(node, out, in) degrees."""
    ends = relations.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(relations.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))


def invalid(relations: DataFrame, unique_types: list[str]) -> DataFrame:
    """Relations that break a rule: an unknown type, a loop, or a second target where a type allows one."""
    w = Window.partitionBy("src", "type")
    many = F.count(F.lit(1)).over(w) > 1
    reason = F.when(~F.col("type").isin(list(EDGE_TYPES)), "unknown_type").when(F.col("src") == F.col("dst"), "loop").when(F.col("type").isin(unique_types) & many, "not_unique")
    return relations.withColumn("reason", reason).where("reason is not null")
