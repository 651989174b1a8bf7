"""Connected components of an edge table, in rounds of two star steps.

The large-star step links every larger neighbour of a node to the node's
smallest neighbour; the small-star step does so for its smaller neighbours.
Both keep the components and shrink every one of them to a star around its
smallest node, in a number of rounds that grows with the logarithm of the
component size.  Each round is written to the shared folder, so the plan
stays short and a lost executor costs one round at most.  Minima are
aggregated before the shuffle and joined back by :func:`common.attach`, so a
hub with a third of the edges is never handled by one task.  Nothing but a
two-number fingerprint of the edge table reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.llm.common import attach, stored


def _linked_to_minimum(edges: DataFrame) -> DataFrame:
    """For edges (u, v): the edges with the smallest v of their u as ``m``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    return attach(edges, least, "u", "_n").drop("_n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _linked_to_minimum(both).where("v > u")
    return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _linked_to_minimum(edges)  # every v is smaller than its u
    inner = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(linked.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its
    smallest node.

    Nodes are of any type with an order.  Edges with a null end and loops are
    left out; a node that occurs in nothing else has no row.  Repeated edges
    and either direction count once.  An empty table gives an empty table.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    now = stored(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _fingerprint(now)
    while seen[0]:
        large = stored(_large_star(now).distinct(), "edges")
        now = stored(_small_star(large), "edges")
        new = _fingerprint(now)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
