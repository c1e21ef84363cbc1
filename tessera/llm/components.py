"""Connected components of a graph given as an edge table, by alternating star contraction.

Each round replaces every node's neighbourhood by links to its minimum, first
toward larger nodes, then toward smaller ones.  A round is two aggregations by
minimum and two equi-joins.  A neighbourhood is never gathered: the edges of hubs,
of which there are ``HUBS`` at most, meet their minima by a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A node with more than this share of all edges, and more than a thousand, is a hub.
HUBS = 10_000


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
    return row[0], row[1] or 0


def _with_minimum(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with the minimum ``m`` of ``low`` (u, m, n), one row a node with its number of edges."""
    hub = F.col("n") > max(1000, total // HUBS)
    plain = low.select(F.col("u").alias("__u"), "m", "n")
    if low.where(hub).isEmpty():
        return edges.join(plain, F.col("u") == F.col("__u")).select("u", "v", "m")
    hubs = F.broadcast(plain.where(hub))
    rest = edges.join(hubs.select(F.col("__u").alias("__hub")), F.col("u") == F.col("__hub"), "left_anti")
    return edges.join(hubs, F.col("u") == F.col("__u")).select("u", "v", "m").unionByName(rest.join(plain.where(~hub), F.col("u") == F.col("__u")).select("u", "v", "m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable.  Edges with a null end and
    loops are ignored, repeated edges count once; an empty table gives an empty
    result.  Nodes without edges are not listed: they are their own component.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    e = cut(e.distinct())
    before = _signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = cut(_with_minimum(both, low, before[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = _with_minimum(large, low, before[0]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
