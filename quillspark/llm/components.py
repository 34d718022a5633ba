"""Connected components by alternating large-star and small-star steps, all in Spark.

Each step sends every node's neighbours to the smallest one, so the work is in proportion to the
edges and the number of rounds grows with the logarithm of a component's size. Rounds are written to
the shared folder; nothing but two counts a round goes to the driver. Least neighbours are written too
before they are joined to all edges: they tell when only stars are left, and whether they are few enough
for a broadcast, which spares most of a round's shuffles. Otherwise the join is one of plain shuffles,
whose hot nodes (centres of large stars) Spark deals out to several tasks.

``extended`` takes further edges to known components and works on those between components only.

Defined results: edges from a node to itself are ignored, repeated edges count once, and so does an
edge and its reverse; edges with a null end are ignored; without edges there are no rows; columns
beside ``u`` and ``v`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowkit import discard, written

#: Nodes that may be broadcast (16 bytes each).
BROADCAST_NODES = 1 << 20


def components(edges: DataFrame, most: int = BROADCAST_NODES) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (u, v), written; ``root`` is the least node of the component. Up to ``most`` nodes are broadcast."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a star's centre has no lesser neighbour, and its other nodes have the centre alone
        inner = F.expr("count_if(v < u) > 1 or count_if(v < u) > 0 and count_if(v > u) > 0")
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), inner.alias("inner")).select("u", F.least("u", "m").alias("m"), "inner"), "least")
        nodes, left = least.agg(F.count("*"), F.count_if(F.col("inner"))).first()
        if not left:
            discard(now)
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        near = F.broadcast if nodes <= most else lambda table: table
        large = both.join(near(least.select("u", "m")), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if nodes > most:
            large = large.distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(lower), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.where("u <> v").distinct(), "edges")
        discard(last, least)


def extended(roots: DataFrame, edges: DataFrame, most: int = BROADCAST_NODES) -> DataFrame:
    """``roots``, as ``components`` gives them, with the nodes of ``edges`` and the components that these join; the old table is discarded."""
    near = F.broadcast if roots.count() <= most else lambda table: table
    of = near(roots)
    rooted = edges.join(of.select(F.col("node").alias("u"), F.col("root").alias("a")), "u", "left").join(of.select(F.col("node").alias("v"), F.col("root").alias("b")), "v", "left")
    joined = components(rooted.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")), most)
    count = joined.count()
    if not count:
        discard(joined)
        return roots
    to = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = roots.join(F.broadcast(to) if count <= most else to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = written(moved.unionByName(joined.join(of.select("node"), "node", "left_anti").select("node", "root")), "roots")
    discard(roots, joined)
    return out
