"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import materialize


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node reachable.

    Each round hangs every neighbour of a node on the smallest one it knows: first the
    larger neighbours (large star), then the smaller ones (small star). Rounds grow with
    the logarithm of the component size until nothing changes, and a node's list is
    never collected: the minimum is a partial aggregate and the re-hanging is a join.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edge = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edge, seen = materialize(edge), None
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that the join shuffles both sides and a node with very many neighbours can be split
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edge.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.col("v").cast("string")))).first()
        if now == seen:
            break
        seen = now
    roots = edge.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
