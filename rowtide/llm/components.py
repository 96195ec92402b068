"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations, combined before their shuffles, and two joins that adaptive execution can split; its
edges are written to the shared folder, which cuts the lineage. Edges never come to the driver, only their count and a
checksum. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide.session import stored


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b) but the roots; the root is the component's smallest node.

    Links in either direction, repeated links and loops are allowed; no link gives no row. Nodes must not be null.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))
    before = edges.agg(*sign).first()
    while before[0]:
        edges = stored(_star(edges), "links")
        now = edges.agg(*sign).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
