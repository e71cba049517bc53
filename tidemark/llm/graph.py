"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has a link. links: a, b, both long, not null.

    A round points each node's larger neighbours, then its smaller ones, at the smallest node next to it.
    Minima combine before the shuffle, so a node with very many links is no hot group; each round is
    written to the shared folder, which ends its lineage. Rounds grow with the logarithm of the longest
    chain.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "links")
    state = signature(edges)
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        far = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = far.groupBy("hi").agg(F.min("lo").alias("m"))
        near = far.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = staged(near.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        if (now := signature(edges)) == state:
            break
        state = now
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def signature(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes, as two edge tables have alike only if they are alike."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
