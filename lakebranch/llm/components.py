"""Connected components by alternating large and small stars; no group of neighbours is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared


def roots(edges: DataFrame, nodes: DataFrame, name: str = "class") -> DataFrame:
    """(name, root) of nodes (name), given edges (a, b): root is the least node of the component, itself where it has no edge.

    Nodes without an edge, null ones too, are their own root; edges with a null end join nothing; without nodes there are no rows.
    Each round points every node to the least of its neighbourhood, by an aggregate and a join; the number of rounds grows with
    the logarithm of a component's length. Edges that don't change end it.
    """
    pairs = shared.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        old, pairs = pairs, shared.written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        shared.removed(old)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = pairs.select(F.col("u").alias(name), F.col("v").alias("root"))
    out = shared.written(nodes.join(found, name, "left").withColumn("root", F.coalesce("root", name)), "roots")
    shared.removed(pairs)
    return out
