"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and comp (the smallest node that it reaches) of every node that has a link to another; links: a, b.

    Every round is a few joins keyed by node; nothing but a row count and a checksum reaches the driver, and each round's
    edges are a table of ``scratch``. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before, edges = edges, scratch.keep(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        scratch.drop(before)
        # equal when no edge has moved: the sum of the edges' hashes stands for the set
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    named = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
    out = scratch.keep(named)
    scratch.drop(edges)
    return out
