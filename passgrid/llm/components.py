"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passgrid.llm.common import release, spread_join, staged


def components(edges: DataFrame, into: list[DataFrame] | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the component's least node.

    Every round is a minimum per node and joins, never a collected neighbourhood, so a node may
    have any number of edges (a node of very many is dealt over several tasks); a round is written
    out, which cuts the lineage, and rounds go on until the edges no longer change.  ``into``
    collects the written tables that the result reads.
    """
    up = lambda df: df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = staged(up(edges.select("a", "b")), "edges", compression="none"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("least", "a").alias("m"))
        large = spread_join(both, least, "a", "b").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(up(large), "stars", compression="none")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, "a", "b")
        last, now = now, staged(up(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))), "edges", compression="none")
        release(last)
        release(large)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == new:
            break
        mark = new
    if into is not None:
        into.append(now)
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
