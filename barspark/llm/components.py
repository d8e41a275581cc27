"""Connected components of a table of links, by alternating stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import hot_keys, unique_join
from barspark.session import stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u's neighbours and u itself; edges are (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the least node it is linked to, directly or not.

    Each round hangs every node's larger neighbours on its least one, then its smaller ones; a component of diameter d
    becomes a star in about log d rounds. Every round is written to the shared folder. A node with very many links is
    joined by broadcast of its one row. Links with a null end, and links of a node to itself, say nothing and are left out.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = unique_join(both, _least(both), ["u"], hot_keys(both, ["u"]))
        large = stored(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # now u > v everywhere: v are u's smaller neighbours
        low = unique_join(large, _least(large), ["u"], hot_keys(large, ["u"]))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u > v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
