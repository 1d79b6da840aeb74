"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import written


def components(links: DataFrame) -> DataFrame:
    """`(node, component)` for every node of `links (u long, v long)`: the smallest node that it reaches.

    Alternates two local rewrites until the links are stars around the smallest nodes: every node sends its larger
    neighbours to its smallest neighbour, then its smaller ones. A node's neighbours are never gathered: the smallest one is
    a combined aggregate that is joined back, so a hub of any size is spread by the skew join. Each round is written to the
    shared storage. Links from a node to itself and repeated links are harmless; an empty table gives no rows.
    """
    down = written(_pointing_down(links).distinct(), "links")
    while not _stars(down):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = _pointing_down(large).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        down = written(_pointing_down(small.unionByName(least.select("u", F.col("low").alias("v")))).distinct(), "links")
    roots = down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _pointing_down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")


def _stars(down: DataFrame) -> bool:
    """Whether every node either has one link down, to a node that has none, or none itself."""
    ends = down.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        down.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up = 1 and root = 1)")
    return bad.isEmpty()
