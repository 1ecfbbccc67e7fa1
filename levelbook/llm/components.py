"""Connected components of a table of links, by alternating stars.

Links are turned towards smaller nodes until every node points at the smallest of its
component. Every step is a grouped minimum (combined on the map side) and a join with one row
per node, so a node with very many links is no burden for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.llm.frames import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    turned = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes with a link to
    another one. NULLs and links of a node with itself count nothing. The number of rounds grows
    with the logarithm of the longest chain; each is written to the shared folder."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(written(_large_star(edges), "large-star")).distinct(), "small-star")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
