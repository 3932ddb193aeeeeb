"""Connected components of a link table, by alternating star contractions.

Each round points every node's neighbours at the smallest node seen, first those above a node, then those below it,
until the links are stars around the smallest node of each component. A round is two sums per node and two joins;
a node with a third of all links is combined on the map side and its join is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tunefathom.session import settled


def _large_star(links: DataFrame) -> DataFrame:
    """Neighbours above a node are linked to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("low"))
    rest = down.join(lowest, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; ``links`` has columns a and b, the component is its smallest node."""
    now = settled(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while True:
        now = settled(_small_star(_large_star(now)), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: equal when a round has changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())
