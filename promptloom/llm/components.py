"""Connected components by alternating large-star and small-star."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptloom.sources.workspace import materialize


def _nearest(links: DataFrame) -> DataFrame:
    """The smallest of each node's neighbours and itself; ``links`` hold both directions."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())


def _digest(links: DataFrame) -> tuple:
    """Number of links and the sum of their hashes."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of ``links(u, v)``.

    Each step only aggregates the smallest neighbour of a node and sends it to the neighbours, so a hub is never brought into one task. A step's links are
    written to the shared folder; the loop ends when the links stay the same, after a number of steps that grows with the logarithm of the longest path.
    """
    links = links.where("u <> v").select("u", "v").distinct()
    before = None
    while True:
        links = materialize(_small_star(_large_star(links)), "stars")
        now = _digest(links)
        if now == before or now[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
