"""Connected components of a link table, by alternating large and small stars.

Each round points the neighbours of every node to its smallest neighbour, first
the larger ones, then the smaller ones; the links shrink to stars around each
component's smallest node in a number of rounds that grows with the logarithm
of the longest chain.  Rounds are checkpointed; no link reaches the driver, and
the least neighbour of a hub is found by a pre-aggregated minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tambo.llm.common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link; label is the least node of its component."""
    one = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = checkpointed(one)
    state = _state(now)
    while state[0]:
        now = checkpointed(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
