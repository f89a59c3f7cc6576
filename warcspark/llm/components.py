"""Connected components of a table of links, by alternating large and small stars.

Each round replaces the links of a node by links to the smallest node it sees, first from the
larger neighbours, then from the smaller ones, until the links form stars. Minima are merged
before the shuffle; a hub's links are joined by node, which adaptive execution splits. Every
round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

MAX_ROUNDS = 60


def _settled(links: DataFrame) -> bool:
    """Whether links (u > v) are stars: no node has links to two nodes, or to one while another one links to it."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    seen = links.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return seen.where("down > 1 or down = 1 and up = 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of each node of links (u, v: long, no nulls).

    Links of a node to itself, repeated ones and either direction are fine; nodes without a
    link to another one don't come out.
    """
    now = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        old, now = now, staged(_small_star(_large_star(now)), "links")
        drop_staged(now.sparkSession, old._staged)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
