"""Connected components of links, distributed: rounds of large-star and small-star until nothing changes.

Every round is written to the checkpoint folder, so that a lost executor costs one round at most. No link or component
reaches the driver, only two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, dealt_round


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(dealt_round(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Here u > v in every link."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(dealt_round(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def roots(links: DataFrame) -> DataFrame:
    """node, root (smallest node that can be reached) of every node in links (u, v); nodes of no link aren't in it."""
    now = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = state
        now = cut(_small_star(_large_star(now)))
