"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Minima are aggregated on the map side and joined back, so a hub with many edges
is never gathered in one task: the join's hot key can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloscope.llm.common import stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the component's least node) for every node that has an edge.

    ``edges``: columns a, b of one orderable type; nulls and loops are ignored.
    """
    now = stash(edges.filter("a <> b").select("a", "b").distinct(), "cc")
    mark = None
    for _ in range(rounds):
        now = stash(_small_star(_large_star(now)), "cc")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
    raise RuntimeError("the components did not settle")
