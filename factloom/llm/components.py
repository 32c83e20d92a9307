"""Connected components by alternating large and small stars, a few shuffles of the links per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

MAX_ROUNDS = 60


def _links(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct links with the larger end first."""
    return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs a node's neighbours (the larger ones, or the smaller ones and itself) on its smallest neighbour."""
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = near.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m"))
    moved = near.join(least, "a")
    if large:
        return _links(moved.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")))
    return _links(moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("_m").alias("b")))


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on nothing, which is then the smallest it reaches."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("e"))
    open_ = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.count_if(F.col("e.up") == 0).alias("down"))
    return open_.filter("up > 1 OR up = 1 AND down > 0").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the smallest node that it reaches.

    Nodes without a link do not appear. Each round is written out, so lost executors read it again;
    the number of rounds grows with the logarithm of the longest chain.
    """
    now = cut_lineage(_links(links), "links")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        now = cut_lineage(_star(_star(now, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
