"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import cut_plain


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v`` with the smallest of u and all its v. The minimum combines before its shuffle; the join may split a hot u."""
    least = pairs.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("m_u")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u moves to the smallest of u's neighbourhood."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    moved = _with_least(down)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``u, v`` (integers); the component is its smallest node.

    Steps repeat until nothing changes; then all edges point to the smallest node. Loops, doubled edges and nulls are
    ignored, an empty table gives none. Each step's table replaces the one before in the shared folder.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = cut_plain(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = state(now)
    while mark[0]:
        now = cut_plain(_small_star(_large_star(now)), replaces=now)
        before, mark = mark, state(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()


