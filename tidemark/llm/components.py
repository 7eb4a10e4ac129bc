"""Connected components by alternating large-star and small-star rounds, all state in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import base


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the least of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, linked to the least of them (links have a < b)."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), "b")).where("a < b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``links`` (a, b: long) but the roots themselves.

    Links may point either way and repeat; self-links and nulls are left out. Each round is written to the shared
    folder; rounds end when the links no longer change (a logarithmic number in practice), and a chain
    that has not settled after ``max_rounds`` raises rather than giving a partial answer.
    """
    now = base.stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    for _ in range(max_rounds):
        now = base.stage(_small_star(_large_star(now)))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
