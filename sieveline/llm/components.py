"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it sees."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``): the smallest node it can reach.

    Rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder, so a lost executor costs one round at most, and
    replaces the one before it; only its size and checksum come to the driver.
    """
    with Scratch() as scratch:
        state, edges = None, scratch.settle(edges.filter("a <> b").select("a", "b"), "components")
        while True:
            before, edges = edges, scratch.settle(_small(_large(edges)), "components")
            scratch.drop(before)
            got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if got == state:
                break
            state = got
        stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return scratch.keep(stars.union(stars.select(F.col("root").alias("node"), "root")).distinct())
