"""Identity: one row per business, and which row that is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SOURCE_BIT = 57          # of ``ord``: 24 bits of partitions and 33 of rows stand below a source


def first_per_key(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key in ``order``.

    ``row_number() = 1`` carries a limit of one that Spark applies on the map
    side as well, so a key holding a third of all rows reaches its task as one
    row per input partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order) if isinstance(order, (list, tuple)) else [order]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def first_seen(listings: DataFrame) -> DataFrame:
    """Deduplicate on identity; the row discovered first survives."""
    return first_per_key(listings, "cid", ["ord", "source", "name"])


def latest(df: DataFrame, key, version: str | Column) -> DataFrame:
    """The last row per key wins."""
    col = F.col(version) if isinstance(version, str) else version
    return first_per_key(df, key, [col.desc_nulls_last()])


def distinct_first(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in first-seen order, ignoring case; the spelling seen
    first is kept. Combines before the shuffle."""
    return (df.groupBy(F.lower(value).alias("_key"))
            .agg(F.min_by(value, order).alias(value), F.min(order).alias(order))
            .drop("_key"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Sources one after another; ``ord`` keeps source order, then row order.

    A source that is off or failed is simply not given. Its place in the order
    stands in the high bits, so no source's rows interleave with another's;
    below it there is room for a running number over 2**24 partitions, and a
    row beyond that is an error.
    """
    if len(frames) > 1 << (63 - SOURCE_BIT):
        raise ValueError(f"{len(frames)} sources: at most {1 << (63 - SOURCE_BIT)} keep their order")
    own = F.coalesce("ord", F.lit(0))
    inside = F.when((own >= 0) & (own < F.lit(1 << SOURCE_BIT)), own).otherwise(
        F.raise_error(F.lit("a row's order does not fit under its source's")).cast("long"))
    tagged = [df.withColumn("ord", F.shiftleft(F.lit(i).cast("long"), SOURCE_BIT) + inside)
              for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def top_per_key(df: DataFrame, key: str, order, n: int, salts: int = 32) -> DataFrame:
    """At most ``n`` rows per key, exact for any ``n``.

    Each key's rows are first cut to ``n`` within ``salts`` shares, so the task
    that settles a hot key sees ``salts * n`` rows and not the whole group.
    """
    order = list(order) if isinstance(order, (list, tuple)) else [order]
    share = F.pmod(F.spark_partition_id(), F.lit(salts))
    part = F.row_number().over(W.partitionBy(key, "_share").orderBy(*order))
    whole = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return (df.withColumn("_share", share).withColumn("_rn", part).filter(F.col("_rn") <= n)
            .withColumn("_rn", whole).filter(F.col("_rn") <= n).drop("_rn", "_share"))
