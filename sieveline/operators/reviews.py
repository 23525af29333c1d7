"""Reviews: deduplicated, rolled up per business, joined to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import QUALIFIED
from .listings import first_per_key, top_per_key

HEX_PAIR = r"(?i)^0x[0-9a-f]+:0x[0-9a-f]+$"


def distinct_reviews(reviews: DataFrame, order: str = "ord", cap: int | None = None) -> DataFrame:
    """First row per review id within a business; rows without an id all stay.

    ``cap`` keeps a business's first reviews in order, where the user asked
    for a limit.
    """
    named = first_per_key(reviews.filter(F.coalesce("id", F.lit("")) != ""), ["cid", "id"], order)
    out = named.unionByName(reviews.filter(F.coalesce("id", F.lit("")) == ""))
    return top_per_key(out, "cid", order, cap) if cap else out


def rollup(reviews: DataFrame) -> DataFrame:
    """Per business: reviews held, first year, mean rating, count per star."""
    year = F.year(F.timestamp_micros("timestamp_us"))
    return reviews.groupBy("cid").agg(
        F.count(F.lit(1)).cast("int").alias("reviews_fetched"), F.min(year).alias("first_review_year"),
        F.avg("rating").alias("avg_rating"),
        *[F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in range(1, 6)])


def with_review_facts(listings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Listings whose review year and fetched count come from their reviews."""
    facts = rollup(reviews).select("cid", F.col("reviews_fetched").alias("_got"),
                                   F.col("first_review_year").alias("_year"))
    return (listings.join(facts, "cid", "left")
            .withColumns({"reviews_fetched": F.coalesce("reviews_fetched", "_got"),
                          "first_review_year": F.coalesce("first_review_year", "_year")})
            .drop("_got", "_year"))


def harvestable(verdicts: DataFrame, everything: bool = False, limit: int | None = None) -> DataFrame:
    """Businesses whose reviews can be addressed: a hex id pair, qualified
    unless ``everything``."""
    out = verdicts.filter(F.col("cid").rlike(HEX_PAIR))
    if not everything:
        out = out.filter(F.col("outcome") == QUALIFIED)
    return out.orderBy("cid").limit(limit) if limit else out


def reviews_of(reviews: DataFrame, verdicts: DataFrame, everything: bool = False) -> DataFrame:
    """Reviews of the harvestable businesses, tagged with the business name.

    Verdicts hold one row per id. A business with a third of all reviews is
    spread over tasks by the salted lookup.
    """
    from .matching import lookup

    names = harvestable(verdicts, everything).select("cid", F.col("name").alias("_name"),
                                                     F.lit(True).alias("_kept"))
    return (lookup(reviews.drop("business"), names, "cid", spread="id").filter("_kept")
            .withColumnRenamed("_name", "business").drop("_kept"))
