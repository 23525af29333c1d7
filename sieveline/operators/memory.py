"""What a run has already dealt with: do-not-contact, unchanged verdicts,
resumed work, and the difference between two judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import OUTCOMES, UNEVALUATED
from .listings import first_per_key


def _seconds(after) -> int | None:
    from ..plans.brief import duration
    return duration(after)


def suppression_list(*lists: DataFrame, cids=()) -> DataFrame:
    """Lists, then ids named in the brief; a later entry replaces an earlier one."""
    from functools import reduce

    frames = [df.select(F.lower(F.trim("cid")).alias("cid"),
                        F.col("suppressed_at").cast("timestamp").alias("suppressed_at"),
                        F.lit(i).alias("_rank")) for i, df in enumerate(lists)]
    if cids:
        spark = lists[0].sparkSession if lists else _active()
        frames.append(spark.createDataFrame([(str(c).lower(),) for c in cids], "cid string").select(
            "cid", F.lit(None).cast("timestamp").alias("suppressed_at"), F.lit(len(lists)).alias("_rank")))
    both = reduce(lambda a, b: a.unionByName(b), frames)
    return (both.filter(F.coalesce("cid", F.lit("")) != "")
            .transform(lambda d: first_per_key(d, "cid", [F.col("_rank").desc(), "suppressed_at"]))
            .drop("_rank"))


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.active()


def in_force(suppressions: DataFrame, after=None, now: Column | None = None) -> DataFrame:
    """Entries still hiding their business: undated ones always, dated ones
    until ``after`` has passed (never, when no ``after`` is given)."""
    seconds = _seconds(after)
    if seconds is None:
        return suppressions
    now = F.current_timestamp() if now is None else now
    age = F.unix_timestamp(now) - F.unix_timestamp("suppressed_at")
    return suppressions.filter(F.col("suppressed_at").isNull() | (age <= seconds))


def without_suppressed(listings: DataFrame, suppressions: DataFrame, after=None,
                       now: Column | None = None) -> DataFrame:
    """Listings not on the list. Both sides are keyed on identity, so the join
    is even; Spark broadcasts the list when its measured size allows."""
    hidden = in_force(suppressions, after, now).select(F.lower("cid").alias("cid"))
    return listings.join(hidden, "cid", "left_anti")


def suppressed(listings: DataFrame, suppressions: DataFrame, after=None, now=None) -> DataFrame:
    hidden = in_force(suppressions, after, now).select(F.lower("cid").alias("cid"))
    return listings.join(hidden, "cid", "left_semi")


def mark_unchanged(verdicts: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Adds ``hidden`` (same outcome as before) and ``resurfaced`` (it moved)."""
    if prior is None:
        return verdicts.withColumns({"hidden": F.lit(False), "resurfaced": F.lit(False)})
    was = prior.select(F.lower("cid").alias("cid"), F.col("outcome").alias("_was"))
    old, now = F.col("_was"), F.col("outcome")
    return (verdicts.join(was, "cid", "left")
            .withColumns({"hidden": F.coalesce(old == now, F.lit(False)),
                          "resurfaced": F.coalesce(old != now, F.lit(False))}).drop("_was"))


def undecided(listings: DataFrame, journal: DataFrame) -> DataFrame:
    """What a resumed run still has to judge: everything but decided rows."""
    done = journal.filter(F.col("outcome") != UNEVALUATED).select(F.lower("cid").alias("cid"))
    return listings.join(done, "cid", "left_anti")


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """New verdicts over old ones; a business in both keeps the new row."""
    kept = old.join(new.select("cid"), "cid", "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def suppression_report(listings: DataFrame, verdicts: DataFrame, suppressions: DataFrame,
                       prior: DataFrame | None = None, after=None, now=None) -> DataFrame:
    """One row: entries, hidden_hard, hidden_soft, resurfaced."""
    marked = mark_unchanged(verdicts, prior)
    soft = marked.agg(F.count_if("hidden").alias("hidden_soft"),
                      F.count_if("resurfaced").alias("resurfaced"))
    hard = suppressed(listings, suppressions, after, now).agg(F.count(F.lit(1)).alias("hidden_hard"))
    entries = suppressions.agg(F.count(F.lit(1)).alias("hard_entries"))
    return _side_by_side(entries, hard, soft)


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    out = rows[0].withColumn("_k", F.lit(1))
    for row in rows[1:]:
        out = out.join(row.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Businesses whose outcome moved: cid, name, was, now, reason."""
    was = before.select("cid", F.coalesce("outcome", F.lit("unknown")).alias("was"))
    now = after.select("cid", "name", F.col("outcome").alias("now"), F.col("reject_reason").alias("reason"))
    return (now.join(was, "cid", "left").withColumn("was", F.coalesce("was", F.lit("unknown")))
            .filter(F.col("was") != F.col("now")).select("cid", "name", "was", "now", "reason"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    return changes(before, after).groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(verdicts: DataFrame) -> DataFrame:
    """Rows per outcome, the three of them always present."""
    counts = verdicts.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "outcome", OUTCOMES)


def zero_filled(counts: DataFrame, key: str, wanted) -> DataFrame:
    planned = counts.sparkSession.createDataFrame([(w,) for w in wanted], f"{key} string")
    return planned.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
