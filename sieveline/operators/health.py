"""Is discovery bringing what it should? Yields against a run's own baseline.

The baseline is the median of the upper half of the non-empty yields. Both it
and its running form are read from counts per distinct yield, so a source that
made a third of all searches is never collected into one task.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle
from .ordered import running_total, with_halo

# the block function travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WARMUP = 3
COLLAPSE = 0.6
RECENT = 5
PAGE_CAPS = (10, 20)
CAP_HEADROOM = 2.0
DIGIT = 10                   # bits of a yield settled at a time
DIGITS = 1 << DIGIT
STRETCH = 64                 # rows compared one by one between two counts


def place_yields(listings: DataFrame, planned: DataFrame) -> DataFrame:
    """Listings per planned place, in plan order; a place without any is 0."""
    found = (listings.filter(F.col("place_label").isNotNull())
             .groupBy(F.col("place_label").alias("place")).agg(F.count(F.lit(1)).alias("found")))
    return planned.join(found, "place", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def baseline(yields: DataFrame, per: str = "source") -> DataFrame:
    """``per`` -> baseline, exact, from the distinct yields and how often each
    occurs. Null below three non-empty searches."""
    counts = yields.filter(F.col("found") >= 1).groupBy(per, "found").agg(F.count(F.lit(1)).alias("times"))
    by_value = W.partitionBy(per).orderBy("found")
    whole = W.partitionBy(per)
    ranked = counts.select(per, "found",
                           F.sum("times").over(by_value).alias("upto"),
                           (F.sum("times").over(by_value) - F.col("times")).alias("below"),
                           F.sum("times").over(whole).alias("n"))
    # Sorted ascending, the upper half starts at n // 2; its median is the mean
    # of the two middle places (the same place when the half is odd).
    start = F.floor(F.col("n") / 2)
    half = F.col("n") - start
    lo, hi = start + F.floor((half - 1) / 2), start + F.floor(half / 2)
    holds = lambda at: (F.col("below") <= at) & (at < F.col("upto"))      # noqa: E731
    return (ranked.groupBy(per).agg(F.max("n").alias("_n"),
                                    F.max(F.when(holds(lo), F.col("found"))).alias("_lo"),
                                    F.max(F.when(holds(hi), F.col("found"))).alias("_hi"))
            .select(per, F.when(F.col("_n") >= WARMUP, (F.col("_lo") + F.col("_hi")) / 2).alias("baseline")))


def diagnose(found: Column, base: Column) -> Column:
    """Why a yield looks wrong against its baseline, or null."""
    capped = found.isin(*PAGE_CAPS) & (base >= found * CAP_HEADROOM)
    return (F.when(base.isNull(), F.lit(None).cast("string"))
            .when(found == 0, F.lit("zero"))
            .when(capped, F.lit("page_cap"))
            .when(found < base * COLLAPSE, F.lit("collapse")))


def running_health(yields: DataFrame, per: str = "source", order: str = "pos",
                   size: int = 4096) -> DataFrame:
    """Each search against the baseline of the searches up to it: adds
    ``baseline``, ``reason`` and ``back_off``. ``order`` is a unique whole
    number within each ``per``.

    A running order statistic, found digit by digit (``_descend``): neither a
    source's history nor its distinct yields are ever held by one task.
    """
    df = settle(running_total(yields, order, {"rn": F.lit(1), "_n": (F.col("found") >= 1).cast("long")}, per=per), "searches")
    base = _running_baseline(df, per, size)
    same = F.col(per).eqNullSafe(F.col("_per")) & (F.col("rn") == F.col("_t"))
    out = with_halo(df.drop("_n").join(base, same, "left").drop("_per", "_t"), "rn", RECENT - 1)
    trail = W.partitionBy(per, "_block").orderBy("rn").rowsBetween(1 - RECENT, 0)
    recent = F.avg("found").over(trail)
    seen = F.count(F.lit(1)).over(trail)
    return (out.withColumns({
        "reason": diagnose(F.col("found"), F.col("baseline")),
        "back_off": F.coalesce((seen >= RECENT) & (recent < F.col("baseline") * COLLAPSE), F.lit(False))})
        .filter("_own").drop("_block", "_own", "rn"))


def _running_baseline(df: DataFrame, per: str, size: int) -> DataFrame:
    """``_per, _t, baseline`` of each search by which enough were non-empty; ``df`` has ``rn`` and ``_n``, the non-empty ones so far."""
    most = df.agg(F.max("found")).first()[0] or 0
    levels = max(1, -(-int(most).bit_length() // DIGIT))
    key = F.col(per).alias("_per")
    values = df.filter("found >= 1").select(key, F.col("rn").alias("_t"), F.col("found").cast("long").alias("_value"))
    # of the n non-empty yields so far, in order, the upper half starts at n // 2
    ranks = F.array(F.expr("_n div 2 + (_n - _n div 2 - 1) div 2"), F.expr("_n div 2 + (_n - _n div 2) div 2"))
    asked = df.filter(F.col("_n") >= WARMUP).select(key, F.col("rn").alias("_t"), F.posexplode(ranks).alias("_which", "_rank")) \
        .withColumn("_prefix", F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        asked = _descend(values, asked, level, size)
    return asked.groupBy("_per", "_t").agg(F.avg("_prefix").alias("baseline"))


def block_stock(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per digit of all earlier blocks, for each block of ``keys`` but the first. A block has at least as many
    rows as there are digits, so these rows are never more than the input's."""
    counts = rows.filter("_digit IS NOT NULL").groupBy(*keys, "_block", "_digit").agg(F.count(F.lit(1)).alias("_times"))
    blocks = rows.groupBy(*keys).agg(F.max("_block").alias("_last")).filter("_last > 0").select(
        *[F.col(k).alias(f"_of{k}") for k in keys], "_last")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys])
    grid = counts.select(*keys, "_digit").distinct().join(blocks, same).select(
        *keys, "_digit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_block"), F.lit(0).alias("_times"))
    whole = counts.unionByName(grid).groupBy(*keys, "_digit", "_block").agg(F.sum("_times").alias("_times"))
    before = W.partitionBy(*keys, "_digit").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return whole.withColumn("_times", F.sum("_times").over(before)).filter("_times > 0")


def _descend(values: DataFrame, asked: DataFrame, level: int, size: int) -> DataFrame:
    """``asked`` with one more digit of the value that has its rank among the values up to it.

    ``values`` has ``_per, _t, _value``; ``asked`` has ``_per, _t, _which, _rank`` and ``_prefix``, the digits found so far.
    Values and questions of one prefix stand in one order and are cut into
    blocks; a block knows how often each digit came before it.
    """
    shift = DIGIT * level
    own = values.select("_per", F.shiftright("_value", shift + DIGIT).alias("_prefix"), (F.col("_t") * 3).alias("_seq"),
                        F.shiftright("_value", shift).bitwiseAND(DIGITS - 1).alias("_digit"), F.lit(None).cast("long").alias("_rank"))
    questions = asked.select("_per", "_prefix", (F.col("_t") * 3 + 1 + F.col("_which")).alias("_seq"),
                             F.lit(None).cast("long").alias("_digit"), "_rank")
    keys = ["_per", "_prefix"]
    rows = running_total(own.unionByName(questions), "_seq", {"_nth": F.lit(1)}, per=keys).withColumn(
        "_block", F.floor((F.col("_nth") - 1) / max(size, DIGITS)))
    rows = settle(rows, "digits")
    stock = block_stock(rows, keys).select(*keys, F.lit(None).cast("long").alias("_seq"), "_digit", F.lit(None).cast("long").alias("_rank"),
                                           "_block", F.col("_times").cast("long").alias("_times"))
    fed = rows.select(*keys, "_seq", "_digit", "_rank", "_block", F.lit(1).cast("long").alias("_times")).unionByName(stock)
    kind = values.schema["_per"].dataType.simpleString()
    found = fed.groupBy(*keys, "_block").applyInPandas(
        _bisect, f"_per {kind}, _prefix long, _seq long, _rank long")
    return found.select("_per", F.expr("_seq div 3").alias("_t"), (F.col("_seq") % 3 - 1).cast("int").alias("_which"), "_rank", "_prefix")


def _bisect(frame: pd.DataFrame) -> pd.DataFrame:
    """A block's questions, all bisected at once: on counts cumulated over digits and stretches of ``STRETCH`` rows, and the rows of the stretch."""
    stock, rows = frame[frame["_seq"].isna()], frame[frame["_seq"].notna()].sort_values("_seq")
    n = len(rows)
    value = rows["_digit"].notna().to_numpy()
    digit = np.where(value, rows["_digit"].fillna(0).to_numpy(), DIGITS).astype(np.int64)        # beyond all for a question
    stretch = np.arange(n) // STRETCH
    upto = np.zeros((stretch[-1] + 2 if n else 1, DIGITS), np.int64)
    np.add.at(upto, (stretch[value] + 1, digit[value]), 1)
    np.add.at(upto, (np.zeros(len(stock), np.int64), stock["_digit"].to_numpy(np.int64)), stock["_times"].to_numpy(np.int64))
    upto = upto.cumsum(0).cumsum(1)                                                          # [stretch, digit]: before it, at most the digit
    inside = np.concatenate([digit, np.full(-n % STRETCH, DIGITS)]).reshape(-1, STRETCH)
    at = np.flatnonzero(~value)
    rank = rows["_rank"].to_numpy()[at].astype(np.int64)
    before = np.arange(STRETCH) < (at % STRETCH)[:, None]

    def count(most: np.ndarray) -> np.ndarray:
        """How many values before each question are ``most`` or less."""
        held = np.where(most < 0, 0, upto[stretch[at], np.maximum(most, 0)])
        return held + ((inside[stretch[at]] <= most[:, None]) & before).sum(1)

    low, high = np.zeros(len(at), np.int64), np.full(len(at), DIGITS - 1)
    for _ in range(DIGIT):
        middle = (low + high) // 2
        left = count(middle) > rank
        low, high = np.where(left, low, middle + 1), np.where(left, middle, high)
    return pd.DataFrame({"_per": rows["_per"].to_numpy()[at], "_prefix": rows["_prefix"].to_numpy()[at].astype(np.int64) * DIGITS + high,
                         "_seq": rows["_seq"].to_numpy()[at].astype(np.int64), "_rank": rank - count(high - 1)})


def summary(yields: DataFrame, per: str = "source", order: str = "pos") -> DataFrame:
    """One row per source: searches, found, zeros, suspects, baseline, verdict."""
    traced = running_health(yields, per, order)
    counts = traced.groupBy(per).agg(
        F.count(F.lit(1)).alias("searches"), F.sum("found").alias("found"),
        F.count_if(F.col("found") == 0).alias("zero_results"),
        F.count(F.col("reason")).alias("suspects"))
    out = counts.join(baseline(yields, per), per, "left")
    expected = F.col("baseline") * F.col("searches")
    share = F.col("found") / expected
    return out.withColumns({
        "expected": expected, "yield_pct": F.round(share * 100, 1),
        "verdict": F.when(F.col("baseline").isNull(), F.lit("unknown")).when(share >= 0.9, F.lit("healthy"))
        .when(share >= 0.6, F.lit("degraded")).otherwise(F.lit("throttled"))})


def failure_rate(measured: DataFrame, failed: Column) -> DataFrame:
    """One row: total, failures, fail_rate over everything measured."""
    return measured.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failures")).withColumn(
        "fail_rate", F.coalesce(F.try_divide("failures", "total"), F.lit(0.0)))


def field_coverage(listings: DataFrame, per: str | None = None) -> DataFrame:
    """How many records carried each optional field."""
    return listings.groupBy(*([per] if per else [])).agg(
        F.count(F.lit(1)).alias("records"), F.count("review_count").alias("review_count"),
        F.count("status_raw").alias("status"), F.count("hours").alias("hours"))
