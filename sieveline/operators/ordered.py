"""Operators that depend on discovery order, without one task ordering it all.

A running total over all rows is taken in two steps: totals per block of
consecutive rows, then rows within their block plus what came before it. Blocks
hold like numbers of rows whatever gaps the order key has: Spark cuts them from
a sample of its values. The cut rows are written once to the shared folder, so
every later step sees the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

ROWS_PER_BLOCK = 100_000


def _keys(per: str | list[str] | None) -> list[str]:
    return [per] if isinstance(per, str) else list(per or [])


def _blocked(df: DataFrame, order: str, blocks: int | None, per: str | list[str] | None = None) -> DataFrame:
    """Adds ``_block``: consecutive rows in ``order`` (within each ``per`` key), cut by their number."""
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(per)
    return settle(df.repartitionByRange(blocks, *keys, order).withColumn("_block", F.spark_partition_id()), "ordered")


def running_total(df: DataFrame, order: str, totals: dict[str, Column], blocks: int | None = None,
                  per: str | list[str] | None = None) -> DataFrame:
    """Adds inclusive running sums in ``order`` (a unique whole number), all
    rows together or within each ``per`` key."""
    keys = _keys(per)
    df = _blocked(df.withColumns({f"_v_{k}": v for k, v in totals.items()}), order, blocks, per)
    sums = df.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{k}").alias(f"_b_{k}") for k in totals])
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_at"), *[
        F.coalesce(F.sum(f"_b_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in totals])
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # One offset for each block when there is no ``per`` key: broadcast is safe.
    joined = df.join(offsets if per else F.broadcast(offsets), same)
    return (joined.withColumns({k: F.sum(f"_v_{k}").over(inside) + F.col(f"_o_{k}") for k in totals})
            .drop("_block", "_at", *[f"_k_{k}" for k in keys], *[f"_v_{k}" for k in totals], *[f"_o_{k}" for k in totals]))


def numbered(df: DataFrame, order: str, name: str = "rn", per: str | None = None) -> DataFrame:
    """Adds each row's place in the whole order, from 1."""
    return running_total(df, order, {name: F.lit(1)}, per=per)


def with_halo(df: DataFrame, index: str, reach: int, size: int = ROWS_PER_BLOCK) -> DataFrame:
    """Even blocks of ``size`` consecutive rows, each also holding the ``reach``
    rows before it (``_own`` is false on those), so a trailing window of
    ``reach + 1`` rows never looks outside its block."""
    size = max(size, reach + 1)
    at = F.col(index) - 1
    home = F.floor(at / size)
    also = F.when((at % size) >= size - reach, home + 1) if reach else F.lit(None)
    return (df.withColumn("_home", home)
            .withColumn("_block", F.explode(F.array_compact(F.array(home, also.cast("long")))))
            .withColumn("_own", F.col("_block") == F.col("_home")).drop("_home"))


def breaker_trace(measured: DataFrame, failed: Column, order: str = "ord", rate: float = 0.4,
                  window: int = 20, min_sample: int = 10, per: str | None = None) -> DataFrame:
    """Adds ``rn``, ``fail_rate`` over the trailing ``window`` rows, and ``over``
    where the rate is reached on enough rows."""
    keys = [per] if per else []
    df = numbered(measured.withColumn("_failed", failed.cast("int")), order, "rn", per)
    df = with_halo(df, "rn", window - 1)
    trail = W.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(1 - window, 0)
    seen = F.count(F.lit(1)).over(trail)
    share = F.sum("_failed").over(trail) / seen
    return (df.withColumns({"fail_rate": share, "_seen": seen}).filter("_own")
            .withColumn("over", (F.col("_seen") >= min_sample) & (F.col("fail_rate") >= rate))
            .drop("_failed", "_seen", "_block", "_own"))


def trip_point(trace: DataFrame, order: str = "ord") -> DataFrame:
    """One row: where the breaker tripped (null when it never did)."""
    return trace.agg(F.min(F.when(F.col("over"), F.col(order))).alias("trip"))


def before_trip(trace: DataFrame, order: str = "ord") -> DataFrame:
    """Rows up to and including the one that tripped the breaker."""
    trip = trip_point(trace, order).scalar()
    return trace.filter(trip.isNull() | (F.col(order) <= trip))


def result_cap(verdicts: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """Verdicts in order until the ``n``-th qualified one, which is the last."""
    df = running_total(verdicts, order, {"_good": (F.col("outcome") == "qualified").cast("int")})
    before = F.col("_good") - (F.col("outcome") == "qualified").cast("int")
    return df.filter(before < n).drop("_good")


def within_budget(candidates: DataFrame, cost: Column, budget: int, order: str = "ord") -> DataFrame:
    """Adds ``spent`` (running cost) and ``affordable``. Once the budget is
    spent every later row is left unmeasured."""
    df = running_total(candidates, order, {"spent": cost})
    return df.withColumn("affordable", F.col("spent") <= F.lit(budget))


def apply_limits(verdicts: DataFrame, max_results: int | None = None, rate: float = 0.4,
                 window: int = 20, min_sample: int = 10, max_requests: int | None = None) -> DataFrame:
    """Adds ``fate`` to marked verdicts: shown, hidden or unreached.

    The breaker counts every judged row, hidden ones included, and stops the
    run after the row that trips it. The cap stops it after the first shown row
    by which enough have qualified, the budget after the row that spends the
    last of ``max_requests`` (by the column ``requests``).
    """
    return limited(verdicts, max_results, rate, window, min_sample, max_requests)[0]


STOPS = {"breaker": "too many measurements failed", "results": "result cap reached", "requests": "request budget reached"}


def limited(verdicts: DataFrame, max_results: int | None = None, rate: float = 0.4, window: int = 20,
            min_sample: int = 10, max_requests: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``apply_limits``, and one row: ``stopped_at`` (``ord``) and ``stopped_reason`` of the limit that is met first,
    nulls where none is."""
    session = verdicts.sparkSession
    stops = _stops(verdicts, max_results, rate, window, min_sample, max_requests)
    # one row: found once, whoever reads it and however often
    row = settle(session.range(0, 1, 1, 1).select(*[s.scalar().alias(k) for k, s in stops.items()]), "stops")
    reached = F.lit(True)
    for k in stops:
        at = row.select(k).scalar()
        reached = reached & (at.isNull() | (F.col("ord") <= at))
    out = verdicts.withColumn("fate", F.when(~reached, F.lit("unreached"))
                              .when(F.col("hidden"), F.lit("hidden")).otherwise(F.lit("shown")))
    first = F.least(*[F.col(k) for k in stops], F.lit(None).cast("long"))
    reason = F.coalesce(*[F.when(F.col(k) == F.col("stopped_at"), F.lit(STOPS[k])) for k in stops])
    return out, row.withColumn("stopped_at", first).select("stopped_at", reason.alias("stopped_reason"))


def _stops(verdicts: DataFrame, max_results, rate, window, min_sample, max_requests) -> dict[str, DataFrame]:
    """For each limit that is set one row: the ``ord`` it is met at.

    Only what the limits count is put in order, never whole verdicts.
    """
    from .rules import failed_signals

    asked = [F.col("requests")] if max_requests else []
    counted = verdicts.select("ord", "outcome", "hidden", *asked, (F.size(failed_signals(verdicts)) > 0).alias("_broken"))
    stops = {"breaker": trip_point(breaker_trace(counted.select("ord", "_broken"), F.col("_broken"), "ord", rate, window, min_sample))}
    sums = {"_good": (F.col("outcome") == "qualified").cast("int")} if max_results else {}
    sums |= {"_spent": F.col("requests")} if max_requests else {}
    if sums:
        counted = running_total(counted.drop("_broken"), "ord", sums)
    if max_results:
        stops["results"] = counted.filter(~F.col("hidden") & (F.col("_good") >= max_results)).agg(F.min("ord").alias("at"))
    if max_requests:
        stops["requests"] = counted.filter(F.col("_spent") >= max_requests).agg(F.min("ord").alias("at"))
    return stops
