"""Counting a run: what was found, kept, rejected and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import QUALIFIED, REJECTED, UNEVALUATED


def run_stats(verdicts: DataFrame, discovered: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """One row of counters. Unevaluated rows stay out of the qualify rate:
    they are a gap, not a miss."""
    found = discovered.agg(F.count(F.lit(1)).alias("discovered"))
    out = F.col("outcome")
    counts = verdicts.agg(
        F.count(F.lit(1)).alias("deduped"), F.count_if(out == QUALIFIED).alias("qualified"),
        F.count_if(out == REJECTED).alias("rejected"), F.count_if(out == UNEVALUATED).alias("unevaluated"))
    seen = F.col("qualified") + F.col("rejected")
    rate = F.when(seen > 0, F.round(F.col("qualified") / seen, 4)).otherwise(F.lit(0.0))
    # Under a second the divisor is timer noise: no rate is given.
    pace = F.round(F.col("deduped") / F.lit(elapsed_seconds) * 60, 1) if (elapsed_seconds or 0) >= 1 \
        else F.lit(None).cast("double")
    return (counts.withColumn("discovered", found.scalar())
            .withColumns({"qualify_rate": rate, "per_minute": pace})
            .select("discovered", "deduped", "qualified", "rejected", "unevaluated", "qualify_rate", "per_minute"))


def rejections(verdicts: DataFrame) -> DataFrame:
    """Rejected rows per first failing rule."""
    return (verdicts.filter(F.col("outcome") == REJECTED)
            .groupBy(F.coalesce("rejected_by", F.lit("unknown")).alias("rejected_by"))
            .agg(F.count(F.lit(1)).alias("n")))


def funnel(verdicts: DataFrame) -> DataFrame:
    """Qualified against each rejection reason: rows and percent of all rows."""
    step = F.when(F.col("outcome") == REJECTED, F.coalesce("rejected_by", F.lit("unknown"))) \
        .otherwise(F.col("outcome"))
    counts = verdicts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    total = verdicts.agg(F.count(F.lit(1)).alias("all")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 2))


def score_distribution(verdicts: DataFrame, bins: int = 10) -> DataFrame:
    """Qualified rows per equal slice of 0..100; the top slice includes 100."""
    slot = F.least(F.width_bucket(F.col("score"), F.lit(0.0), F.lit(100.0), F.lit(bins)),
                   F.lit(bins).cast("long"))
    return (verdicts.filter((F.col("outcome") == QUALIFIED) & F.col("score").isNotNull())
            .groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"),
                                            F.max("score").alias("high")))


def terminal_status(stats: DataFrame, report: DataFrame | None = None,
                    stop_reason: Column | None = None, stopping: bool = False) -> DataFrame:
    """Adds ``status``: stopped, partial (something failed or was cut short) or done."""
    if stopping:
        return stats.withColumn("status", F.lit("stopped"))
    cut = F.coalesce(stop_reason, F.lit("")) != "" if stop_reason is not None else F.lit(False)
    if report is not None:
        bad = report.agg(F.coalesce(F.max(F.col("status").isin("failed", "fatal")), F.lit(False))
                         .alias("bad")).scalar()
        cut = cut | bad
    return stats.withColumn("status", F.when(cut, F.lit("partial")).otherwise(F.lit("done")))


def fold_report(report: DataFrame) -> DataFrame:
    """Per source: how many places failed, how many were empty, how many notes, and why it stopped itself.

    ``report_lines`` names them.
    """
    def distinct(kind: str, col: str) -> Column:
        return F.count_distinct(F.when(F.col("status") == kind, F.col(col)))
    return report.groupBy("source").agg(
        distinct("failed", "place").alias("failed_places"), distinct("empty", "place").alias("empty_places"),
        distinct("note", "why").alias("notes"),
        F.min(F.when(F.col("status") == "fatal", F.col("why"))).alias("fatal"))


def report_lines(report: DataFrame) -> DataFrame:
    """What sources told, line by line: ``(kind, what, why)``.

    A place that failed or was empty is named ``source/place`` and has its
    greatest reason; a note is ``source: note``, once; a source that stopped
    itself has its reasons joined.
    """
    status, source = F.col("status"), F.col("source")
    kind = F.when(status == "failed", F.lit("skipped")).when(status.isin("empty", "note"), status).when(
        status == "fatal", F.lit("error"))
    named = F.when(status == "note", F.concat_ws(": ", source, F.col("why"))).when(status == "fatal", source).otherwise(
        F.concat_ws("/", source, F.col("place")))
    lines = report.select(kind.alias("kind"), named.alias("what"), F.when(status != "note", F.col("why")).alias("why"))
    once = lines.filter("kind IS NOT NULL").distinct()
    joined = F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == "error", F.col("why")))), "; ")
    return once.groupBy("kind", "what").agg(
        F.when(F.col("kind") == "error", joined).otherwise(F.max("why")).alias("why"))


def full_stats(verdicts: DataFrame, discovered: DataFrame, report: DataFrame, stop: DataFrame,
               withheld: DataFrame | None = None, resumed: DataFrame | None = None,
               elapsed_seconds: float | None = None) -> DataFrame:
    """One row that tells a whole run: ``run_stats`` over the rows it reached, and what it left out and why.

    ``verdicts`` carry ``fate``. Maps hold an entry for each rule that rejected
    and each source that failed; places are counted here and named by ``report_lines``.
    """
    fate = F.col("fate")
    reached = verdicts.filter(fate != "unreached")
    row = run_stats(reached, discovered, elapsed_seconds)
    soft = reached.agg(F.count_if(fate == "hidden").alias("n")).scalar()
    spent = F.sum("requests") if "requests" in verdicts.columns else F.lit(0)
    reasons = rejections(reached).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rejected_by", "n")))).alias("m"))
    folded = fold_report(report)
    errors = folded.filter("fatal IS NOT NULL").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "fatal")))).alias("m"))
    count = lambda df: F.lit(0).cast("long") if df is None else df.agg(F.count(F.lit(1)).alias("n")).scalar()     # noqa: E731
    decided = None if resumed is None else resumed.filter(F.col("outcome") != UNEVALUATED).select("cid").distinct()
    out = row.withColumns({
        "unreached": verdicts.agg(F.count_if(fate == "unreached").alias("n")).scalar(),
        "suppressed_hard": count(withheld), "suppressed_soft": soft, "resumed": count(decided),
        "requests": reached.agg(F.coalesce(spent, F.lit(0)).cast("long").alias("n")).scalar(),
        "rejected_by": reasons.scalar(), "source_errors": errors.scalar(),
        "skipped_places": folded.agg(F.coalesce(F.sum("failed_places"), F.lit(0).cast("long")).alias("n")).scalar(),
        "empty_places": folded.agg(F.coalesce(F.sum("empty_places"), F.lit(0).cast("long")).alias("n")).scalar(),
        "notes": folded.agg(F.coalesce(F.sum("notes"), F.lit(0).cast("long")).alias("n")).scalar(),
        "stopped_reason": stop.select("stopped_reason").scalar(),
        "elapsed": F.round(F.lit(elapsed_seconds).cast("double"), 2)})
    out = out.withColumn("suppressed", F.col("suppressed_hard") + F.col("suppressed_soft"))
    return terminal_status(out, report, F.col("stopped_reason"))


def new_rows_per_unit(fetched: DataFrame) -> DataFrame:
    """Per unit of work: rows fetched and rows no earlier unit brought.

    A business is new to the unit that brought it first.
    """
    firsts = (fetched.groupBy("cid").agg(F.min_by("unit", "ord").alias("unit"))
              .groupBy("unit").agg(F.count(F.lit(1)).alias("new")))
    totals = fetched.groupBy("unit").agg(F.count(F.lit(1)).alias("fetched"))
    return (totals.join(firsts, "unit", "left").withColumn("new", F.coalesce("new", F.lit(0).cast("long")))
            .withColumn("duplicates", F.col("fetched") - F.col("new")))


def spend(facts_used: DataFrame) -> DataFrame:
    """One row: lookups charged. A cached answer is charged nothing."""
    return facts_used.agg(F.coalesce(F.sum("requests"), F.lit(0).cast("long")).alias("requests"),
                          F.count(F.lit(1)).alias("answers"),
                          F.count_if(F.col("requests") == 0).alias("from_cache"))


UNIT_STATES = ("pending", "running", "done", "failed", "deferred")


def unit_counts(units: DataFrame) -> DataFrame:
    """Units per state, all five states present."""
    from .memory import zero_filled
    counts = units.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "state", UNIT_STATES)


def pending_units(units: DataFrame) -> DataFrame:
    return units.agg(F.count_if(F.col("state").isin("pending", "deferred", "running")).alias("pending"))


def failed_units(units: DataFrame) -> DataFrame:
    return units.filter(F.col("state") == "failed").select("kind", "key", "error")
