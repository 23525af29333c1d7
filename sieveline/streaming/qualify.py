"""Continuous qualification of newly landed listings.

Free signals need only the row, so a stream is judged by the batch plan, with
``chain_size`` at low confidence unless a stored brand tally is given. Each
micro-batch lands under its batch id, so a replay after a failure replaces its
own files and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..model import LISTING, conform
from ..operators import memory
from ..operators.listings import first_seen
from ..plans.brief import Brief
from ..plans.judge import Inputs, judge


def listing_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    return (spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_trigger)
            .format(fmt).load(path))


def fresh(stream: DataFrame, seen: DataFrame | None = None, suppressions: DataFrame | None = None,
          after=None, now=None) -> DataFrame:
    """Listings not met before: not in ``seen`` (an earlier run), not
    suppressed, and not earlier in this stream.

    The stream's own memory of ids is kept in the state store, keyed and
    partitioned by id.
    """
    out = conform(stream)
    if seen is not None:
        out = out.join(seen.select(F.lower("cid").alias("cid")), "cid", "left_anti")
    if suppressions is not None:
        out = memory.without_suppressed(out, suppressions, after, now)
    return out.dropDuplicates(["cid"])


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt anew before they are judged, which costs far more than moving them.

    The memory of ids deals rows by their id's hash. Landed files are often
    dealt by it too, and then a batch of some files falls into some of the
    memory's partitions; a second hash fills all.
    """
    return rows.repartition(F.xxhash64("cid"))


def judged(stream: DataFrame, brief: Brief) -> DataFrame:
    """Verdicts by the free rules alone, as a streaming DataFrame."""
    return judge(spread(stream), brief, dedupe=False, tally=False)


def start(stream: DataFrame, brief: Brief, out: str, checkpoint: str, inputs: Inputs | None = None,
          prior: DataFrame | None = None, tally: DataFrame | None = None, available_now: bool = True,
          single: bool = True):
    """Judge each micro-batch and append it under ``out``.

    ``prior`` holds earlier verdicts: rows whose outcome has not moved are
    marked hidden. Paid tiers join ``inputs`` per batch.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        rows = first_seen(conform(batch)) if single else batch
        verdicts = judge(spread(rows), brief, inputs, dedupe=False, tally=tally is not None, tally_table=tally)
        marked = memory.mark_unchanged(verdicts, prior)
        marked.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_for(query, seconds: float | None) -> str:
    """Wait for a query up to its runtime budget; returns its terminal status."""
    finished = query.awaitTermination(seconds) if seconds else (query.awaitTermination() or True)
    if not finished:
        query.stop()
        return "partial"
    return "done"


def changed_only(marked: DataFrame) -> DataFrame:
    """The feed of verdicts that are new or moved."""
    return marked.filter(~F.col("hidden"))


def with_progress(stream: DataFrame, name: str = "progress") -> DataFrame:
    """Counts each batch reports to listeners while it runs."""
    return stream.observe(name, F.count(F.lit(1)).alias("found"),
                          F.count_if(F.col("outcome") == "qualified").alias("qualified"),
                          F.count_if(F.col("outcome") == "rejected").alias("rejected"))


class ProgressLog(StreamingQueryListener):
    """Collects progress events as plain tuples ``(event, counters)``."""

    def __init__(self):
        self.events: list[tuple] = []

    def onQueryStarted(self, event):
        self.events.append(("start", {}))

    def onQueryProgress(self, event):
        observed = {k: v.asDict() for k, v in event.progress.observedMetrics.items()}
        self.events.append(("progress", {"rows": event.progress.numInputRows, **observed}))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.events.append(("done" if event.exception is None else "failed", {}))
