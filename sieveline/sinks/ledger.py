"""The verdict ledger: runs, verdicts and units of work as parquet tables.

Verdicts are appended, never rewritten: each save of a run is a version of its
own, removals are rows that say so, and readers take the latest row of each id.
A run saved once is read as it lies. ``compact`` folds a run's versions into one.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listings import latest
from ..session import Scratch, settle

PLAIN_ID = re.compile(r"[\w.-]+")       # run ids that stand in a path as they are
VERSION, GONE = "_version", "_gone"


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException
        try:
            # versions of a run, and runs, may have grown fields
            return self.spark.read.option("mergeSchema", True).parquet(self._path(table))
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                return None
            raise

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    # -- verdicts

    def _run(self, run_id: str) -> str:
        """The folder of a run; ids that can't stand in a path are spelt in hex."""
        name = run_id if PLAIN_ID.fullmatch(run_id) and not run_id.startswith("x--") else "x--" + run_id.encode().hex()
        return f"verdicts/run_id={name}"

    def versions(self, run_id: str) -> list[int]:
        """The versions a run has, oldest first: as many as it was saved since it was last compacted."""
        where, fs = self._folder(self._path(self._run(run_id)))
        if not fs.exists(where):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(where)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(VERSION + "="))

    def _live(self, run_id: str, columns: list[str] | None = None) -> DataFrame | None:
        """The latest row of each id; ``columns`` besides it, or all."""
        versions = self.versions(run_id)
        rows = self._read(self._run(run_id)) if versions else None
        if rows is None:
            return None
        if columns is not None:
            rows = rows.select("cid", *columns, VERSION, GONE)
        if len(versions) > 1:
            rows = latest(rows, "cid", VERSION)
        return rows.filter(~F.col(GONE)).drop(VERSION, GONE)

    def verdicts(self, run_id: str, limit: int | None = None, offset: int = 0) -> DataFrame | None:
        """A run's rows by id; no other run is read."""
        rows = self._live(run_id)
        if rows is not None and limit is not None:
            rows = rows.orderBy("cid").offset(offset).limit(limit)
        return rows

    def outline(self, run_id: str) -> DataFrame:
        return self.verdicts(run_id).select("cid", "outcome", "score", "review_count", "name", "category", "address")

    def rows_for(self, run_id: str, cids: list[str]) -> DataFrame:
        return rows_for(self.verdicts(run_id), cids)

    def find(self, run_id: str, cid: str) -> DataFrame:
        """One row by id. The id is looked for in every version first, so that files that can't hold it are skipped."""
        rows = self._read(self._run(run_id)).filter(F.col("cid").isin(cid, cid.lower()))
        return find(latest(rows, "cid", VERSION).filter(~F.col(GONE)).drop(VERSION, GONE), cid)

    def _append(self, run_id: str, rows: DataFrame, gone: bool, version: int | None) -> None:
        """One version; writing the same version again replaces it."""
        version = time.time_ns() if version is None else version
        rows.withColumn(GONE, F.lit(gone)).sortWithinPartitions("cid").write.mode("overwrite").parquet(
            f"{self._path(self._run(run_id))}/{VERSION}={version}")

    def save(self, run_id: str, new: DataFrame, version: int | None = None) -> int:
        """Upsert by id; returns how many rows the run did not have.

        Only ``new`` is written. A ``version`` (a stream's batch number, say)
        makes a repeated save one with the first.
        """
        with Scratch() as scratch:
            new = scratch.settle(new, "new-verdicts")
            old = self._live(run_id, [])
            fresh = new.select("cid") if old is None else new.select("cid").join(old, "cid", "left_anti")
            n = fresh.count()
            self._append(run_id, new, False, version)
        return n

    def remove(self, run_id: str, cids: DataFrame, version: int | None = None) -> int:
        """Hides rows by id; returns how many the run had. Only their ids are written."""
        old = self._live(run_id, [])
        if old is None:
            return 0
        with Scratch() as scratch:
            gone = scratch.settle(old.join(cids.select("cid").distinct(), "cid", "left_semi"), "removed")
            n = gone.count()
            if n:
                self._append(run_id, gone, True, version)
        return n

    def compact(self, run_id: str) -> None:
        """Folds a run's versions into one. Older ones go, oldest first, after it is written: a reader sees the same rows throughout."""
        old = self.versions(run_id)
        if len(old) < 2:
            return
        self._append(run_id, self._live(run_id), False, max(time.time_ns(), old[-1] + 1))
        for version in old:
            where, fs = self._folder(f"{self._path(self._run(run_id))}/{VERSION}={version}")
            fs.delete(where, True)

    # -- runs: appended, the latest version of a run counts

    def record_run(self, run_id: str, name: str, state: str, started, finished=None,
                   stats: str = "{}", brief: str = "{}") -> None:
        row = [(run_id, name, state, started, finished, stats, brief, time.time_ns())]
        self.spark.createDataFrame(row, RUN).coalesce(1).write.mode("append").parquet(self._path("runs"))

    def _change_run(self, run_id: str, **changed: Column) -> None:
        """A run's record once more, with some of it changed."""
        now = self.runs().filter(F.col("run_id") == run_id)
        if now.isEmpty():
            raise KeyError(f"no run {run_id!r}")
        row = now.withColumns({**changed, "version": F.lit(time.time_ns())}).select(*[f.split()[0] for f in RUN.split(", ")])
        settle(row, "run").write.mode("append").parquet(self._path("runs"))

    def set_state(self, run_id: str, state: str, finished: float | None = None) -> None:
        """A run's state, and when it ended if it has."""
        ended = {} if finished is None else {"finished": F.lit(float(finished))}
        self._change_run(run_id, state=F.lit(state), **ended)

    def update_stats(self, run_id: str, stats: str) -> None:
        self._change_run(run_id, stats=F.lit(stats))

    def runs(self) -> DataFrame:
        rows = self._read("runs")
        if rows is None:
            rows = self.spark.createDataFrame([], RUN)
        return latest(rows, "run_id", "version")

    def prune(self, keep: int) -> list[str]:
        """Drop all but the newest finished runs, with everything they own."""
        runs = settle(self.runs(), "runs")
        gone = expired_runs(runs, keep)
        names = [r.run_id for r in gone.select("run_id").collect()]      # as many as runs pruned
        if not names:
            return []
        runs.join(gone.select("run_id"), "run_id", "left_anti").write.mode("overwrite").parquet(self._path("runs"))
        for name in names:
            where, fs = self._folder(self._path(self._run(name)))
            fs.delete(where, True)
        return names


RUN = ("run_id string, name string, state string, started double, finished double, stats string, "
       "brief string, version long")


def rows_for(verdicts: DataFrame, cids: list[str]) -> DataFrame:
    """Rows of the given ids in the given order; unknown ids are left out."""
    wanted = verdicts.sparkSession.createDataFrame(list(enumerate(cids)), "pos long, cid string")
    return verdicts.join(wanted, "cid").orderBy("pos")


def find(verdicts: DataFrame, cid: str) -> DataFrame:
    """One row by id: exact, else in the lower case that ids are stored in. Both are plain equalities, so row groups
    that can't hold the id are skipped."""
    hit = verdicts.filter(F.col("cid").isin(cid, cid.lower()))
    return hit.orderBy((F.col("cid") == cid).desc(), "cid").limit(1)


def listed_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.col("started").desc(), "run_id").limit(limit)


def unfinished(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("state") == "running").orderBy("started")


def reconciled(runs: DataFrame, now: Column) -> DataFrame:
    """Runs nothing executes any more are marked interrupted."""
    orphan = F.col("state") == "running"
    return runs.withColumns({"finished": F.when(orphan, now).otherwise(F.col("finished")),
                             "state": F.when(orphan, F.lit("interrupted")).otherwise(F.col("state"))})


def expired_runs(runs: DataFrame, keep: int) -> DataFrame:
    """Finished runs beyond the newest ``keep``."""
    done = runs.filter(F.col("state") != "running")
    newest = done.orderBy(F.coalesce("finished", "started").desc(), "run_id").limit(keep)
    return done.join(newest.select("run_id"), "run_id", "left_anti")


def kept_of(owned: DataFrame, runs: DataFrame, keep: int) -> DataFrame:
    """Rows owned by runs that are not expired."""
    return owned.join(expired_runs(runs, keep).select("run_id"), "run_id", "left_anti")


def run_summaries(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Runs as stored, their stats read tolerantly; unreadable ones are flagged."""
    stats = F.try_parse_json(F.coalesce(F.nullif("stats", F.lit("")), F.lit("{}")))
    good = F.coalesce(F.schema_of_variant(stats).startswith("OBJECT"), F.lit(False))
    count = lambda k: F.coalesce(F.try_variant_get(stats, f"$.{k}", "long"), F.lit(0).cast("long"))
    ended = F.coalesce("finished", "started", F.lit(0.0)) - F.coalesce("started", F.lit(0.0))
    out = runs.select("run_id", "name", F.col("state").alias("status"), "started", "finished",
                      F.round(ended, 1).alias("elapsed"), (~good).alias("unreadable"),
                      F.try_variant_get(stats, "$.error", "string").alias("error"),
                      *[count(k).alias(k) for k in ("qualified", "rejected", "unevaluated")])
    return out.join(totals, "run_id", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def remaining_units(planned: DataFrame, units: DataFrame) -> DataFrame:
    """Planned units a resumed run has still to do; declaring one twice is one."""
    done = units.filter(F.col("state") == "done").select("kind", "key")
    return planned.dropDuplicates(["kind", "key"]).join(done, ["kind", "key"], "left_anti")


def rebuilt_signal(stored: Column) -> Column:
    """A stored measurement read tolerantly from JSON: confidence clamped to
    0..1, junk read as 0, version 1 when missing."""
    doc = F.try_parse_json(stored)
    conf = F.try_variant_get(doc, "$.confidence", "double")
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.value", "variant"))
    return F.struct(
        F.when(kind == "STRING", F.try_variant_get(doc, "$.value", "string")).alias("vstr"),
        F.when(kind.rlike("BIGINT|DOUBLE|DECIMAL"), F.try_variant_get(doc, "$.value", "double")).alias("vnum"),
        F.when(kind == "BOOLEAN", F.try_variant_get(doc, "$.value", "boolean")).alias("vbool"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(conf, F.lit(0.0)))).alias("confidence"),
        F.nullif(F.try_variant_get(doc, "$.evidence.error", "string"), F.lit("")).alias("error"),
        F.coalesce(F.try_variant_get(doc, "$.version", "int"), F.lit(1)).alias("version"))


def known_outcome(outcome: Column) -> Column:
    return F.when(outcome.isin("qualified", "rejected", "unevaluated"), outcome).otherwise(F.lit("unevaluated"))
