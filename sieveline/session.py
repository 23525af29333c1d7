"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What every plan in this package assumes. A cluster sets its own parallelism;
# AQE coalesces shuffle partitions down from whatever it is given.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Judging a row costs far more than shipping it: keep cores busy on small
    # shuffles. Large ones are still cut by the advisory size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # A verdict has more (nested) fields than the default for fused code.
    "spark.sql.codegen.maxFields": "400",
    # The JVM leaves methods beyond 8000 bytes uncompiled. A fused stage that
    # grows past that runs as separate, compiled projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Plans here are built from many columns; recording a Python call site for
    # each of them costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "sieveline", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine that names none gets a folder of its own; on a
    cluster that would be a different disk for every executor, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-sieveline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For a stage two branches consume: it is computed once, its lineage is cut,
    and a lost executor re-reads files instead of re-running the stage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


class Scratch:
    """Settled tables of one operator, removed when they have served.

    ``drop`` removes a table that a later one has replaced; leaving the scope
    removes all that were not handed out with ``keep``.
    """

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for df, _ in list(self.paths.values()):
            self.drop(df)

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made = df.sparkSession.read.parquet(path)
        self.paths[id(made)] = made, path
        return made

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` for good: it is settled elsewhere than the scope's tables."""
        return settle(df, "kept")

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if df is not None and id(df) in self.paths:
                _, path = self.paths.pop(id(df))
                spark = df.sparkSession
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
