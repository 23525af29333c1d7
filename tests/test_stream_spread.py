"""A stream's batch is judged by all partitions, however its files were dealt."""

import glob

from workload import briefs as B
from workload import inputs as I
from workload.landing_queries import folder

from sieveline.streaming import qualify

SF = "/root/testdata/sf0.001"


def test_files_dealt_by_id_are_judged_in_every_partition(spark):
    """Two of four files dealt by the hash of the id reached half of the memory's partitions, and were judged there."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    landing, out = folder(spark, "landing"), folder(spark, "streamed")
    I.listings(spark, SF).repartition(4, "cid").write.parquet(landing)
    stream = qualify.fresh(qualify.listing_stream(spark, landing, files_per_trigger=2))
    qualify.run_for(qualify.start(stream, B.dentists(), out, folder(spark, "mark"), single=False), None)
    assert len(glob.glob(f"{out.removeprefix('file:')}/batch_id=0/*.parquet")) == n
    assert spark.read.parquet(out).count() == I.listings(spark, SF).count()


def test_one_row_per_listing_within_a_batch(spark):
    """``single`` still keeps the first of a batch's rows of one id."""
    landing, out = folder(spark, "landing"), folder(spark, "streamed")
    rows = I.listings(spark, SF)
    rows.unionByName(rows).coalesce(1).write.parquet(landing)
    stream = qualify.listing_stream(spark, landing)
    qualify.run_for(qualify.start(stream, B.dentists(), out, folder(spark, "mark")), None)
    got = spark.read.parquet(out)
    assert got.count() == got.select("cid").distinct().count() == rows.count()
