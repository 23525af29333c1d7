"""Runs of whole briefs: torn sources, pages opened, budgets, the ledger's record."""

import json

from pyspark.sql import functions as F

from sieveline import Brief, Inputs
from sieveline.operators import ordered, page_signals
from sieveline.plans.execute import execute
from sieveline.sinks.ledger import Ledger
from sieveline.sources import registry as sources
from workload import inputs as I
from workload import run_queries as R

SMALL = "/root/testdata/sf0.001"
REVIEWED = [{"signal": "reviews", "op": ">=", "value": 5}]


def test_torn_file_costs_its_source_alone(spark, tmp_path):
    good, torn = str(tmp_path / "good"), tmp_path / "torn"
    I.listings(spark, SMALL).write.parquet(good)
    I.listings(spark, SMALL).repartition(2).write.parquet(str(torn))
    part = sorted(torn.glob("part-*"))[-1]
    body = part.read_bytes()
    part.write_bytes(body[:200] + b"\x00" * (len(body) // 2) + body[200 + len(body) // 2:])      # the footer still reads
    with R.table_sources():
        rows, report = sources.read_all(spark, [{"id": R.TABLE, "options": {"path": str(torn)}},
                                                {"id": R.TABLE, "options": {"path": good}}], land=True)
        assert [r.status for r in report.collect()] == ["fatal", "ok"]
        assert rows.count() == I.listings(spark, SMALL).count()
        rows, report = sources.read_all(spark, [{"id": R.TABLE, "options": {"path": str(torn)}}], land=True)
        assert rows.count() == 0 and [r.status for r in report.collect()] == ["fatal"]


def test_only_pages_asked_about_are_opened(spark):
    pages = I.site_pages(spark, SMALL)
    old = pages.withColumn("fetched_at", F.col("fetched_at") - F.make_dt_interval(F.lit(1)))     # a stale answer of each
    both = pages.unionByName(old)
    now = F.timestamp_seconds(F.lit(1767225600))
    asked = pages.select(page_signals.urls.normalise(F.col("url")).alias("address")).distinct().orderBy("address").limit(7)
    chosen = page_signals.chosen_pages(both, asked, now)
    assert chosen.select("url", "fetched_at").distinct().count() == chosen.count() <= 7
    facts = page_signals.facts_of(both, asked, F.lit(I.YEAR), now)
    whole = page_signals.site_facts(both, F.lit(I.YEAR), now)
    wanted = {r.address for r in asked.collect()}
    assert facts.orderBy("url").collect() == whole.filter(F.col("url").isin(*wanted)).orderBy("url").collect()
    assert page_signals.facts_of(both, asked.limit(0), F.lit(I.YEAR), now).count() == 0
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan                   # pages stay where they are scanned


def test_reducer_misses_no_key(spark):
    keys = spark.range(0, 5000, 7)
    hit = page_signals.among(spark.range(5000), F.col("id"), page_signals.reducer(keys, F.col("id")))
    got = {r.id for r in hit.collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 720
    assert page_signals.among(spark.range(9), F.col("id"), page_signals.reducer(keys.limit(0), F.col("id"))).count() == 0


def test_first_limit_met_is_the_reason(spark, make):
    rows = make(*[{"review_count": 9} for _ in range(30)]).select(
        "cid", "ord", F.lit("qualified").alias("outcome"), F.lit(False).alias("hidden"), F.lit(1).alias("requests"),
        F.struct(F.struct(F.lit(None).cast("string").alias("error")).alias("s")).alias("signals"))
    asks = [({}, None), ({"max_results": 5}, "result cap reached"), ({"max_requests": 4}, "request budget reached"),
            ({"max_results": 5, "max_requests": 4}, "request budget reached"),
            ({"max_results": 4, "max_requests": 4}, "result cap reached"), ({"max_requests": 31}, None)]
    for limits, why in asks:
        assert ordered.limited(rows, **limits)[1].first().stopped_reason == why, limits
    fates = ordered.apply_limits(rows, max_requests=4).groupBy("fate").count().collect()
    assert {r.fate: r["count"] for r in fates} == {"shown": 4, "unreached": 26}


def test_run_is_recorded_and_written(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cid,title,review_count\n" + "".join(f"x{i},Shop {i},{i}\n" for i in range(12)))
    book = Ledger(spark, str(tmp_path / "book"))
    brief = Brief.of({"name": "shops", "sources": [{"id": "file", "options": {"path": str(tmp_path / "a.csv")}},
                                                   {"id": "file", "options": {"path": str(tmp_path / "none.csv")}}],
                      "filters": REVIEWED, "limits": {"max_results": 4}, "suppress": {"cids": ["X6"]},
                      "output": {"columns": ["cid", "name"]}}, I.YEAR)
    done = execute(spark, brief, Inputs(ledger=book), out=str(tmp_path / "out"), run_id="r1")
    assert [r.cid for r in done.results.orderBy("ord").collect()] == ["x5", "x7", "x8", "x9"]
    told = book.runs().first()
    row = json.loads(told.stats)
    assert told.state == "partial" and row["stopped_reason"] == "result cap reached" and row["suppressed"] == 1
    assert (row["discovered"], row["deduped"], row["rejected_by"], row["unreached"]) == (12, 9, {"reviews": 5}, 2)
    assert book.verdicts("r1").count() == 9 and list((tmp_path / "out").glob("part-*.csv"))
    rest = execute(spark, brief, Inputs(ledger=book), resume=book.verdicts("r1"))
    assert [r.cid for r in rest.results.orderBy("ord").collect()] == ["x10", "x11"] and rest.stats.first().resumed == 9


def test_limits_put_no_whole_verdicts_in_order(spark, monkeypatch):
    rows = spark.range(40).select(
        F.col("id").alias("ord"), F.lit("qualified").alias("outcome"), F.lit(False).alias("hidden"), F.lit("wide").alias("name"),
        F.struct(F.struct(F.lit(None).cast("string").alias("error")).alias("a")).alias("signals"))
    kept, inner = [], ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df, label="stage": kept.append(df.columns) or inner(df, label))
    out, stop = ordered.limited(rows, max_results=7)
    assert out.columns == [*rows.columns, "fate"] and stop.first().stopped_at == 6
    assert sorted(r.ord for r in out.filter("fate = 'shown'").collect()) == list(range(7))
    assert kept and not any({"name", "signals"} & set(columns) for columns in kept)
