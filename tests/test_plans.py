"""Briefs, plugins, plans' shape, streams, and the oracle comparison."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sieveline import Brief, BriefError, judge, settings, validate
from sieveline.model import measurement
from sieveline.operators import places, registry, shaping
from sieveline.plans.brief import duration, durable_problem
from sieveline.sources import registry as sources
from sieveline.streaming import qualify
from workload import inputs as I
from workload.briefs import DENTISTS, FILE, dentists
from workload.check import compare

SMALL = "/root/testdata/sf0.001"


def test_checks_report_everything():
    bad = {"sorces": 1, "sources": [{"id": "file"}], "what": {"packs": ["trades/none"], "match": "some"},
           "filters": [{"signal": "nope", "op": "~"}, {"group": "most", "of": [{"op": "=="}]}],
           "scoring": {"weights": {"reviews": {"weight": 1, "cap": True}}, "bands": [{"label": "x"}]},
           "limits": {"max_results": 0, "max_runtime": "soon"}, "output": {"columns": ["x"], "template": {"a": "{y}"}},
           "suppress": {"after": "later"}}
    told = "; ".join(validate(bad))
    for word in ("sorces", "options.path", "trades/none", "'some'", "'nope'", "'~'", "'most'", "lacks 'signal'", "cap",
                 "lacks 'min'", "max_results", "max_runtime", "'x'", "'y'", "suppress.after"):
        assert word in told, word
    with pytest.raises(BriefError):
        Brief.of(bad)
    assert validate(DENTISTS) == [] and validate("x") and validate({})
    assert [duration(v) for v in ("90d", "30m", 1800, "x", "")] == [7776000, 1800, 1800, None, None]
    assert len(settings.weight("x", {"weight": 1, "cap": 5, "capp": 6, "invert": "yes"})) == 2
    assert durable_problem(dentists())
    assert sorted(shaping.template_fields({"A": "name", "B": "{score} and {band}"})) == ["band", "name", "score"]


def test_places(spark):
    plan = places.planned_places(spark, {"places": ["Oxford"], "packs": ["geo/uk-affluent"], "exclude": ["bath"], "place": "OXFORD"})
    got = [r.place for r in places.ordered_places(plan).collect()]
    assert got[0] == "Oxford" and "Bath" not in got and len(got) == 19
    assert [r.place for r in places.ordered_places(plan, "priority", priority=["marlow"]).collect()][0] == "Marlow"
    once, again = ([r.place for r in places.ordered_places(plan, "random", seed=4).collect()] for _ in range(2))
    assert once == again and sorted(once) == sorted(got)
    assert "amenity=bakery" in places.guess_tags("bakeries") and "shop=bakeries" in places.guess_tags("Bakeries")
    assert places.osm_tags(None, [], "dentist") == ["amenity=dentist", "healthcare=dentist"]


def test_plugin_runs_only_when_named(spark, make):
    @registry.signal("lucky", kind="boolean")
    def lucky(ctx):
        return measurement(vbool=F.col("review_count") == 7)
    try:
        with pytest.raises(ValueError):
            registry.signal("lucky")(lucky)
        assert "lucky" not in dentists().signals_for("free")
        brief = Brief.of({"sources": FILE, "filters": [{"signal": "lucky", "op": "==", "value": True}]}, 2026)
        got = judge(make({"review_count": 7}, {"review_count": 8}), brief).orderBy("ord").collect()
        assert [r.outcome for r in got] == ["qualified", "rejected"]
    finally:
        registry.unregister("lucky")
    with pytest.raises(ValueError):
        sources.source("file")(lambda spark, options: None)


def test_failed_source_stops_no_other(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cid,title\nx1,A\n")
    rows, report = sources.read_all(spark, [{"id": "file", "options": {"path": str(tmp_path / "none.csv")}},
                                            {"id": "osm", "enabled": False},
                                            {"id": "file", "options": {"path": str(tmp_path / "a.csv")}}])
    assert [r.cid for r in rows.collect()] == ["x1"]
    assert [r.status for r in report.collect()] == ["fatal", "ok"]


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "l")
    I.listings(spark, SMALL).write.parquet(path)
    brief = Brief.of({"sources": FILE, "filters": [{"signal": "reviews", "op": ">=", "value": 5}],
                      "gating": {"free": ["reviews"]}}, 2026)
    out = judge(spark.read.parquet(path), brief, dedupe=False).select("cid", "outcome")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<cid:string,review_count:int>" in plan and "Exchange" not in plan


def test_runtime_budget_and_progress(spark, tmp_path):
    log = qualify.ProgressLog()
    spark.streams.addListener(log)
    slow = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    q = slow.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    assert qualify.run_for(q, 2) == "partial" and not q.isActive
    until = time.time() + 20
    while time.time() < until and "done" not in [e for e, _ in log.events]:
        time.sleep(.2)
    spark.streams.removeListener(log)
    assert [e for e, _ in log.events][0] == "start" and "done" in [e for e, _ in log.events]


FEW = ["f1_web_presence", "f3_trade_match_all", "r7_unmeasurable", "r9_staged_tiers", "g4_score_breakdown", "w9_review_cap",
       "w7_search_suspicion", "j10_contact_hop", "j12_place_boxes", "s14_map_responses", "k6_upsert", "t5_stream_breaker"]


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("ALL_QUERIES") else FEW)
def test_oracle(spark, name):
    assert not compare(spark, SMALL, name, entry.queries()[name], entry.oracle_sql().get(name)).startswith("FAIL")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
