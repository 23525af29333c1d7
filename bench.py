"""Headline queries, timed. Prints one JSON line.

Every query but the first reads the verdicts the first one wrote, as a user of
a stored run does. One small run before the clock starts loads the JVM code.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from sieveline import judge
from sieveline.model import LISTING_FIELDS
from sieveline.operators import memory, scoring, shaping
from sieveline.plans.judge import requalify
from sieveline.session import settle
from sieveline.sinks import files, ledger
from workload import briefs as B
from workload import inputs as I
from workload.check import session
from workload.landing_queries import folder

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM = "/root/testdata/sf0.001"
COLUMNS = ["score", "name", "category", "address", "phone", "website", "booking_url", "rating", "review_count",
           "web_presence", "trade_match", "outcome", "qualified", "reject_reason", "failed_signals", "cid", "source"]


def steps(spark, sf):
    held = {}

    def judge_all():
        held["v"] = settle(judge(I.listings(spark, sf), B.dentists()), "bench")
        return held["v"].count()

    def rank_all():
        return shaping.best_first(held["v"], True).select("cid", "name", "outcome", "score").collect()

    def results_page():
        return shaping.page(held["v"], "score", 200).select("cid", "name", "score", "outcome").collect()

    def evidence():
        return scoring.explain(ledger.find(held["v"], "cust:7")).collect()

    def export_csv():
        files.write_csv(shaping.best_first(held["v"]), folder(spark, "bench-csv"), {"columns": COLUMNS})

    def rescore():
        return scoring.rescore(held["v"], {"reviews": {"weight": 60, "cap": 20}, "contactable": 40}) \
            .agg(F.sum("score")).collect()

    def requalify_diff():
        old = held["v"].select(*LISTING_FIELDS, "signals", "outcome")
        return memory.transitions(old, requalify(old, B.stricter())).collect()

    return [("judge_all", judge_all), ("rank_all", rank_all), ("results_page", results_page), ("evidence", evidence),
            ("export_csv", export_csv), ("rescore", rescore), ("requalify_diff", requalify_diff)]


def main() -> None:
    spark = session()
    for _, step in steps(spark, WARM):
        step()
    times = {}
    for name, step in steps(spark, SF):
        t = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "listing_qualification_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
