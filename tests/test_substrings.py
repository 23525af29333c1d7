"""Substring joins against plain loops, and without a nested loop in their plans."""

import random

from pyspark.sql import functions as F

from sieveline.operators import matching, places


def test_containing(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé漢 ") for _ in range(n))                         # noqa: E731
    texts = [word(rng.randrange(0, 30)) for _ in range(300)] + ["", "a", "ab", None, "aaa aaa"] * 2
    terms = [word(rng.randrange(0, 6)) for _ in range(80)] + ["", "a", "ab", "aaa", "longer than any text of them all", None]
    got = matching.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    rows = [(r.text, r.term) for r in got.collect()]
    want = {(t, x) for t in texts if t for x in terms if x and x in t}
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_priority_join(spark):
    wanted = spark.createDataFrame([("Ham", 0), ("o", 1), ("", 2)], "want string, rank int")
    towns = spark.createDataFrame([("Oldham",), ("Leeds",), ("York",), ("oldham",), (None,)], "place string")
    ranked = places.priority_join(towns, wanted)
    assert {r.place: r["rank"] for r in ranked.collect()} == {"Oldham": 0, "oldham": 0, "York": 1, "Leeds": None, None: None}
    assert "NestedLoop" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_trade_terms_as_a_table(spark, make):
    terms = spark.createDataFrame([("a", "category", "Bakery"), ("b", "category", "shop"), ("b", "veto", "bake"), ("a", "keyword", "bun"),
                                   ("b", "keyword", "bun"), ("c", "keyword", "")], "pack_id string, kind string, term string")
    df = make({"category": "Bakery shop"}, {"category": "", "name": "Bun shop"}, {"category": None, "name": "x"}, {"category": "Shop"})
    got = {r.cid: (r.trade_vetoed, r.trade_hits) for r in matching.trade_term_join(df, terms).collect()}
    assert got == {"c0": (True, ["a"]), "c1": (False, ["a", "b"]), "c2": (False, []), "c3": (False, ["b"])}
    plan = matching.trade_term_join(df, terms).select(F.col("trade_hits"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
