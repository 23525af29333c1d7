"""What judging a row costs: nothing on the way is interpreted row by row, and the cheap forms answer as the full ones."""

import random
import unicodedata

from pyspark.sql import functions as F
from workload import briefs as B
from workload import inputs as I

from sieveline.functions import names, text
from sieveline.operators import registry
from sieveline.plans.judge import judge

ODD = ["", " ", "Acme Ltd.", "Acme - High St", "Acme (Soho)", "Acme Store 12", "acme\tco  LLC\n", "A.B_C 9", "plc", "x\x1cy", "x ",
       "Café Größe 東京", "Ａｃｍｅ Ltd", "ﬁne ﬂat", "Kelvin K Co", "ſtore ſhop", "İzmir", "Москва ООО", "Abc Где", "ab где", "где ab", "ꙮ",
       "東京タワー", "İ123", "한국 abc", None, "!!!", "Ⅷ group", "a" * 500 + " inc"]


def _full(name):
    """The key by the Unicode patterns alone, which every name took before."""
    return text.collapse(names.fold_compatibility(names._stripped(F.lower(F.trim(F.coalesce(name, F.lit("")))))))


def test_no_list_is_made_by_an_interpreted_filter(spark):
    """Lists of ways, trades and broken measurements were filtered by a lambda in every row."""
    rows = judge(I.listings(spark, "/root/testdata/sf0.001"), B.dentists(), dedupe=False, tally=False)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(isnotnull" not in plan


def test_plain_names_have_the_key_of_the_full_patterns(spark):
    dice = random.Random(5)
    bits = ["Acme", "ltd", "co.", " - ", "(", ")", "|", "branch", "\t", "é", "_", "12", ".", " ", "Company", "–", "ﬁ", "uk"]
    made = ODD + ["".join(dice.choice(bits) for _ in range(dice.randint(1, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(n,) for n in made], "n string")
    bad = df.select("n", names.chain_key(F.col("n")).alias("a"), _full(F.col("n")).alias("b")).filter("NOT a <=> b").collect()
    assert not bad


def test_scripts_are_counted_alike_for_names_of_one_script(spark, make):
    df = make(*[{"name": n} for n in ODD])
    got = registry.add_signals(df, ["name_script"], registry.Context()).select("name", F.col("signals")["name_script"].alias("s"))
    spans = {s: names.script_spans()[s] for s in names.SCRIPT_MARKS}
    for r in got.collect():
        letters = [c for c in (r["name"] or "").strip(" ") if unicodedata.category(c).startswith("L")]
        of = [next((s for s, sp in spans.items() if any(a <= ord(c) <= b for a, b in sp)), None) for c in letters]
        counts = {s: of.count(s) for s in spans if s in of}
        assert r["s"]["evidence"]["scripts"] == counts, r
        if not counts:
            assert r["s"]["vstr"] == "unknown" and r["s"]["evidence"]["mixed"] is False
            continue
        best = max(counts, key=lambda s: (counts[s], -of.index(s)))
        assert r["s"]["vstr"] == best, r
        assert r["s"]["evidence"]["mixed"] is (counts[best] < len(letters)), r
