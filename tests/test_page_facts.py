"""What page signals ask of a page, and what is computed for them."""

from pyspark.sql import functions as F

from sieveline.functions import html as H
from sieveline.functions.text import first_of
from sieveline.operators import page_signals
from workload import inputs as I
from workload.signal_queries import hop_pages, now

SF = "/root/testdata/sf0.001"


def test_first_of_works_its_text_out_once(spark):
    """An expression inside the lambda was worked out for every needle."""
    df = spark.createDataFrame([("xAbc",), ("zZ",), (None,)], "t string")
    got = first_of(F.lower("t"), ["zz", "abc", "b"])
    assert [r.h for r in df.select(got.alias("h")).collect()] == ["abc", "zz", None]
    plan = df.select(got.alias("h"))._jdf.queryExecution().analyzed().toString().lower()
    assert "contains(" in plan and "contains(lower(" not in plan


def test_only_the_facts_that_signals_read_are_computed(spark):
    pages = I.site_pages(spark, SF)
    wanted = page_signals.facts_read(["site_status", "site_https", "site_mobile"])
    assert wanted == {"parked", "placeholder", "words", "viewport"}
    few = page_signals.page_facts(pages, F.lit(I.YEAR), wanted)
    every = page_signals.page_facts(pages, F.lit(I.YEAR))
    assert not {"emails", "years", "platform", "socials"} & set(few.columns)
    assert sorted(map(str, few.collect())) == sorted(map(str, every.select(few.columns).collect()))


def test_a_signal_that_does_not_say_reads_all_facts(spark):
    from sieveline.model import CHEAP, measurement
    from sieveline.operators import registry

    @registry.signal("own_page_signal", CHEAP)
    def own(ctx):
        return measurement(vstr=F.col("_page")["generator"])
    try:
        assert page_signals.facts_read(["site_https", "own_page_signal"]) is None
    finally:
        registry.unregister("own_page_signal")


def test_years_words_and_platform(spark):
    rows = [("<p>a <b>b</b> c</p> 　", "© 2010-2012, COPYRIGHT 2015 &#XA9; 1994", "x Squarespace-cdn wixstatic.com"),
            ("", "c 2010", ""), ("<br>", "Copyright<2011>", "nothing")]
    df = spark.createDataFrame(rows, "w string, y string, p string")
    kind, marker = H.platform(F.lower("p"))
    got = df.select(H.word_count(F.col("w")).alias("w"), H.copyright_years(F.col("y"), F.lit(2026)).alias("y"),
                    kind.alias("k"), marker.alias("m")).collect()
    assert [(r.w, r.y) for r in got] == [(3, [2010, 2012, 2015]), (0, []), (0, [])]
    assert [(r.k, r.m) for r in got] == [("wix", "wixstatic.com"), (None, None), (None, None)]


def test_contact_hop_opens_pages_once(spark):
    """Both lookups of a contact hop read the settled facts, not the pages again."""
    owners = I.conform(hop_pages(spark, SF).select(F.col("url").alias("cid"), F.col("url").alias("website")))
    facts = page_signals.site_facts(hop_pages(spark, SF), F.lit(I.YEAR), now(), wanted=page_signals.facts_read(["site_contact"]))
    plan = page_signals.with_pages(owners.select("cid", "website", "booking_url"), facts)._jdf.queryExecution()
    assert "regexp_extract_all" not in plan.optimizedPlan().toString()
