from pyspark.sql import functions as F

from sieveline.operators import page_signals

PAGE = "url string, final_url string, status int, html string, error string, redirected boolean, requests int, ord long"


def landed(spark, rows):
    df = spark.createDataFrame([(u, u, s, "<p>x</p>", None, False, r, o) for u, s, r, o in rows], PAGE)
    return df.withColumns({"headers": F.lit(None).cast("map<string,string>"), "fetched_at": F.timestamp_seconds(F.lit(1767225600))})


def test_of_tied_answers_the_one_that_landed_first_is_kept(spark):
    """which of two answers alike in address, age and outcome counts does not hang on their partition."""
    rows = [(f"https://a{i}.org/", 200 + i % 2, i % 3, i) for i in range(40)]
    again = [(u, 404, 1 - r % 2, 1000 + o) for u, _, r, o in rows]
    want = sorted(rows)
    for order in (rows + again, again + rows):
        for parts in (1, 7):
            pages = landed(spark, order).repartition(parts)
            listings = spark.createDataFrame([(u, None, u) for u, *_ in rows], "website string, booking_url string, cid string")
            for facts in (page_signals.site_facts(pages, F.lit(2026), F.timestamp_seconds(F.lit(1767225600))),
                          page_signals.facts_of(pages, listings.select(page_signals.page_address().alias("address")),
                                                F.lit(2026), F.timestamp_seconds(F.lit(1767225600)))):
                assert sorted((r.url, r.status, r.requests, r.ord) for r in facts.collect()) == want


def test_addresses_may_be_kept_as_they_are(spark):
    """fragments apart, and the last number of an address."""
    now = F.timestamp_seconds(F.lit(1767225600))
    pages = landed(spark, [("https://a.org/#top", 200, 1, 1), ("https://a.org/", 200, 1, 2), ("https://a.org/", 200, 1, 9)]).withColumn(
        "fetched_at", now - F.make_dt_interval(F.when(F.col("ord") == 9, 3).otherwise(0)))
    got = page_signals.latest_fresh(pages, now, 7, key=F.col("url"), newest_by=F.col("ord"))
    assert sorted((r.url, r.ord) for r in got.collect()) == [("https://a.org/", 9), ("https://a.org/#top", 1)]
    assert [r.ord for r in page_signals.latest_fresh(pages, now, 7).collect()] == [2]
