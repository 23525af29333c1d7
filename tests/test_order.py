"""Ordered operators against plain loops, on blocks small enough to cross."""

import random

from pyspark.sql import functions as F

from sieveline.operators import health, listings, matching, ordered


def test_running_total_and_halo(spark):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(10**6), 400))
    rows = [(k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "ord long, v int")
    got = {r.ord: (r.t, r.rn) for r in ordered.running_total(df, "ord", {"t": F.col("v"), "rn": F.lit(1)}, blocks=7).collect()}
    total = 0
    for i, (k, v) in enumerate(rows):
        total += v
        assert got[k] == (total, i + 1)
    halo = ordered.with_halo(ordered.numbered(df, "ord"), "rn", 4, size=50)
    assert halo.filter("_own").count() == 400 and halo.filter("not _own").count() == 4 * 8


def test_blocks_hold_like_numbers_of_rows_whatever_the_gaps(spark):
    far = 1 << 52
    df = spark.range(40_000).select(
        (F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.col("id") * 1000 + far)).alias("ord"))
    sizes = [r["count"] for r in ordered._blocked(df, "ord", 16).groupBy("_block").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 2 * 40_000 / len(sizes)


def breaker(oks, rate=.4, window=20, least=10):
    recent, trip = [], None
    for i, ok in enumerate(oks):
        recent = (recent + [ok])[-window:]
        if trip is None and len(recent) >= least and recent.count(False) / len(recent) >= rate:
            trip = i
    return trip


def test_breaker(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 25)
    monkeypatch.setattr(ordered.with_halo, "__defaults__", (25,))
    cases = [[True] * 50, [False] * 3, [i % 2 == 0 for i in range(30)], [True] * 200 + [False] * 12,
             [False] * 3 + [True] * 40, [False] * 9 + [True] * 5]
    for oks in cases:
        df = spark.createDataFrame(list(enumerate(oks)), "ord long, ok boolean")
        trace = ordered.breaker_trace(df, ~F.col("ok"))
        assert ordered.trip_point(trace).first().trip == breaker(oks)


def running(counts):
    out, seen = [], []
    for c in counts:
        seen.append(c)
        good = sorted(x for x in seen if x >= 1)
        if len(good) < 3:
            out.append(None)
            continue
        upper = good[len(good) // 2:]
        n = len(upper)
        out.append((upper[(n - 1) // 2] + upper[n // 2]) / 2)
    return out


def test_health(spark):
    traces = {"a": [58, 59, 74, 20, 0, 20, 0, 36, 0, 20], "b": [3, 2, 4, 3, 2, 3], "c": [20] * 4, "d": [78, 77, 80, 76, 79, 74]}
    rows = [(s, i, c) for s, cs in traces.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "source string, pos long, found long")
    got = {(r.source, r.pos): r.baseline for r in health.running_health(df, size=4).collect()}
    for s, cs in traces.items():
        assert [got[s, i] for i in range(len(cs))] == running(cs)
    told = {r.source: r for r in health.summary(df).collect()}
    assert told["a"].verdict == "throttled" and told["a"].baseline == 58.5 and told["a"].zero_results == 3
    assert told["a"].suspects >= 6 and [told[s].verdict for s in "bcd"] == ["healthy"] * 3


def test_running_baseline_over_blocks_and_digits(spark):
    """Many searches of one source, yields of two digits, and a source without a name."""
    rng = random.Random(8)
    traces = {"hot": [rng.choice([0, rng.randrange(40), rng.randrange(5000)]) for _ in range(5000)], None: [9, 0, 5000, 7, 1], "few": [3, 4]}
    df = spark.createDataFrame([(s, 10 * i, c) for s, cs in traces.items() for i, c in enumerate(cs)], "source string, pos long, found long")
    got = {(r.source, r.pos): r.baseline for r in health.running_health(df).collect()}
    for s, cs in traces.items():
        assert [got[s, 10 * i] for i in range(len(cs))] == running(cs)


def test_block_stock_is_linear(spark):
    """Counts carried from block to block are no more rows than the input has."""
    rows = spark.range(40_000).select(F.lit("a").alias("_per"), F.lit(0).cast("long").alias("_prefix"), F.col("id").alias("_seq"),
                                      (F.xxhash64("id") % health.DIGITS + health.DIGITS).alias("_d"), F.floor(F.col("id") / health.DIGITS).alias("_block"))
    rows = rows.withColumn("_digit", F.pmod("_d", F.lit(health.DIGITS)))
    stock = health.block_stock(rows, ["_per", "_prefix"])
    assert stock.count() <= 40_000
    last = stock.filter(F.col("_block") == 39).agg(F.sum("_times")).first()[0]
    assert last == 39 * health.DIGITS
    plan = stock._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.count("Generate explode") == 1


def test_skewed_lookup_and_caps(spark):
    rows = [(str(i), "hot" if i % 3 == 0 else (None if i % 3 == 1 else f"k{i % 50}"), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "cid string, key string, ord int")
    counts = left.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = matching.hot_among(counts, "n")
    assert "hot" in {r.key for r in hot.collect()} and hot.count() <= matching.HOT_SHARE
    for h in (None, hot):
        out = matching.lookup(left, counts, "key", hot=h)
        assert out.count() == 3000 and out.filter("key = 'hot'").agg(F.min("n"), F.max("n")).first()[:] == (1000, 1000)
        assert out.filter("key is null and n is not null").count() == 0
    top = listings.top_per_key(left.filter("key is not null").repartition(7), "key", "ord", 5, salts=3)
    assert sorted(r.ord for r in top.filter("key = 'hot'").collect()) == [0, 3, 6, 9, 12]
