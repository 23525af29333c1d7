"""The driver tables as listings, pages, reviews and yields.

Each input is a plain projection or rollup over whole driver tables. The
expressions are SQL both engines read alike, so a query and its oracle start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.model import conform

YEAR = 2026          # the year both engines count ages from

# Listing columns over customer c, nation n and a rollup o of orders.
LISTING_SQL = {
    "cid": "'cust:' || CAST(c_custkey AS VARCHAR(20))",
    "name": """CASE c_custkey % 12
        WHEN 0 THEN 'Specsavers Opticians - Town ' || CAST(c_custkey % 50 AS VARCHAR(20))
        WHEN 1 THEN 'Bright Smile Dental'
        WHEN 2 THEN 'Northside Dental Group - Branch ' || CAST(c_custkey % 40 AS VARCHAR(20))
        WHEN 3 THEN 'Toni & Guy (Soho)'
        WHEN 4 THEN c_name
        WHEN 5 THEN 'Café Größe 東京'
        WHEN 6 THEN 'Стоматология Люкс'
        WHEN 7 THEN 'Village Roofing Ltd'
        WHEN 8 THEN 'Boots Opticians'
        WHEN 9 THEN 'Zahnarzt Müller GmbH'
        WHEN 10 THEN 'Red Roof Building ' || n_name
        ELSE '+++ ' || CAST(c_custkey AS VARCHAR(20)) END""",
    "category": """CASE c_custkey % 11
        WHEN 0 THEN 'Dentist' WHEN 1 THEN 'Roofing contractor' WHEN 2 THEN 'Contractor'
        WHEN 3 THEN c_mktsegment WHEN 4 THEN 'Dental laboratory' WHEN 5 THEN 'Turkish restaurant'
        WHEN 6 THEN '' WHEN 7 THEN 'Dental clinic' WHEN 8 THEN 'Barber shop'
        WHEN 9 THEN 'Painting class' ELSE 'Orthodontist' END""",
    "address": "CAST(c_custkey % 90 + 1 AS VARCHAR(20)) || ' High St, ' || n_name",
    "phone": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '+44' || CAST(c_custkey AS VARCHAR(20)) END",
    "website": """CASE c_custkey % 13
        WHEN 0 THEN NULL WHEN 1 THEN 'https://vagaro.com/x'
        WHEN 2 THEN 'https://salon' || CAST(c_custkey AS VARCHAR(20)) || '.booksy.com/book'
        WHEN 3 THEN 'https://www.facebook.com/p' || CAST(c_custkey AS VARCHAR(20))
        WHEN 4 THEN 'mailto:a@acme.com' WHEN 5 THEN 'shop' || CAST(c_custkey AS VARCHAR(20)) || '.square.site'
        WHEN 6 THEN 'https://notfresha.com' WHEN 7 THEN NULL WHEN 8 THEN ''
        WHEN 9 THEN 'HTTP://user@Own' || CAST(c_custkey AS VARCHAR(20)) || '.example.com:8080/a?b#c'
        WHEN 10 THEN 'https://squareup.com/a/x' WHEN 11 THEN 'tel:+441234'
        ELSE 'sites.google.com/view/' || CAST(c_custkey AS VARCHAR(20)) END""",
    "booking_url": """CASE c_custkey % 5
        WHEN 0 THEN 'https://vagaro.com/b' WHEN 1 THEN 'https://actionblack.us' WHEN 2 THEN 'https://x.com/shop'
        ELSE NULL END""",
    "rating": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE ROUND((c_acctbal + 1000) / 2000, 1) END",
    "review_count": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(COALESCE(o_n, 0) AS INT) END",
    "lat": "CAST(c_custkey % 180 AS DOUBLE) - 90 + CAST(c_nationkey AS DOUBLE) / 32",
    "lng": "CAST(c_custkey % 360 AS DOUBLE) - 180 + CAST(c_nationkey AS DOUBLE) / 32",
    "status_raw": """CASE c_custkey % 7
        WHEN 0 THEN NULL WHEN 1 THEN 'Permanently closed' WHEN 2 THEN 'CLOSED_TEMPORARILY'
        WHEN 3 THEN 'Closed - Opens 9 am Tue' WHEN 4 THEN '  Open 24   hours ' WHEN 5 THEN 'OPERATIONAL'
        ELSE '' END""",
    "first_review_year": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(o_year AS INT) END",
    "reviews_fetched": """CASE c_custkey % 4 WHEN 0 THEN CAST(LEAST(COALESCE(o_n, 0), 5) AS INT)
        WHEN 1 THEN CAST(COALESCE(o_n, 0) AS INT) ELSE NULL END""",
    "source": "'file:custom'",
    "place_label": "n_name",
    "email": "CASE WHEN c_custkey % 8 = 0 THEN 'k@firm.org' ELSE NULL END",
    "ord": "c_custkey",
}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a listing; its orders are its reviews."""
    orders = read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("o_n"), F.min(F.year("o_orderdate")).alias("o_year"))
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(orders, c.c_custkey == orders.o_custkey, "left")
            .selectExpr(*[f"{e} AS {k}" for k, e in LISTING_SQL.items()]))


def with_extras(df: DataFrame) -> DataFrame:
    return conform(df.withColumn("extras", F.when(
        F.col("email").isNotNull(), F.create_map(F.lit("email"), F.col("email")))))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return with_extras(raw_listings(spark, sf))


LISTINGS_CTE = """listings AS (
  SELECT """ + ",\n    ".join(f"{e} AS {k}" for k, e in LISTING_SQL.items()) + """
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, COUNT(*) AS o_n, MIN(YEAR(o_orderdate)) AS o_year
             FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


# Every seventh listing is offered again by a second source: upper-case id,
# other name, later in the order.
def offered(spark: SparkSession, sf: str) -> DataFrame:
    base = raw_listings(spark, sf)
    again = base.filter("ord % 7 = 0").withColumns({
        "cid": F.upper("cid"), "name": F.concat(F.lit("Again "), F.col("name")),
        "source": F.lit("mapsearch"), "ord": F.col("ord") + F.lit(1_000_000_000)})
    return with_extras(base.unionByName(again))


OFFERED_CTE = LISTINGS_CTE + """,
offered AS (
  SELECT * FROM listings
  UNION ALL
  SELECT * REPLACE (UPPER(cid) AS cid, 'Again ' || name AS name, 'mapsearch' AS source,
                    ord + 1000000000 AS ord)
  FROM listings WHERE ord % 7 = 0)"""


def suppressions(spark: SparkSession, sf: str) -> DataFrame:
    """Every eleventh customer: undated when even, else its last order's date."""
    last = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
    return last.filter("o_custkey % 11 = 0").select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("cid"),
        F.when(F.col("o_custkey") % 2 == 1, F.col("d")).cast("timestamp").alias("suppressed_at"))


SUPPRESSIONS_CTE = """suppressions AS (
  SELECT 'cust:' || o_custkey AS cid, CASE WHEN o_custkey % 2 = 1 THEN MAX(o_orderdate) END AS suppressed_at
  FROM orders WHERE o_custkey % 11 = 0 GROUP BY o_custkey)"""


def page_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's owner as a listing; a few have no address of their own."""
    p = read(spark, sf, "pages")
    return conform(p.select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("cid"),
        F.concat(F.lit("Site "), F.col("page_id").cast("string")).alias("name"),
        F.when(F.col("page_id") % 10 == 9, F.lit(None)).otherwise(F.col("url")).alias("website"),
        F.lit("Dentist").alias("category"), F.lit("file:custom").alias("source"),
        F.col("page_id").cast("int").alias("review_count"), F.col("page_id").alias("ord")))


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as landed answers: one in five refused, gone, or failed."""
    p = read(spark, sf, "pages")
    kind = F.col("page_id") % 10
    return p.select(
        "url", F.col("url").alias("final_url"),
        F.when(kind == 3, 404).when(kind == 5, 503).when(kind == 7, 403).otherwise(200).alias("status"), "html",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(kind == 1, F.lit("timed out")).when(
            F.col("page_id") % 50 == 21, F.lit("certificate verify failed")).alias("error"),
        F.lit(False).alias("redirected"), F.timestamp_seconds(F.lit(1767225600)).alias("fetched_at"),
        F.when(F.col("page_id") % 4 == 0, 0).otherwise(1).alias("requests"), F.col("page_id").alias("ord"))


# the same, as columns over pages
SITE_CTE = """landed AS (
  SELECT page_id, url, html, regexp_replace(url, '#.*', '') AS address,
    CASE page_id % 10 WHEN 3 THEN 404 WHEN 5 THEN 503 WHEN 7 THEN 403 ELSE 200 END AS status,
    CASE WHEN page_id % 10 = 1 THEN 'timed out'
         WHEN page_id % 50 = 21 THEN 'certificate verify failed' END AS error,
    CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END AS requests
  FROM pages),
answers AS (  -- one answer per address
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY error IS NOT NULL, url) AS rn FROM landed)
  WHERE rn = 1),
site AS (
  SELECT l.page_id, 'page:' || l.page_id AS cid, CASE WHEN l.page_id % 10 = 9 THEN NULL ELSE l.url END AS website,
    a.url, a.html, a.status, a.error, a.requests
  FROM landed l JOIN answers a USING (address))"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as reviews; every ninth is delivered twice and some carry no id."""
    o = read(spark, sf, "orders")
    base = o.select(
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("cid"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("timestamp_us"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"), F.col("o_orderkey").alias("ord"))
    again = base.filter("ord % 9 = 0").withColumn("ord", F.col("ord") + F.lit(1_000_000_000))
    return base.unionByName(again)


REVIEWS_CTE = """reviews0 AS (
  SELECT CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS id,
    'cust:' || o_custkey AS cid, o_orderdate AS made, CAST(o_orderpriority[1] AS INT) AS rating, o_orderkey AS ord
  FROM orders),
reviews AS (SELECT * FROM reviews0 UNION ALL
  SELECT * REPLACE (ord + 1000000000 AS ord) FROM reviews0 WHERE ord % 9 = 0)"""


def measured_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as measurements in order; an error event is a failed one."""
    return read(spark, sf, "events").select(
        F.col("event_id").alias("ord"), (F.col("event_type") == "error").alias("failed"),
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"))


def yields(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of a source: each user's run of events, one search per kind.

    Every user counts as a place; a user without such events yields nothing.
    """
    e = read(spark, sf, "events")
    found = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # each user's searches, one per event kind
    plan = e.select("user_id").distinct().withColumn("event_type", F.explode(F.array(
        *[F.lit(k) for k in ("view", "click", "signup", "error", "purchase")])))
    return plan.join(found, ["user_id", "event_type"], "left").select(
        F.col("event_type").alias("source"), F.col("user_id").alias("pos"),
        F.concat(F.lit("place "), F.col("user_id").cast("string")).alias("place"),
        F.when(F.col("user_id") % 11 == 3, F.lit(0).cast("long")).when(F.col("user_id") % 7 == 5, F.lit(2).cast("long"))
        .otherwise(F.coalesce("n", F.lit(0))).alias("found"))


YIELDS_CTE = """yields AS (
  SELECT t.event_type AS source, u.user_id AS pos, 'place ' || u.user_id AS place,
    CASE WHEN u.user_id % 11 = 3 THEN 0 WHEN u.user_id % 7 = 5 THEN 2 ELSE COALESCE(n, 0) END AS found
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t
  LEFT JOIN (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL) f
    ON f.user_id = u.user_id AND f.event_type = t.event_type)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as units of work."""
    state = (F.when(F.col("o_orderstatus") == "F", F.lit("done"))
             .when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0), F.lit("failed"))
             .when(F.col("o_orderstatus") == "O", F.lit("pending")).otherwise(F.lit("deferred")))
    return read(spark, sf, "orders").select(
        F.lit("place").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), state.alias("state"),
        F.when(state == "failed", F.concat(F.lit("timeout "), F.col("o_custkey").cast("string"))).alias("error"))


UNITS_CTE = """units AS (
  SELECT 'place' AS kind, CAST(o_orderkey AS VARCHAR) AS key,
    CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'failed'
         WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'deferred' END AS state,
    CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'timeout ' || o_custkey END AS error
  FROM orders)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as recorded runs, each with two versions of its record."""
    s = read(spark, sf, "supplier")
    key = F.col("s_suppkey")
    state = F.when(key % 9 == 0, F.lit("running")).when(key % 4 == 0, F.lit("partial")).otherwise(F.lit("done"))
    stats = (F.when(key % 10 == 3, F.lit("{broken")).when(key % 10 == 4, F.lit("[1]"))
             .when(key % 10 == 5, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit('{"qualified": '), key.cast("string"), F.lit(', "rejected": '),
                                 (key * 2).cast("string"), F.lit(', "error": "e'), key.cast("string"), F.lit('"}'))))
    base = s.select(key.cast("string").alias("run_id"), F.col("s_name").alias("name"),
                    (key * 100).cast("double").alias("started"), key, F.col("s_acctbal"),
                    state.alias("state"), stats.alias("stats"))
    final = base.select("run_id", "name", "state", "started",
                        F.when(F.col("state") != "running", F.col("started") + F.floor(F.abs("s_acctbal"))).alias("finished"),
                        "stats", F.lit(2).cast("long").alias("version"))
    early = base.select("run_id", "name", F.lit("running").alias("state"), "started",
                        F.lit(None).cast("double").alias("finished"), F.lit("{}").alias("stats"),
                        F.lit(1).cast("long").alias("version"))
    return early.unionByName(final)


RUNS_CTE = """runs0 AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS run_id, s_name AS name, CAST(s_suppkey * 100 AS DOUBLE) AS started,
    s_suppkey AS k, s_acctbal,
    CASE WHEN s_suppkey % 9 = 0 THEN 'running' WHEN s_suppkey % 4 = 0 THEN 'partial' ELSE 'done' END AS state
  FROM supplier),
runs AS (
  SELECT run_id, name, state, started,
    CASE WHEN state <> 'running' THEN started + FLOOR(ABS(s_acctbal)) END AS finished, k
  FROM runs0)"""
