"""Landed files, sinks, the ledger and streams.

The driver tables are first written the way an export would land (in a folder
of their own under the shared scratch folder), then read back by the operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from sieveline.functions.text import parsed_date

from sieveline.operators import listings as L
from sieveline.operators import shaping
from sieveline.session import scratch_dir, settle
from sieveline.sinks import files, ledger
from sieveline.sources import donotcontact, landed, mapsearch, osm
from sieveline.sources import registry as sources
from sieveline.streaming import breaker, qualify
from workload import briefs as B
from workload import inputs as I
from workload import oracle_parts as O
from workload.judging_queries import verdicts
from workload.registry import query


def folder(spark, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def export(spark, sf):
    """Customers as an export: quoted line breaks and commas, blanks, a maps
    link for every third row, and no identity at all for every tenth."""
    k = F.col("c_custkey")
    s = k.cast("string")
    return I.read(spark, sf, "customer").select(
        F.when((k % 3 != 0) & (k % 10 != 9), F.concat(F.lit("0X1A:0x"), F.lower(F.hex(k)))).alias("place_id"),
        F.concat(F.lit("Shop \"One\", "), s, F.when(k % 5 == 0, F.lit("\nUpstairs")).otherwise(F.lit(""))).alias("title"),
        F.col("c_mktsegment").alias("category"), F.concat(s, F.lit(",000.0")).alias("reviews"),
        F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("rating"),
        F.when((k % 3 == 0) & (k % 10 != 9), F.concat(F.lit("https://x/maps/place/Q/data=!1s0x2b:0x"), F.hex(k))).alias("link"),
        F.when(k % 7 == 0, F.lit("True")).otherwise(F.lit("no")).alias("permanently_closed"),
        F.lit("OPERATIONAL").alias("status"))


EXPORT_SQL = """SELECT CASE WHEN k % 3 <> 0 THEN '0x1a:0x' || lower(to_hex(k)) ELSE '0x2b:0x' || lower(to_hex(k)) END AS cid,
   'Shop "One", ' || k || CASE WHEN k % 5 = 0 THEN chr(10) || 'Upstairs' ELSE '' END AS name, c_mktsegment AS category,
   (k * 1000)::INT AS review_count, CASE WHEN k % 4 <> 0 THEN c_acctbal END AS rating,
   CASE WHEN k % 7 = 0 THEN 'Permanently closed' ELSE 'OPERATIONAL' END AS status_raw
 FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 10 <> 9"""
# a record names all its fields, empty ones too
KEEP_NULLS = {"ignoreNullFields": "false"}
EXPORT_FIELDS = ["cid", "name", "category", "review_count", "rating", "status_raw"]


@query("s1_csv_export", EXPORT_SQL)
def s1(spark, sf):
    path = folder(spark, "csv")
    export(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return landed.read_listings(spark, path).select(*EXPORT_FIELDS)


@query("s2_utf16_export", "SELECT 'id-' || c_custkey AS cid, 'Müller 東京 ' || c_custkey AS name FROM customer")
def s2(spark, sf):
    """Unicode text as a spreadsheet saves it."""
    path = folder(spark, "utf16")
    I.read(spark, sf, "customer").select(
        F.concat(F.lit("ID-"), F.col("c_custkey").cast("string")).alias("cid"),
        F.concat(F.lit("Müller 東京 "), F.col("c_custkey").cast("string")).alias("title")) \
        .repartition(4, "title").write.option("header", True).option("encoding", "UTF-16").csv(path)
    return landed.read_listings(spark, path).select("cid", "name")


@query("s7_mixed_folder", """SELECT 'id-' || c_custkey AS cid, 'Müller ' || c_custkey AS name,
   CASE WHEN c_custkey % 5 < 3 THEN c_mktsegment END AS category, CASE WHEN c_custkey % 5 = 1 THEN 40 END AS surplus FROM customer""")
def s7(spark, sf):
    """One folder of exports with other columns, another encoding and JSON lines and arrays; one has 40 cells beyond its header."""
    path, k = folder(spark, "mixed"), F.col("c_custkey")
    rows = I.read(spark, sf, "customer").select(F.concat(F.lit("ID-"), k.cast("string")).alias("cid"), F.concat(F.lit("Müller "), k.cast("string")).alias("title"),
                                                F.col("c_mktsegment").alias("category"), (k % 5).alias("kind"))
    of = lambda i, *columns: rows.filter(F.col("kind") == i).select(*columns)               # noqa: E731
    of(0, "category", "title", "cid").write.option("header", True).csv(path + "/b=0")
    wide = [F.lit(f"more {i}").alias(f"x{i}") for i in range(40)]
    # rows wider than the header above them: whole lines in one column of that name
    lines = of(1, F.concat_ws(",", "cid", "category", "title", *wide).alias("cid,category,title")).repartition(3, "cid,category,title")
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\0").csv(path + "/b=1")
    of(2, "title", "category", "cid").write.option("header", True).option("encoding", "UTF-16").csv(path + "/b=2")
    of(3, "cid", "title").write.json(path + "/b=3")
    arrays = of(4, F.to_json(F.struct("title", "cid")).alias("j")).groupBy((F.abs(F.hash("j")) % 16).alias("g")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    arrays.repartition(16, "g").write.partitionBy("g").text(path + "/b=4")
    out = landed.read_listings(spark, [f"{path}/b={i}" for i in range(4)] + [path + "/b=4/g=*"])
    extra = F.from_json(F.try_element_at("extras", F.lit(landed.SURPLUS)), "array<string>")
    return out.select("cid", "name", "category", F.nullif(F.size(extra), F.lit(-1)).alias("surplus"))


@query("s4_json_lines", EXPORT_SQL)
def s4(spark, sf):
    """One object per line, with torn lines among them."""
    path = folder(spark, "jsonl")
    good = export(spark, sf).select(F.to_json(F.struct("*"), KEEP_NULLS).alias("value"))
    good.unionByName(good.select(F.concat(F.lit('{"torn": '), F.length("value").cast("string")).alias("value"))) \
        .write.text(path)
    return landed.read_listings(spark, path).select(*EXPORT_FIELDS)


def _documents(spark, sf, shape):
    """Customers of each nation as one JSON document per file."""
    rows = export(spark, sf).withColumn("g", F.abs(F.hash("title")) % 16).groupBy("g").agg(
        F.to_json(F.collect_list(F.struct("place_id", "title", "category", "reviews", "rating", "link",
                                          "permanently_closed", "status")), KEEP_NULLS).alias("rows"))
    path = folder(spark, "json")
    # one document per file
    rows.select(shape(F.col("rows")).alias("value"), "g").repartition(16, "g").write.partitionBy("g").text(path)
    return landed.read_listings(spark, path + "/g=*").select(*EXPORT_FIELDS)


@query("s5_json_array", EXPORT_SQL)
def s5(spark, sf):
    return _documents(spark, sf, lambda rows: F.concat(F.lit("[7, "), F.substring(rows, 2, 2_000_000_000)))


@query("s6_wrapped_document", EXPORT_SQL)
def s6(spark, sf):
    """Rows under the first list of objects, whatever its name."""
    return _documents(spark, sf, lambda rows: F.concat(
        F.lit('{"total": 3, "tags": ["x"], "items": '), rows, F.lit(', "data": [{"cid": "no"}]}')))


@query("p2_p5_nested_fields", """SELECT 'c' || c_custkey AS cid, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS category,
   c_custkey + 0.5::DOUBLE AS lat, -c_custkey - 0.25::DOUBLE AS lng FROM customer""")
def p2_p5(spark, sf):
    """A list gives its first scalar, a mapping nothing; coordinates may nest."""
    k = F.col("c_custkey")
    path = folder(spark, "apify")
    cats = F.when(k % 2 == 0, F.concat(F.lit('["", {"a": 1}, "'), F.col("c_mktsegment"), F.lit('", "Other"]'))).otherwise(F.lit('{"a": "b"}'))
    I.read(spark, sf, "customer").select(F.concat(
        F.lit('{"placeId": "C'), k.cast("string"), F.lit('", "title": "T", "categoryName": '), cats,
        F.lit(', "location": {"lat": '), (k + 0.5).cast("string"), F.lit(', "lng": "'), (-k - 0.25).cast("string"),
        F.lit('"}}')).alias("value")).write.text(path)
    return landed.read_listings(spark, path).select("cid", "category", "lat", "lng")


@query("p6_extras", """SELECT 'a' || c_custkey AS cid, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS note, 1 + (c_custkey % 2 = 0)::INT + 1 AS n
   FROM customer""")
def p6(spark, sf):
    path = folder(spark, "extras")
    I.read(spark, sf, "customer").select(
        F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("cid"), F.lit("T").alias("title"),
        F.when(F.col("c_custkey") % 2 == 0, "x").alias("note")).write.option("header", True).csv(path)
    x = F.col("extras")
    return landed.read_listings(spark, path).select("cid", F.try_element_at(x, F.lit("note")).alias("note"),
                                                    F.size(x).alias("n"))


@query("s11_inspect", """SELECT count(*) AS rows, count(*) FILTER (WHERE c_custkey % 10 = 9) AS rows_without_identity,
   NULL::VARCHAR AS detected_profile, 8 AS columns FROM customer""")
def s11(spark, sf):
    path = folder(spark, "inspect")
    export(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return landed.inspect(spark, path).select("rows", "rows_without_identity", "detected_profile", F.size("columns").alias("columns"))


@query("s12_osm_extract", """SELECT 'osm:' || CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'way' END || '/' || p_partkey AS cid, p_name AS name,
   array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS category,
   p_size || ' High St' AS address, p_retailprice AS lat FROM part WHERE p_partkey % 5 <> 0 AND p_size > 10""")
def s12(spark, sf):
    k = F.col("p_partkey")
    even = k % 2 == 0
    elements = I.read(spark, sf, "part").select(
        F.when(even, "node").otherwise("way").alias("type"), k.alias("id"),
        F.when(even, F.col("p_retailprice")).alias("lat"), F.when(even, F.lit(1.0)).alias("lon"),
        F.when(~even, F.struct(F.col("p_retailprice").alias("lat"), F.lit(1.0).alias("lon"))).alias("center"),
        F.map_filter(F.create_map(
            F.lit("name"), F.when(k % 5 != 0, F.col("p_name")), F.lit("shop"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")),
            F.lit("addr:housenumber"), F.col("p_size").cast("string"), F.lit("addr:street"), F.lit("High St"),
            F.lit("big"), F.when(F.col("p_size") > 10, "yes")), lambda _, v: v.isNotNull()).alias("tags"),
        k.alias("ord"))
    return osm.to_listings(elements, ["big"], {"south": -1e9, "north": 1e9, "west": -1, "east": 2}).select(
        "cid", "name", "category", "address", "lat")


def _responses(spark, sf):
    """Each nation's customers as raw search responses, ten records a page;
    two nations are blocked or misshapen."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    nul = lambda n: ",".join(["null"] * n)                                                  # noqa: E731
    rec = F.concat(
        F.lit(f"[null,[{nul(14)},[{nul(4)},[{nul(7)},"), F.round((k % 50) / 10.0, 1).cast("string"), F.lit(","),
        (k % 90).cast("string"), F.lit(f"],{nul(2)},[\"https://h"), k.cast("string"), F.lit(f".org\"],null,[null,null,51.5,-0.5],"),
        F.when(k % 6 == 0, F.lit("null")).otherwise(F.concat(F.lit('"0xA:0x'), F.hex(k), F.lit('"'))),
        F.lit(',"Shop '), k.cast("string"), F.lit(f'",null,["Dentist","Clinic"],{nul(20)},[{nul(4)},[{nul(4)},"Closed"]],{nul(4)},"1 St"]]]'))
    body = F.regexp_replace(rec, r"^\[null,", "")
    body = F.regexp_replace(body, r"\]$", "")
    pages = I.read(spark, sf, "customer").withColumn("page", F.floor(k / 250)).groupBy("c_nationkey", "page").agg(
        F.array_join(F.sort_array(F.collect_list(body)), ",").alias("b"))
    raw = (F.when(nation == 3, F.lit("<!DOCTYPE html>sign in")).when(nation == 4, F.lit(")]}'\n[[\"q\",7]]"))
           .otherwise(F.concat(F.lit(")]}'\n[[\"q\",[["), F.lit("\"head\"],"), F.col("b"), F.lit("]]]"))))
    return pages.select(F.concat(F.lit("N"), nation.cast("string")).alias("place"), "page", raw.alias("raw"))


@query("s14_map_responses", """SELECT '0xa:0x' || lower(to_hex(c_custkey)) AS cid, 'Shop ' || c_custkey AS name, 'Dentist' AS category,
   (c_custkey % 90)::INT AS review_count, round((c_custkey % 50) / 10.0::DOUBLE, 1) AS rating, 'https://h' || c_custkey || '.org' AS website,
   'Closed' AS status_raw, 'N' || c_nationkey AS place_label FROM customer WHERE c_custkey % 6 <> 0 AND c_nationkey NOT IN (3, 4)""")
def s14(spark, sf):
    return mapsearch.to_listings(_responses(spark, sf)).select(
        "cid", "name", "category", "review_count", "rating", "website", "status_raw", "place_label")


@query("s14_response_states", """SELECT 'N' || c_nationkey AS place, CASE c_nationkey WHEN 3 THEN 'fatal' WHEN 4 THEN 'failed' ELSE 'ok' END AS status
   FROM customer GROUP BY ALL""")
def s14_states(spark, sf):
    return mapsearch.source_report(_responses(spark, sf)).select("place", "status")


@query("p11_decimal_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey * 1000003 AS VARCHAR) ELSE 'osm:node/' || o_orderkey END AS id FROM orders")
def p11(spark, sf):
    k = F.col("o_orderkey")
    cid = F.when(k % 2 == 0, F.concat(F.lit("0xA:0x"), F.hex(k * 1000003))).otherwise(F.concat(F.lit("osm:node/"), k.cast("string")))
    return I.read(spark, sf, "orders").select("o_orderkey", shaping.decimal_id(cid).alias("id"))


@query("s17_reviews_scan", f"WITH {I.REVIEWS_CTE} SELECT cid, rating, epoch_us(made) AS timestamp_us FROM reviews")
def s17(spark, sf):
    path = folder(spark, "reviews")
    I.reviews(spark, sf).drop("ord").write.json(path)
    return sources.read_reviews(spark, path).select("cid", "rating", "timestamp_us")


def _ledgered(spark, sf, some: str = "true"):
    book = ledger.Ledger(spark, folder(spark, "ledger"))
    v = settle(verdicts(spark, sf).select("cid", "name", "category", "address", "review_count", "outcome", "score", "ord"))
    book.save("r1", v.filter(some))
    return book, v


@query("k6_upsert", O.dentists("""SELECT cid, CASE WHEN ord % 3 = 0 THEN 'again' ELSE outcome END AS outcome,
   (SELECT count(*) FROM verdicts WHERE ord % 3 = 0 AND ord % 2 <> 0) AS fresh FROM verdicts WHERE ord % 2 = 0 OR ord % 3 = 0"""))
def k6(spark, sf):
    """A second save replaces the rows it repeats and reports what was new."""
    book, v = _ledgered(spark, sf, "ord % 2 = 0")
    new = v.filter("ord % 3 = 0").withColumn("outcome", F.lit("again"))
    fresh = book.save("r1", new)
    assert book.save("r1", new) == 0
    return book.verdicts("r1").select("cid", "outcome", F.lit(fresh).cast("long").alias("fresh"))


@query("k7_remove", O.dentists("""SELECT cid, (SELECT count(*) FROM verdicts WHERE outcome = 'rejected') AS gone
   FROM verdicts WHERE outcome <> 'rejected'"""))
def k7(spark, sf):
    book, v = _ledgered(spark, sf)
    gone = book.remove("r1", v.filter("outcome = 'rejected'"))
    assert book.remove("r1", v.filter("outcome = 'rejected'")) == 0
    return book.verdicts("r1").select("cid", F.lit(gone).cast("long").alias("gone"))


@query("s19_outline", O.dentists("SELECT cid, outcome, score, review_count, name, category, address FROM verdicts"))
def s19(spark, sf):
    return _ledgered(spark, sf)[0].outline("r1")


@query("s18_stored_page", O.dentists("SELECT cid FROM verdicts ORDER BY cid LIMIT 40 OFFSET 5"))
def s18(spark, sf):
    return _ledgered(spark, sf)[0].verdicts("r1", 40, 5).select("cid")


@query("k6_compacted", O.dentists("""SELECT cid, CASE WHEN ord % 3 = 0 THEN 'again' ELSE outcome END AS outcome, 1 AS versions
   FROM verdicts WHERE ord % 5 <> 0"""))
def k6_compacted(spark, sf):
    """Saves, a replay and a removal folded into one version; a stream's batch saved twice is there once."""
    book, v = _ledgered(spark, sf)
    new = v.filter("ord % 3 = 0").withColumn("outcome", F.lit("again"))
    stamp = max(book.versions("r1")) + 1
    assert book.save("r1", new, stamp) == book.save("r1", new, stamp) == 0 and len(book.versions("r1")) == 2
    book.remove("r1", v.filter("ord % 5 = 0"))
    book.compact("r1")
    return book.verdicts("r1").select("cid", "outcome", F.lit(len(book.versions("r1"))).alias("versions"))


@query("k9_run_life", """SELECT 'r' || n_nationkey AS run_id, 'done' AS state, n_nationkey + 0.5::DOUBLE AS finished,
   '{"qualified": ' || n_nationkey || '}' AS stats FROM nation WHERE n_nationkey < 3""")
def k9_life(spark, sf):
    """A run's record through its states; each change is appended."""
    book = ledger.Ledger(spark, folder(spark, "life"))
    for r in I.read(spark, sf, "nation").filter("n_nationkey < 3").collect():
        run = f"r{r.n_nationkey}"
        book.record_run(run, r.n_name, "running", float(r.n_nationkey))
        book.update_stats(run, '{"qualified": %d}' % r.n_nationkey)
        book.set_state(run, "done", r.n_nationkey + 0.5)
    return book.runs().select("run_id", "state", "finished", "stats")


@query("s20_keyed_lookup", """SELECT 'cust:' || c_custkey AS cid, c_mktsegment FROM customer WHERE c_custkey IN (7, 3, 900)
   UNION ALL SELECT 'cust:11', c_mktsegment FROM customer WHERE c_custkey = 11""")
def s20(spark, sf):
    rows = I.read(spark, sf, "customer").select(
        F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("cid"), "c_mktsegment")
    some = ledger.rows_for(rows, ["cust:7", "none", "cust:3", "cust:900"]).select("cid", "c_mktsegment")
    return some.unionByName(ledger.find(rows, "CUST:11"))


@query("s21_journal", "SELECT 'c' || o_custkey AS cid, max(o_orderkey) AS n FROM orders GROUP BY 1")
def s21(spark, sf):
    """Verdicts appended over time; the last per id wins, torn lines cost themselves."""
    path = folder(spark, "journal")
    rows = I.read(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cid"), F.col("o_orderkey").alias("n"))
    # one file after another, each in order, as a journal grows
    good = rows.repartitionByRange(4, "n").sortWithinPartitions("n").select(F.to_json(F.struct("*")).alias("value"))
    good.unionByName(spark.createDataFrame([('{"cid": "c1", "n"',)], "value string")).write.text(path)
    return sources.read_journal(spark, path, "cid string, n long")


@query("s22_contact_list", """SELECT 'cust:' || o_custkey AS cid, max(o_orderdate) AS suppressed_at FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1
   UNION ALL SELECT 'cust:' || o_custkey, NULL FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1""")
def s22(spark, sf):
    path = folder(spark, "contacted")
    last = I.read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
    last.select(F.concat(F.lit("CUST:"), F.col("o_custkey").cast("string")).alias("place_id"), F.lit("n").alias("name"),
                F.when(F.col("o_custkey") % 2 == 0, F.date_format("d", "dd/MM/yyyy")).alias("contacted_at")) \
        .write.option("header", True).csv(path)
    out = donotcontact.read_list(spark, path)
    return out.select("cid", F.col("suppressed_at").cast("timestamp_ntz").alias("suppressed_at"))


@query("s22_bare_ids", "SELECT 'osm:node/' || c_custkey AS cid FROM customer")
def s22_bare(spark, sf):
    path = folder(spark, "ids")
    I.read(spark, sf, "customer").select(F.concat(F.lit("osm:node/"), F.col("c_custkey").cast("string")).alias("value")) \
        .repartition(4, "value").write.text(path)
    return donotcontact.read_list(spark, path).select("cid")


@query("s23_id_share", """SELECT count(*) AS tokens, avg((o_orderkey % 4 <> 0)::INT) AS share FROM orders""")
def s23(spark, sf):
    k = F.col("o_orderkey")
    t = I.read(spark, sf, "orders").select(F.when(k % 4 == 0, F.concat(F.lit("call "), k.cast("string")))
                                           .otherwise(F.concat(F.lit("0x1:0x"), F.hex(k))).alias("t"))
    return donotcontact.id_share(t, "t")


@query("s22_dates", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate
   WHEN 3 THEN CASE WHEN day(o_orderdate) > 12 THEN o_orderdate ELSE make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) END
   WHEN 4 THEN NULL ELSE TIMESTAMP '2001-09-10 00:00:00' END AS at_date FROM orders""")
def s22_dates(spark, sf):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T09:30:00")))
           .when(k == 2, F.date_format(d, "dd/MM/yyyy")).when(k == 3, F.date_format(d, "M/d/yyyy"))
           .when(k == 4, F.lit("soon")).otherwise(F.lit("1000080000")))
    return I.read(spark, sf, "orders").select(
        "o_orderkey", parsed_date(raw).cast("timestamp_ntz").alias("at_date"))


@query("s24_pack_override", """SELECT p_brand AS pack_id, p_name AS term FROM part p JOIN (SELECT p_brand, max(p_size % 3) AS top FROM part GROUP BY 1) t
   USING (p_brand) WHERE p_size % 3 = top""")
def s24(spark, sf):
    terms = I.read(spark, sf, "part").select(F.col("p_brand").alias("pack_id"), F.col("p_name").alias("term"),
                                             (F.col("p_size") % 3).alias("origin_rank"))
    return sources.effective_packs(terms).select("pack_id", "term")


# ---- output -----------------------------------------------------------------

@query("k4_attributions", """SELECT 'licence ' || o_orderpriority AS attribution, min(o_orderkey) AS first_ord FROM orders GROUP BY 1""")
def k4(spark, sf):
    rows = I.read(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.create_map(
        F.lit("attribution"), F.concat(F.lit("licence "), F.col("o_orderpriority"))).alias("extras"))
    return shaping.attributions(rows)


@query("k5_split", O.dentists("""SELECT cid, CASE WHEN trim(coalesce(category, '')) = '' THEN 'unsorted'
   ELSE lower(trim(regexp_replace(category, '[^\\p{L}\\p{N}_.-]+', '-', 'g'), '-')) END AS part FROM verdicts"""))
def k5(spark, sf):
    path = folder(spark, "split")
    files.write_split(conform_out(verdicts(spark, sf)), path, {"split_by": "category", "columns": ["cid", "outcome"]})
    back = spark.read.option("header", True).csv(path)
    return back.select("cid", F.col("_split").alias("part"))


def conform_out(v):
    return v


@query("k1_csv_sink", O.dentists("""SELECT cid, coalesce(score::VARCHAR, '') AS score, outcome, CASE WHEN contains(name, '+++') THEN '''' || name ELSE name END AS name
   FROM verdicts WHERE outcome = 'qualified'"""))
def k1(spark, sf):
    """Best first as a spreadsheet-safe CSV, read back as text."""
    path = folder(spark, "out")
    files.write_csv(shaping.best_first(verdicts(spark, sf)), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select(
        "cid", F.coalesce("score", F.lit("")).alias("score"), "outcome", "name")


@query("k2_jsonl_sink", O.dentists("SELECT cid, outcome, score FROM verdicts"))
def k2(spark, sf):
    """Verdicts as JSON lines, read back."""
    path = folder(spark, "lines")
    files.write_jsonl(verdicts(spark, sf).select("cid", "outcome", "score", "extras", "ord"), path)
    return spark.read.schema("cid string, outcome string, score double").json(path)


@query("k10_reviews_sink", O.dentists("""SELECT '0x1a:0x' || lower(to_hex(o_custkey)) AS cid, o_orderkey AS id, v.name AS business
   FROM orders JOIN verdicts v ON v.ord = o_custkey WHERE outcome = 'qualified' AND o_custkey % 2 = 0"""))
def k10(spark, sf):
    """The reviews of qualified businesses, written and read back."""
    hexed = lambda c: F.concat(F.lit("0x1a:0x"), F.lower(F.hex(c)))                        # noqa: E731
    v = verdicts(spark, sf).withColumn("cid", F.when(F.col("ord") % 2 == 0, hexed(F.col("ord"))).otherwise(F.col("cid")))
    r = I.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), hexed(F.col("o_custkey")).alias("cid"),
                                           F.lit("x").alias("business"))
    path = folder(spark, "reviews")
    files.write_reviews(r, v, path)
    return spark.read.schema("cid string, id long, business string").json(path)


@query("o5_pruned_ledger", O.dentists("""SELECT 'second' AS run, 'done' AS state, cid, outcome FROM verdicts"""))
def o5_pruned(spark, sf):
    """Two recorded runs, the older one pruned with all it owns."""
    book = ledger.Ledger(spark, folder(spark, "book"))
    rows = settle(verdicts(spark, sf), "to-save")
    for at, run in enumerate(("first", "second")):
        book.record_run(run, run, "running", float(at))
        book.save(run, rows)
        book.record_run(run, run, "done", float(at), at + 0.5)
    assert book.prune(1) == ["first"] and book.verdicts("first") is None
    kept = book.runs().select(F.col("run_id").alias("run"), "state")
    return book.verdicts("second").select(
        kept.select("run").scalar().alias("run"), kept.select("state").scalar().alias("state"), "cid", "outcome")


@query("k3_json_document", O.dentists("SELECT cid, outcome FROM verdicts"))
def k3(spark, sf):
    path = folder(spark, "doc")
    files.write_json(verdicts(spark, sf).select("cid", "outcome", "ord", "extras"), path)
    whole = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("v"))
    row = F.from_json("v", "cid string, outcome string")
    return whole.filter("v like '{\"cid\"%'").select(row["cid"].alias("cid"), row["outcome"].alias("outcome"))


@query("p8_flatten", O.dentists("""SELECT cid, web_presence, coalesce(trade_hit, 'False') AS trade_match,
   CASE WHEN broken THEN 'rating_band' ELSE '' END AS failed_signals, CASE WHEN outcome = 'qualified' THEN 'True' ELSE 'False' END AS qualified,
   review_count::BIGINT::VARCHAR AS reviews FROM verdicts"""))
def p8(spark, sf):
    return shaping.flatten(verdicts(spark, sf), ["cid", "web_presence", "trade_match", "failed_signals", "qualified", "reviews"])


@query("p9_template", O.dentists("""SELECT coalesce(name, '') AS "Company", coalesce(band_, '') AS "Priority",
   coalesce(name, '') || ' has ' || coalesce(review_count::VARCHAR, '') || ' reviews' AS "Opening" FROM (SELECT *, CASE WHEN score >= 75 THEN 'first'
   WHEN score >= 60 THEN 'next' WHEN score >= 0 THEN 'later' END AS band_ FROM verdicts)"""))
def p9(spark, sf):
    return shaping.render(verdicts(spark, sf), {"Company": "name", "Priority": "band", "Opening": "{name} has {review_count} reviews"})


@query("p10_sheet_safe", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '''=SUM(1)' WHEN 1 THEN '+44 (20) 1' WHEN 2 THEN '''+cmd' WHEN 3 THEN '-5.0'
   WHEN 4 THEN '''@x' ELSE 'plain' END AS cell FROM customer""")
def p10(spark, sf):
    k = F.col("c_custkey") % 6
    cell = (F.when(k == 0, "=SUM(1)").when(k == 1, "+44 (20) 1").when(k == 2, "+cmd").when(k == 3, "-5.0")
            .when(k == 4, "@x").otherwise("plain"))
    return shaping.sheet_safe(I.read(spark, sf, "customer").select("c_custkey", cell.alias("cell")))


# ---- runs -------------------------------------------------------------------

def _runs(spark, sf):
    return L.latest(I.runs(spark, sf), "run_id", "version")


@query("p14_run_summary", f"""WITH {I.RUNS_CTE} SELECT run_id, state AS status, round(coalesce(finished, started) - started, 1) AS elapsed,
   k % 10 IN (3, 4) AS unreadable, CASE WHEN k % 10 NOT IN (3, 4, 5) THEN 'e' || k END AS error,
   CASE WHEN k % 10 NOT IN (3, 4, 5) THEN k ELSE 0 END AS qualified, coalesce(n, 0) AS total FROM runs
   LEFT JOIN (SELECT c_custkey % 200 AS rk, count(*) AS n FROM customer GROUP BY 1) ON rk = k""")
def p14(spark, sf):
    totals = I.read(spark, sf, "customer").groupBy((F.col("c_custkey") % 200).cast("string").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total"))
    return ledger.run_summaries(_runs(spark, sf), totals).select(
        "run_id", "status", "elapsed", "unreadable", "error", "qualified", "total")


@query("o5_retention", f"""WITH {I.RUNS_CTE}, done AS (SELECT *, row_number() OVER (ORDER BY coalesce(finished, started) DESC, run_id) AS rn FROM runs WHERE state <> 'running')
   SELECT c_custkey FROM customer WHERE CAST(c_custkey % 200 AS VARCHAR) NOT IN (SELECT run_id FROM done WHERE rn > 30)""")
def o5(spark, sf):
    owned = I.read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 200).cast("string").alias("run_id"))
    return ledger.kept_of(owned, _runs(spark, sf), 30).select("c_custkey")


@query("o6_listed_runs", f"WITH {I.RUNS_CTE} SELECT run_id, name, started FROM runs ORDER BY started DESC, run_id LIMIT 20")
def o6(spark, sf):
    return ledger.listed_runs(_runs(spark, sf), 20).select("run_id", "name", "started")


@query("o6_reconciled", f"""WITH {I.RUNS_CTE} SELECT run_id, CASE WHEN state = 'running' THEN 'interrupted' ELSE state END AS state,
   CASE WHEN state = 'running' THEN 5.0::DOUBLE ELSE finished END AS finished FROM runs""")
def o6_reconciled(spark, sf):
    return ledger.reconciled(_runs(spark, sf), F.lit(5.0)).select("run_id", "state", "finished")


@query("k9_run_records", f"WITH {I.RUNS_CTE} SELECT run_id, state, finished FROM runs")
def k9(spark, sf):
    """Run records are appended; the latest version of each run counts."""
    return _runs(spark, sf).select("run_id", "state", "finished")


@query("p13_rebuilt_signal", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'v' END AS vstr, CASE o_orderkey % 4 WHEN 1 THEN o_orderkey::DOUBLE END AS vnum,
   CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
   CASE o_orderkey % 4 WHEN 2 THEN 'down' END AS error FROM orders""")
def p13(spark, sf):
    k = F.col("o_orderkey")
    doc = (F.when(k % 4 == 0, F.lit('{"value": "v", "confidence": 7, "evidence": {}}'))
           .when(k % 4 == 1, F.concat(F.lit('{"value": '), k.cast("string"), F.lit(', "confidence": 0.5, "odd": 1}')))
           .when(k % 4 == 2, F.lit('{"value": null, "confidence": "junk", "evidence": {"error": "down"}}'))
           .otherwise(F.lit("{torn")))
    s = ledger.rebuilt_signal(doc)
    return I.read(spark, sf, "orders").select("o_orderkey", s["vstr"].alias("vstr"), s["vnum"].alias("vnum"),
                                              s["confidence"].alias("confidence"), s["error"].alias("error"))


# ---- streams ----------------------------------------------------------------

def _landed_stream(spark, sf):
    path = folder(spark, "landing")
    for part in ("source <> 'mapsearch'", "source = 'mapsearch'"):         # offered again later, by another source
        I.offered(spark, sf).filter(part).repartition(4, "cid").sortWithinPartitions("ord").write.mode("append").parquet(path)
    return qualify.listing_stream(spark, path, files_per_trigger=2)


@query("t1_stream_qualify", O.dentists("SELECT cid, outcome, rejected_by, score FROM verdicts"))
def t1(spark, sf):
    """Landed files judged as they arrive give the batch's verdicts."""
    out, mark = folder(spark, "streamed"), folder(spark, "mark")
    stream = qualify.fresh(_landed_stream(spark, sf))
    qualify.run_for(qualify.start(stream, B.dentists(), out, mark, single=False), None)
    return spark.read.parquet(out).select("cid", "outcome", "rejected_by", "score")


@query("t2_t3_stream_fresh", f"""WITH {I.LISTINGS_CTE}, {I.SUPPRESSIONS_CTE} SELECT cid FROM listings WHERE ord % 5 <> 0
   AND cid NOT IN (SELECT cid FROM suppressions)""")
def t2_t3(spark, sf):
    """A stream deduplicated against itself, an earlier run and a list."""
    seen = I.listings(spark, sf).filter("ord % 5 = 0").select("cid")
    stream = qualify.fresh(_landed_stream(spark, sf), seen, I.suppressions(spark, sf)).select("cid")
    out = folder(spark, "fresh")
    query_ = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "mark"))
              .trigger(availableNow=True).start())
    query_.awaitTermination()
    return spark.read.parquet(out)


@query("t4_changed_feed", O.two_runs("SELECT n.cid, n.outcome FROM verdicts n JOIN old o USING (cid) WHERE n.outcome <> o.outcome"))
def t4(spark, sf):
    from workload.judging_queries import stored
    out, mark = folder(spark, "feed"), folder(spark, "mark")
    stream = qualify.fresh(_landed_stream(spark, sf))
    prior = stored(spark, sf, "cid", "outcome")
    qualify.run_for(qualify.start(stream, B.dentists(), out, mark, prior=prior, single=False), None)
    return qualify.changed_only(spark.read.parquet(out)).select("cid", "outcome")


@query("t5_stream_breaker", """WITH m AS (SELECT 's' || user_id % 3 AS source, event_id AS ord, event_type = 'error' AS failed FROM events),
  r AS (SELECT *, avg(failed::INT) OVER w AS rate, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY source ORDER BY ord ROWS 19 PRECEDING)),
  t AS (SELECT source, min(ord) AS trip FROM r WHERE n >= 10 AND rate >= 0.4 GROUP BY source)
  SELECT source, ord, failed, coalesce(ord = trip, false) AS trips, trip IS NULL OR ord <= trip AS reached FROM m LEFT JOIN t USING (source)""")
def t5(spark, sf):
    """The breaker as stream state, source by source, over several batches."""
    path, out = folder(spark, "events"), folder(spark, "tripped")
    rows = I.measured_events(spark, sf).orderBy("ord")
    rows.repartitionByRange(3, "ord").sortWithinPartitions("ord").write.parquet(path)
    names = sorted(f.path for f in _files(spark, path))
    landing = folder(spark, "arrivals")
    for i, name in enumerate(names):                # arrivals in order of discovery, oldest first
        spark.read.parquet(name).coalesce(1).write.parquet(f"{landing}/b={i}")
    provider = spark.conf.get(breaker.STATE_STORE[0])
    spark.conf.set(*breaker.STATE_STORE)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{landing}/b=*")
        q = (breaker.breaker_stream(stream).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", folder(spark, "mark")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(breaker.STATE_STORE[0], provider)
    return spark.read.parquet(out)


def _files(spark, path):
    return spark.read.format("binaryFile").load(f"{path}/*.parquet").select("path").collect()


