"""Landed raw map-search responses as listings.

A response is nested arrays whose meaning is position. Where each field sits is
data (``FIELD_PATHS``); a response that no longer has that shape, or is a web
page, is reported as such and never read as an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import conform
from ..operators.shaping import decimal_id

# Fixed positions inside a place record.
FIELD_PATHS = {
    "cid": "$[10]", "name": "$[11]", "categories": "$[13]", "address": "$[39]",
    "lat": "$[9][2]", "lng": "$[9][3]", "rating": "$[4][7]", "review_count": "$[4][8]",
    "price_range": "$[4][2]", "website": "$[7][0]", "website_plain": "$[7]",
    "phone": "$[178][0][0]", "status": "$[34][4][4]", "status_other": "$[88][0]",
    "hours": "$[203][0]", "hours_other": "$[34][1]", "per_star": "$[175][3]",
    "description": "$[32][1][1]",
}
RECORD = "$[14]"
ENTRIES = "$[0][1]"


def _get(node: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, path, kind)


def _words(node: Column, path: str) -> Column:
    """A text field; any other type is no text."""
    got = _get(node, path)
    return F.nullif(F.when(F.schema_of_variant(got) == "STRING", _get(got, "$", "string")), F.lit(""))


def _list(node: Column, path: str) -> Column:
    return _get(node, path, "array<variant>")


def classified(raw: DataFrame, fields: dict | None = None) -> DataFrame:
    """``raw(place, page, raw)`` with ``state`` ok, blocked or shape_changed,
    ``why``, and ``records`` (place records of an ok response)."""
    body = F.regexp_replace(F.ltrim("raw"), r"(?s)^\)\]\}'[^\n]*(\n|$)", "")
    low = F.lower(F.ltrim("raw"))
    html = low.startswith("<!doctype") | low.startswith("<html")
    df = raw.withColumn("_doc", F.when(~html, F.try_parse_json(body)))
    df = df.withColumn("_entries", _list(F.col("_doc"), ENTRIES))
    records = F.filter(F.transform("_entries", lambda e: _get(e, RECORD)),
                       lambda r: F.schema_of_variant(r).startswith("ARRAY"))
    df = df.withColumn("records", F.coalesce(records, F.array().cast("array<variant>")))
    why = (F.when(html, F.lit("a web page instead of data"))
           .when(F.col("_doc").isNull(), F.lit("not JSON"))
           .when(F.col("_entries").isNull(), F.lit("no result list"))
           .when((F.size("_entries") > 0) & (F.size("records") == 0), F.lit("entries without a place record")))
    return df.withColumns({
        "state": F.when(html, F.lit("blocked")).when(why.isNotNull(), F.lit("shape_changed")).otherwise(F.lit("ok")),
        "why": why}).drop("_doc", "_entries")


def weekly_hours(record: Column, fields: dict) -> Column:
    """day -> slots, from whichever of two places holds the week."""
    main, other = _list(record, fields["hours"]), _list(record, fields["hours_other"])
    items = F.when(F.size(main) > 0, main).otherwise(other)
    days = F.transform(items, lambda i: F.struct(
        _words(i, "$[0]").alias("day"),
        F.array_compact(F.transform(_list(i, "$[3]"), lambda s: _words(s, "$[0]"))).alias("slots")))
    kept = F.filter(days, lambda d: d["day"].isNotNull() & (F.size(d["slots"]) > 0))
    # A day given twice keeps its last slots.
    unique = F.filter(kept, lambda d, i: ~F.exists(
        F.slice(kept, i + 2, F.size(kept)), lambda later: later["day"] == d["day"]))
    return F.when(F.size(unique) > 0, F.map_from_entries(unique))


def _count(node: Column, path: str) -> Column:
    n = X.whole_number(F.when(F.schema_of_variant(_get(node, path)) != "BOOLEAN", _get(node, path, "string")))
    return F.when(n >= 0, n)


def to_listings(raw: DataFrame, fields: dict | None = None) -> DataFrame:
    """Records with an id and a name as listings, in response order."""
    f = {**FIELD_PATHS, **(fields or {})}
    # Where responses are numbered, discovery order follows them.
    base = F.col("ord") if "ord" in raw.columns else F.lit(0)
    ok = classified(raw, f).withColumn("_base", base).filter(F.col("state") == "ok")
    rows = ok.select("place", "_base", F.posexplode("records").alias("_i", "_r"))
    if "ord" in raw.columns:
        rows = rows.orderBy("_base", "_i")
    r = F.col("_r")
    cats = F.array_compact(F.transform(_list(r, f["categories"]), lambda c: _get(c, "$", "string")))
    stars = F.transform(_list(r, f["per_star"]), lambda n: F.when(
        F.schema_of_variant(n) != "BOOLEAN", X.whole_number(_get(n, "$", "string"))))
    histogram = F.when((F.size(stars) == 5) & ~F.exists(stars, lambda n: n.isNull() | (n < 0)), F.to_json(
        F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(1, 6)]), stars)))
    extras = F.map_filter(F.create_map(
        F.lit("categories"), F.to_json(cats),
        F.lit("maps_url"), F.concat(F.lit("https://www.google.com/maps?cid="), decimal_id(_words(r, f["cid"]))),
        F.lit("price_range"), _words(r, f["price_range"]),
        F.lit("reviews_per_rating"), histogram,
        F.lit("description"), _words(r, f["description"])), lambda _, v: v.isNotNull())
    return conform(rows.select(
        _words(r, f["cid"]).alias("cid"), F.nullif(_get(r, f["name"], "string"), F.lit("")).alias("name"),
        F.try_element_at(cats, F.lit(1)).alias("category"), _get(r, f["address"], "string").alias("address"),
        _words(r, f["phone"]).alias("phone"),
        F.coalesce(_words(r, f["website"]), _words(r, f["website_plain"])).alias("website"),
        X.number(_get(r, f["rating"], "string")).alias("rating"),
        _count(r, f["review_count"]).alias("review_count"),
        X.number(_get(r, f["lat"], "string")).alias("lat"), X.number(_get(r, f["lng"], "string")).alias("lng"),
        weekly_hours(r, f).alias("hours"),
        F.coalesce(F.nullif(F.trim(_words(r, f["status"])), F.lit("")),
                   F.nullif(F.trim(_words(r, f["status_other"])), F.lit(""))).alias("status_raw"),
        F.lit("mapsearch").alias("source"), F.col("place").alias("place_label"), extras.alias("extras"),
        F.monotonically_increasing_id().alias("ord")).filter(F.col("name").isNotNull()))


def source_report(raw: DataFrame) -> DataFrame:
    """Places that could not be read, or held nothing, and why."""
    seen = classified(raw).groupBy("place").agg(
        F.sum(F.size("records")).alias("n"), F.max(F.col("state") == "blocked").alias("blocked"),
        F.min(F.when(F.col("state") != "ok", F.col("why"))).alias("why"))
    status = (F.when(F.col("blocked"), F.lit("fatal")).when(F.col("why").isNotNull(), F.lit("failed"))
              .when(F.col("n") == 0, F.lit("empty")).otherwise(F.lit("ok")))
    return seen.select(F.lit("mapsearch").alias("source"), "place", status.alias("status"),
                       F.when(status == "empty", F.lit("read, and nothing was there")).otherwise(F.col("why"))
                       .alias("why"))
