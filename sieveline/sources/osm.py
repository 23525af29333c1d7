"""OpenStreetMap extracts: landed ``{"elements": [...]}`` answers as listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import conform
from ..operators.places import has_tag
from ..reference_data import OSM_ATTRIBUTION, OSM_CATEGORY_KEYS

ELEMENT = ("type string, id bigint, lat double, lon double, "
           "center struct<lat:double,lon:double>, tags map<string,string>")


def read_elements(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    docs = spark.read.schema(f"elements array<struct<{_struct(ELEMENT)}>>").option("multiLine", True).json(path)
    out = docs.select(F.inline("elements"))
    return out.withColumn("place", F.lit(place).cast("string"))


def _struct(ddl: str) -> str:
    import re
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def _tag(key: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(key))


def address(tags_of=_tag) -> Column:
    parts = [F.nullif(tags_of(f"addr:{k}"), F.lit("")) for k in ("housenumber", "street", "city", "postcode")]
    return F.nullif(F.trim(F.concat_ws(" ", *parts)), F.lit(""))


def category(tags_of=_tag) -> Column:
    return F.initcap(F.replace(F.coalesce(*[tags_of(k) for k in OSM_CATEGORY_KEYS]), F.lit("_"), F.lit(" ")))


def to_listings(elements: DataFrame, tags=None, box: dict | None = None) -> DataFrame:
    """Named elements as listings; ``tags`` (any of) and ``box`` select first."""
    lat = F.coalesce("lat", F.col("center")["lat"])
    lng = F.coalesce("lon", F.col("center")["lon"])
    df = elements.filter(F.trim(F.coalesce(_tag("name"), F.lit(""))) != "")
    if tags:
        df = df.filter(has_tag(F.col("tags"), tags))
    if box:
        df = df.filter(lat.between(box["south"], box["north"]) & lng.between(box["west"], box["east"]))
    place = F.col("place") if "place" in elements.columns else F.lit(None)
    order = F.col("ord") if "ord" in elements.columns else F.monotonically_increasing_id()
    return conform(df.select(
        F.concat(F.lit("osm:"), "type", F.lit("/"), F.col("id").cast("string")).alias("cid"),
        F.trim(_tag("name")).alias("name"), category().alias("category"), address().alias("address"),
        F.coalesce(F.nullif(_tag("phone"), F.lit("")), _tag("contact:phone")).alias("phone"),
        F.coalesce(F.nullif(_tag("website"), F.lit("")), _tag("contact:website")).alias("website"),
        lat.alias("lat"), lng.alias("lng"), _tag("opening_hours").alias("status_raw"),
        F.lit("osm").alias("source"), place.alias("place_label"),
        F.create_map(F.lit("osm_tags"), F.to_json("tags"), F.lit("attribution"), F.lit(OSM_ATTRIBUTION))
        .alias("extras"), order.alias("ord")))
