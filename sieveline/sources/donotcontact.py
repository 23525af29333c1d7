"""Do-not-contact lists, in whatever form they were exported.

A list that yields no ids is an error: read as empty it would bring everyone on
it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_date
from ..operators.listings import first_per_key
from ..reference_data import SUPPRESSION_DATE_FIELDS
from .landed import Landed, build_mapping, file_order, identity, read_parts

# What an id looks like: a hex pair, an OSM reference, digits, or one token.
ID = (r"(?i)^(0x[0-9a-f]+:0x[0-9a-f]+|osm:(node|way|relation)/\d+|\d{8,}|"
      r"[a-z0-9][a-z0-9_.:/-]{7,})$")
ID_SHARE = 0.8


class SuppressionError(ValueError):
    """A list that cannot be used. Never to be read as an empty one."""


def is_id(token: Column) -> Column:
    return ~token.contains(" ") & token.rlike(ID)


def id_share(tokens: DataFrame, column: str) -> DataFrame:
    """One row: the share of non-blank tokens that look like ids."""
    token = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return tokens.select(token.alias("t")).filter("t <> ''").agg(
        F.count(F.lit(1)).alias("tokens"), F.avg(is_id(F.col("t")).cast("int")).alias("share"))


def _entries(landed: Landed) -> DataFrame | None:
    """``cid, suppressed_at, _ord`` of a part with a column of ids, or None. ``_ord`` follows files and rows."""
    headers = landed.headers
    mapping = build_mapping(headers)
    if mapping.get("cid") or mapping.get("maps_url"):
        dated = {h.lower(): h for h in headers}
        column = next((dated[f] for f in SUPPRESSION_DATE_FIELDS if f in dated), None)
        when = parsed_date(landed.cell(column)) if column else F.lit(None).cast("timestamp")
        return landed.df.withColumn("_ord", file_order()).select(
            identity(landed.cell(mapping.get("cid")), landed.cell(mapping.get("maps_url"))).alias("cid"),
            when.alias("suppressed_at"), "_ord").filter(F.col("cid").isNotNull())
    if len(headers) != 1:
        return None
    # No header: the first line is an id too (an untitled part has it among its rows).
    tokens = landed.df.select(landed.cell(headers[0]).alias("t"), file_order().alias("_ord"))
    if landed.kind != "column":
        first = tokens.sparkSession.createDataFrame([(headers[0],)], "t string").withColumn("_ord", file_order())
        tokens = tokens.unionByName(first)
    stats = id_share(tokens, "t").first()
    if not stats.tokens or stats.share < ID_SHARE:
        return None
    token = F.lower(F.btrim(F.trim("t"), F.lit('"')))
    return tokens.select(token.alias("cid"), F.lit(None).cast("timestamp").alias("suppressed_at"), "_ord").filter("cid <> ''")


def read_list(spark: SparkSession, path) -> DataFrame:
    """``(cid, suppressed_at)``; a null date is a permanent entry.

    A folder may hold lists of several kinds; the last entry of an id counts, by
    part and file name. Any file without ids refuses the whole list.
    """
    try:
        parts = read_parts(spark, path)
    except Exception as exc:                                   # noqa: BLE001
        raise SuppressionError(f"could not read {path}: {exc}") from exc
    out = None
    for at, part in enumerate(parts):
        rows = _entries(part)
        if rows is None or not rows.head(1):
            raise SuppressionError(f"{path} has no column of business ids (columns: {', '.join(part.headers) or 'none'}); "
                                   "refusing to continue with a list that hides nobody")
        rows = rows.withColumn("_part", F.lit(at))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise SuppressionError(f"{path} holds nothing; refusing to continue with a list that hides nobody")
    return first_per_key(out, "cid", [F.col("_part").desc(), F.col("_ord").desc()]).drop("_ord", "_part")
