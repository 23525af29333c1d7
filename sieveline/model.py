"""Schemas and the typed measurement struct every signal produces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType([
    T.StructField("cid", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("booking_url", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("review_count", T.IntegerType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("hours", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("status_raw", T.StringType()),
    T.StructField("first_review_year", T.IntegerType()),
    T.StructField("reviews_fetched", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("place_label", T.StringType()),
    T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ord", T.LongType()),
])
LISTING_FIELDS = [f.name for f in LISTING]

SITE_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("html", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("redirected", T.BooleanType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("requests", T.IntegerType()),
])

REVIEW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("relative_date", T.StringType()),
    T.StructField("timestamp_us", T.LongType()),
    T.StructField("owner_reply", T.StringType()),
    T.StructField("photos", T.IntegerType()),
    T.StructField("cid", T.StringType()),
    T.StructField("business", T.StringType()),
])

QUALIFIED, REJECTED, UNEVALUATED = "qualified", "rejected", "unevaluated"
OUTCOMES = (QUALIFIED, REJECTED, UNEVALUATED)
FREE, CHEAP, EXPENSIVE = "free", "cheap", "expensive"
TIERS = (FREE, CHEAP, EXPENSIVE)


def conform(df: DataFrame, schema: T.StructType = LISTING) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, absent ones null.

    Extra columns are left behind; identity is trimmed and lower-cased here so
    every join on ``cid`` downstream is a plain equi-join.
    """
    have = set(df.columns)
    cols = []
    for field in schema:
        col = F.col(field.name) if field.name in have else F.lit(None)
        if field.name == "cid" and schema is LISTING:
            col = F.lower(F.trim(col.cast("string")))
        cols.append(col.cast(field.dataType).alias(field.name))
    out = df.select(*cols)
    return out.filter(F.col("cid").isNotNull() & (F.col("cid") != "")) if schema is LISTING else out


def lit_or(value, dtype: str) -> Column:
    col = value if isinstance(value, Column) else F.lit(value)
    return col.cast(dtype)


def measurement(*, vstr=None, vnum=None, vbool=None, confidence=1.0, error=None,
                note=None, version: int = 1, **evidence) -> Column:
    """One signal's answer as a struct column.

    The value is held by type (``vstr``/``vnum``/``vbool``; all null is an
    unknown value). Evidence is a typed struct, so a rule on
    ``signal.evidence_key`` compiles against a real column and columnar storage
    can skip evidence nobody reads.
    """
    facts = {**evidence, "note": lit_or(note, "string")}
    return F.struct(
        lit_or(vstr, "string").alias("vstr"),
        lit_or(vnum, "double").alias("vnum"),
        lit_or(vbool, "boolean").alias("vbool"),
        lit_or(confidence, "double").alias("confidence"),
        lit_or(error, "string").alias("error"),
        F.lit(version).alias("version"),
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k)
                   for k, v in facts.items()]).alias("evidence"),
    )


def first_case(*branches, default=None) -> Column:
    """``branches`` are (condition, value) pairs; the first true one answers."""
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def pinned(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with ``cols`` computed here, once per row.

    Catalyst moves a filter below a projection by writing the projected
    expression into it, at every place it is read. For columns derived from
    columns that multiplies without end. A one-row ``inline`` gives the values
    as plain attributes that nothing is rewritten through; it stays in the same
    stage and adds no shuffle.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*cols)))) if cols else df


def is_failed(sig: Column) -> Column:
    return F.coalesce(sig["error"], F.lit("")) != ""
