"""Sources by name, and the landed tables read as they are."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import REVIEW, SITE_PAGE
from ..operators.listings import latest, union_sources
from ..reference_data import SOURCE_CAPS
from ..session import settle
from . import landed, mapsearch, osm

Reader = Callable[[SparkSession, dict], DataFrame]
_READERS: dict[str, Reader] = {}


def source(name: str, *, takes: str = "path", cannot_measure=(), instead=None):
    """Register ``reader(spark, options) -> listings``."""
    def wrap(fn: Reader) -> Reader:
        if name in _READERS:
            raise ValueError(f"source {name!r} registered twice")
        _READERS[name] = fn
        SOURCE_CAPS.setdefault(name, {"takes": takes, "cannot_measure": list(cannot_measure),
                                      "instead": dict(instead or {})})
        return fn
    return wrap


def names() -> list[str]:
    return sorted(_READERS)


def read(spark: SparkSession, name: str, options: dict) -> DataFrame:
    if name not in _READERS:
        raise KeyError(f"no source {name!r}; have {', '.join(names())}")
    return _READERS[name](spark, options)


@source("file")
def _file(spark, options):
    return landed.read_listings(spark, options["path"], options.get("mapping"), options.get("limit"),
                                options.get("multiline", True))


@source("osm")
def _osm(spark, options):
    return osm.to_listings(osm.read_elements(spark, options["path"], options.get("place")),
                           options.get("tags"), options.get("box"))


@source("mapsearch")
def _mapsearch(spark, options):
    return mapsearch.to_listings(spark.read.parquet(options["path"]), options.get("fields"))


REPORT = "source string, place string, status string, why string"


def read_all(spark: SparkSession, specs, places: DataFrame | None = None, land: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every enabled source's listings, and a report of those that failed.

    A source that cannot be read brings nothing and stops no other. With
    ``land`` each is written once to the shared folder, so that this holds for
    failures while its rows are read as well, a torn file among good ones.
    ``places`` (``place``) are what sources that search by place bring rows of;
    a place without any is reported ``empty``.
    """
    frames, report, searched = [], [], []
    for i, spec in enumerate(specs):
        sid = spec.get("id") if isinstance(spec, dict) else spec
        if isinstance(spec, dict) and spec.get("enabled") is False:
            continue
        try:
            rows = read(spark, sid, (spec.get("options") if isinstance(spec, dict) else {}) or {})
            by_place = places is not None and SOURCE_CAPS.get(sid, {}).get("takes") == "places"
            if by_place:
                wanted = places.select(F.lower("place").alias("_place")).distinct()
                rows = rows.join(wanted, F.lower("place_label") == F.col("_place"), "left_semi")
            if land:
                rows = settle(rows, f"source-{i}")
            frames.append(rows)
            report.append((sid, None, "ok", None))
            if by_place:
                searched.append((sid, rows))
        except Exception as exc:                               # noqa: BLE001
            report.append((sid, None, "fatal", f"{type(exc).__name__}: {exc}"))
    told = spark.createDataFrame(report, REPORT)
    for sid, rows in searched:
        seen = rows.select(F.lower("place_label").alias("_place")).distinct()
        told = told.unionByName(places.join(seen, F.lower("place") == F.col("_place"), "left_anti").select(
            F.lit(sid).alias("source"), "place", F.lit("empty").alias("status"), F.lit("read, and held nothing").alias("why")))
    if not frames:
        from ..model import LISTING
        return spark.createDataFrame([], LISTING), told
    return union_sources(*frames), told


def capabilities(spark: SparkSession) -> DataFrame:
    """(source, signal, instead): what each source cannot supply."""
    rows = [(s, sig, cap["instead"].get(sig)) for s, cap in SOURCE_CAPS.items() for sig in cap["cannot_measure"]]
    return spark.createDataFrame(rows, "source string, signal string, instead string")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW).json(path).withColumn("ord", F.monotonically_increasing_id())


def read_site_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITE_PAGE).parquet(path)


def read_journal(spark: SparkSession, path: str, schema) -> DataFrame:
    """A verdict journal; the last row per id wins and a torn line costs itself."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return latest(rows.filter(F.col("cid").isNotNull()).withColumn("_at", landed.file_order()),
                  "cid", "_at").drop("_at")


def effective_packs(terms: DataFrame) -> DataFrame:
    """Pack rows ``(pack_id, origin_rank, …)``: the highest origin replaces a
    pack whole. A row without a pack id is an error."""
    top = terms.groupBy("pack_id").agg(F.max("origin_rank").alias("origin_rank"))
    checked = terms.withColumn("pack_id", F.when(
        F.col("pack_id").isNull(), F.raise_error(F.lit("a pack row has no pack id"))).otherwise(F.col("pack_id")))
    return checked.join(top, ["pack_id", "origin_rank"], "left_semi")
