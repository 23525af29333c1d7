"""Web addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..reference_data import NON_WEB_SCHEMES
from .text import text

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def authority(url: Column) -> Column:
    """What stands between ``//`` and the path; the head of a scheme-less URL."""
    slashed = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.when(slashed != "", slashed).otherwise(F.regexp_extract(url, r"^([^/?#]*)", 1))


def bare_host(netloc: Column) -> Column:
    host = F.substring_index(F.substring_index(F.lower(netloc), "@", -1), ":", 1)
    return F.regexp_replace(host, r"^www\.", "")


def hostname(url: Column) -> Column:
    """Lower-case host without credentials, port or ``www.``; empty when the
    value is not a web address (a mail or phone link)."""
    raw = text(url)
    return F.when(scheme(raw).isin(NON_WEB_SCHEMES), F.lit("")).otherwise(bare_host(authority(raw)))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def normalise(url: Column) -> Column:
    """The key pages are stored under: absolute http(s), path at least ``/``,
    fragment dropped. Empty for anything else."""
    raw = text(url)
    given = scheme(raw)
    full = F.when(given == "", F.concat(F.lit("https://"), raw)).otherwise(raw)
    kind = F.lower(F.regexp_extract(full, r"^([A-Za-z]+)://", 1))
    host = F.regexp_extract(full, r"^[A-Za-z]+://([^/?#]*)", 1)
    path = F.regexp_extract(full, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    usable = (raw != "") & kind.isin("http", "https") & (host != "")
    return F.when(usable, F.concat(
        kind, F.lit("://"), host,
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )).otherwise(F.lit(""))


def _without_dots(path: Column) -> Column:
    """``path`` with ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(part))))
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), tail)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as an absolute URL seen from page ``base``."""
    kind = F.regexp_extract(base, SCHEME, 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = path_of(base)
    folder = F.regexp_extract(page, r"^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    rel_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    joined = F.when(href.startswith("/"), rel_path).otherwise(F.concat(folder, rel_path))
    joined = F.when(joined.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(joined)).otherwise(joined)
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(kind, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(root, page, href))
        .otherwise(F.concat(root, joined, rest)))
