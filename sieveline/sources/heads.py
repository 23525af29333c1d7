"""What landed files are, told by the first bytes of each.

One pass over the files reads a bounded head of every one: its format, its
encoding and, for CSV, its header. Files alike in all three are read together;
a file that fits no format is an error, never a silently odd row.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
import zlib
from urllib.parse import urlsplit

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..reference_data import CLOSURE_FLAGS, HEADER_ALIASES, NESTED_COORDS

# functions of this module travel to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 64 << 10              # bytes of a file read to tell what it is,
MOST = 4 << 20               # and at most, where a first line or header is longer
HEAD_SCHEMA = "path string, length long, kind string, encoding string, header array<string>"

UTF16 = (b"\xff\xfe", b"\xfe\xff")
# How files begin that are no text.
BINARY = (b"PK\x03\x04", b"PAR1", b"%PDF", b"\xd0\xcf\x11\xe0", b"Obj\x01", b"ORC")
PACKED = (".bz2", ".deflate", ".lz4", ".snappy", ".zst")

KNOWN_TITLES = sorted({a for names in HEADER_ALIASES.values() for a in names} | set(CLOSURE_FLAGS) | set(NESTED_COORDS))


class Misfit(ValueError):
    """A landed file that cannot be read as what it seems to be."""


def opened(uri: str):
    """A landed file as a seekable stream, where Python reaches its store."""
    from pyarrow import fs
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(uri[len(parts.scheme) + 1:] if parts.scheme else uri)
    store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return store.open_input_file(path)


def tell(read, length: int, name: str) -> tuple[str, str, list[str] | None]:
    """(kind, encoding, header) of a file: csv, column (one cell, no known title), jsonl, array, document, empty or
    misfit. ``read(n)`` gives its first n bytes."""
    n = HEAD
    while True:
        raw = read(n)
        whole = len(raw) >= length
        if raw[:2] == b"\x1f\x8b":
            if not name.endswith(".gz"):
                return "misfit", "", None
            box = zlib.decompressobj(31)
            raw = box.decompress(raw, n)
            whole = whole and box.eof
        if raw.startswith(BINARY) or name.endswith(PACKED):
            return "misfit", "", None
        encoding = "UTF-16" if raw[:2] in UTF16 else "UTF-8"
        text = raw.decode("utf-16" if encoding == "UTF-16" else "utf-8-sig", errors="ignore").lstrip()
        if encoding == "UTF-8" and sum(c < " " and c not in "\t\n\r\f\v\0" for c in text[:4096]) * 20 > len(text[:4096]):
            return "misfit", "", None
        told = _shape(text, whole)
        if told is not None:
            return told[0], encoding, told[1]
        if n >= MOST:
            return ("document" if text[:1] == "{" else "misfit"), encoding, None
        n *= 8


def _shape(text: str, whole: bool) -> tuple[str, list[str] | None] | None:
    """(kind, header) as far as ``text`` says, None where more of the file is wanted."""
    if not text:
        return ("empty", None) if whole else None
    if text[0] == "[":
        return "array", None
    first, line_end, rest = text.partition("\n")
    if text[0] == "{":
        if not line_end and not whole:
            return None
        try:
            json.loads(first)
        except ValueError:
            return ("jsonl" if _torn(first.rstrip(), rest.lstrip("\r\n").partition("\n")[0].rstrip()) else "document"), None
        if rest.strip():
            return "jsonl", None
        return ("document", None) if whole else None
    try:
        rows = csv.reader(io.StringIO(text, newline=""))
        header = next((r for r in rows if r), [])
        if not whole and next(rows, None) is None:             # the header may go on
            return None
    except csv.Error:
        return None if not whole else ("misfit", None)
    header = [t.replace("﻿", "").replace("\0", "") for t in header]
    if len(header) == 1 and header[0].strip().lower() not in KNOWN_TITLES:
        return "column", header
    return "csv", header


def _torn(first: str, second: str) -> bool:
    """Whether a first line that isn't JSON is a torn record before others, rather than the beginning of a document."""
    if not second.startswith("{") or first.endswith("["):
        return False
    try:
        json.loads(second)
        return True
    except ValueError:
        return not first.endswith(("{", ",", ":"))


def _listed(spark: SparkSession, path) -> DataFrame:
    """``path, length`` of every landed file; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _by_spark(spark: SparkSession, uri: str, n: int) -> bytes:
    """The first bytes of a file in a store that only Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(uri)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def in_reach(spark: SparkSession, uri: str) -> bool:
    """Whether Python opens files of this store."""
    try:
        opened(uri).close()
        return True
    except Exception:                                          # noqa: BLE001
        return False


def file_heads(spark: SparkSession, path) -> DataFrame:
    """``path, length, kind, encoding, header`` of every landed file, empty ones included."""
    import pyarrow as pa
    listed = _listed(spark, path)
    first = listed.first()
    if first is None or in_reach(spark, first.path):
        def run(batches):
            for batch in batches:
                for p, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                    with opened(p) as f:
                        kind, encoding, header = tell(lambda n: f.read_at(min(n, length), 0), length, p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p]), pa.array([length], pa.int64()), pa.array([kind]), pa.array([encoding]),
                         pa.array([header], pa.list_(pa.string()))], names=["path", "length", "kind", "encoding", "header"])

        return listed.mapInArrow(run, HEAD_SCHEMA)
    told = [(r.path, r.length, *tell(lambda n, r=r: _by_spark(spark, r.path, n), r.length, r.path)) for r in listed.toLocalIterator()]
    return spark.createDataFrame(told, HEAD_SCHEMA)


def groups(spark: SparkSession, path) -> list[Row]:
    """Files to read together, in the order of their first names: ``kind, encoding, header, files`` (path and length each).

    Only what a reader must name comes to the driver: paths, and a header for
    each group. Lists of bare values, whose first lines all differ, are one group.
    """
    heads = file_heads(spark, path)
    title = F.when(F.col("kind") != "column", F.col("header"))
    rows = heads.groupBy("kind", "encoding", title.alias("title")).agg(
        F.sort_array(F.collect_list(F.struct("path", "length"))).alias("files"), F.min(F.struct("path", "header"))["header"].alias("header"),
        F.count_distinct("header").alias("titles")).orderBy(F.col("files")[0]["path"]).collect()
    odd = [f.path for r in rows if r.kind == "misfit" for f in r.files]
    if odd:
        raise Misfit(f"neither CSV nor JSON that can be read as it is: {', '.join(odd[:5])}" + f" and {len(odd) - 5} more" * (len(odd) > 5))
    # one list of bare values, or several with one first line, may as well have a title
    return [Row(kind="csv" if r.kind == "column" and r.titles == 1 else r.kind, encoding=r.encoding, header=r.header, files=r.files)
            for r in rows if r.kind != "empty"]


def escaped(path: str) -> str:
    """A file's own name, where a reader would take a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)
