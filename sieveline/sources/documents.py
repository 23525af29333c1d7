"""Elements of large JSON documents, a document in many byte ranges.

What a byte of JSON means depends on all before it: whether it is in a string,
and how deep. So each range first says, for either way it may start, how it
changes both; joined in order, these give every range its start. Then each range
yields the objects that begin in it, reading on past its end for the last one.
A document's size is bounded by neither a string nor a variant; one object's is.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .heads import Misfit, opened

# functions of this module travel to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE = 8 << 20              # bytes of a range
TASKS = 10_000               # tasks that walk ranges, at most

# bytes that JSON is built of
OPEN, CLOSE = (np.isin(np.arange(256), list(kind)) for kind in (b"[{", b"]}"))        # by byte
BLANK = b" \t\r\n"
ROWS = 1000                  # rows handed on together


def unescaped_quotes(data: np.ndarray, before: bytes) -> np.ndarray:
    """Places of the quotes in ``data`` that no backslash escapes; ``before`` is what stands in front of it."""
    run = len(before) - len(before.rstrip(b"\\"))
    quotes = np.flatnonzero(data == 34)
    slash = np.concatenate([np.arange(-run, 0), np.flatnonzero(data == 92)])
    if not len(slash):
        return quotes
    first = np.concatenate([[True], np.diff(slash) > 1])       # of backslashes in a row
    since = slash[np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))]
    at = np.maximum(np.searchsorted(slash, quotes) - 1, 0)     # the last backslash before a quote
    slashes = np.where(slash[at] == quotes - 1, quotes - since[at], 0)
    return quotes[slashes % 2 == 0]


def structure(data: np.ndarray, before: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and changes of depth of the brackets outside strings, and whether the end is in a string."""
    quotes = unescaped_quotes(data, before)
    opens, closes = OPEN[data], CLOSE[data]
    at = np.flatnonzero(opens | closes)
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    return at, np.where(opens[at], 1, -1), bool((len(quotes) + inside) % 2)


def piece(f, at: int, to: int) -> tuple[np.ndarray, bytes]:
    """The bytes of a range, and those before it that decide whether its first is escaped."""
    back = 64
    while True:
        start = max(0, at - back)
        before = f.read_at(at - start, start)
        if start == 0 or before.strip(b"\\"):
            return np.frombuffer(f.read_at(to - at, at), np.uint8), before
        back *= 16


def _ranges(spark: SparkSession, files, size: int) -> DataFrame:
    """``path, length, at, to``, in order of files and places."""
    rows = spark.createDataFrame([(f.path, f.length) for f in files], "path string, length long").withColumn(
        "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    return rows.withColumn("to", F.least(F.col("at") + size, F.col("length"))).repartitionByRange(_tasks(files), "path", "at") \
        .sortWithinPartitions("path", "at")


def _tasks(files) -> int:
    return min(TASKS, sum(f.length for f in files) // RANGE + 1)


def _summary(batches):
    """Of each range: whether it ends in the other state than it starts in, and its change of depth for either start."""
    for batch in batches:
        for path, length, at, to in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "at", "to"))):
            with opened(path) as f:
                data, before = piece(f, at, to)
            (_, out, turned), (_, in_, _) = structure(data, before, False), structure(data, before, True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), *(pa.array([v], pa.int64()) for v in (length, at, to)), pa.array([turned]),
                 pa.array([int(out.sum())], pa.int64()), pa.array([int(in_.sum())], pa.int64())],
                names=["path", "length", "at", "to", "turned", "out", "within"])


STARTS = "path string, length long, at long, to long, inside boolean, depth long"


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """How each range of a document starts."""
    frame = frame.sort_values("at")
    turned = frame["turned"].to_numpy().astype(np.int64)
    inside = (np.cumsum(turned) - turned) % 2 == 1
    change = np.where(inside, frame["within"], frame["out"])
    depth = np.cumsum(change) - change
    if turned.sum() % 2 or change.sum() != 0 or (depth < 0).any():
        raise Misfit(f"not one whole JSON document: {frame['path'].iloc[0]}")
    return frame[["path", "length", "at", "to"]].assign(inside=inside, depth=depth)


def starts(spark: SparkSession, files, size: int = RANGE) -> DataFrame:
    """``path, length, at, to, inside, depth``: the ranges of the documents and how each starts."""
    told = _ranges(spark, files, size).mapInArrow(_summary, "path string, length long, at long, to long, turned boolean, out long, within long")
    return settle(told.groupBy("path").applyInPandas(_joined, STARTS), "document-ranges")


def _after(f, place: int, length: int) -> int:
    """The first byte after ``place`` that is not blank, or -1."""
    while place + 1 < length:
        block = f.read_at(min(4096, length - place - 1), place + 1).lstrip(BLANK)
        if block:
            return block[0]
        place += 4096
    return -1


def _arrays(batches):
    """Where a document's own fields open an array of objects (its first item is one), and where arrays of it close."""
    for batch in batches:
        for path, length, at, to, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "at", "to", "inside", "depth"))):
            with opened(path) as f:
                data, before = piece(f, at, to)
                place, change, _ = structure(data, before, inside)
                after = depth + np.cumsum(change)
                opens = place[(change > 0) & (after == 2) & (data[place] == 91)]
                opens = [p for p in opens.tolist() if _after(f, at + p, length) == 123]
                closes = place[(change < 0) & (after == 1) & (data[place] == 93)].tolist()
            n = len(opens) + len(closes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array([at + p for p in opens + closes], pa.int64()),
                 pa.array([True] * len(opens) + [False] * len(closes), pa.bool_())], names=["path", "place", "opens"])


def _held(begun: DataFrame) -> DataFrame:
    """``path, level, low, high``: how deep, and between which places, a document's rows stand. Without an array of objects it is the row."""
    marks = settle(begun.mapInArrow(_arrays, "path string, place long, opens boolean"), "document-arrays")
    first = marks.filter("opens").groupBy("path").agg(F.min("place").alias("low"))
    last = marks.filter("NOT opens").join(first, "path").filter("place > low").groupBy("path", "low").agg(F.min("place").alias("high"))
    return begun.select("path").distinct().join(last, "path", "left").select(
        "path", F.when(F.col("low").isNull(), 0).otherwise(2).alias("level"),
        F.coalesce("low", F.lit(-1)).alias("low"), F.coalesce("high", F.lit(2**62)).alias("high"))


def _objects(batches):
    """The objects that begin in each range at the wanted depth, as text."""
    for batch in batches:
        for path, length, at, to, inside, depth, level, low, high in zip(*(batch.column(c).to_pylist() for c in (
                "path", "length", "at", "to", "inside", "depth", "level", "low", "high"))):
            with opened(path) as f:
                data, before = piece(f, at, to)
                place, change, ends_inside = structure(data, before, inside)
                after = depth + np.cumsum(change)
                done = place[(change < 0) & (after == 0)]
                rest = bytes(data[(int(done[0]) + 1 if len(done) else 0 if depth == 0 and at else len(data)):]).strip(BLANK)
                if rest:
                    raise Misfit(f"more than one JSON value, with a first line longer than can be told apart: {path}")
                begin = place[(change > 0) & (after == level + 1) & (data[place] == 123)]
                begin = begin[(at + begin > low) & (at + begin < high)]
                end = place[(change < 0) & (after == level)]
                which = np.searchsorted(end, begin)
                raw = data.tobytes()
                out = [(int(b), raw[b:end[w] + 1]) for b, w in zip(begin, which) if w < len(end)]
                if len(out) < len(begin):                      # the last one goes on beyond the range
                    b = int(begin[-1])
                    parts, on, deep, open_ = [raw[b:]], to, int(after[-1]), ends_inside
                    while on < length:
                        more, back = piece(f, on, min(on + RANGE, length))
                        place, change, ends = structure(more, back, open_)
                        levels = deep + np.cumsum(change)
                        closed = place[(change < 0) & (levels == level)]
                        parts.append(more.tobytes()[:int(closed[0]) + 1] if len(closed) else more.tobytes())
                        if len(closed):
                            break
                        on, deep, open_ = on + len(more), int(levels[-1]) if len(levels) else deep, ends
                    out.append((b, b"".join(parts)))
            for i in range(0, len(out), ROWS):
                part = out[i:i + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(part)), pa.array([at + b for b, _ in part], pa.int64()),
                     pa.array([text.decode("utf-8", "replace") for _, text in part])], names=["path", "place", "value"])


def objects(spark: SparkSession, files, kind: str, size: int = RANGE) -> DataFrame:
    """``path, place, value``: each row of the documents ``files`` (path and length each) as JSON text, in order.

    Of an ``array``, its objects; of a ``document``, those of its first field
    that is a list beginning with an object, or else the document itself.
    Anything but one whole JSON value in a file is an error.
    """
    begun = starts(spark, files, size)
    if kind == "array":
        held = begun.withColumns({"level": F.lit(1), "low": F.lit(-1).cast("long"), "high": F.lit(2**62)})
    else:
        held = begun.join(_held(begun), "path")
    return held.repartitionByRange(_tasks(files), "path", "at").sortWithinPartitions("path", "at").mapInArrow(
        _objects, "path string, place long, value string")
