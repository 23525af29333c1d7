"""Repeated substrings: every byte covered by a ``LENGTH``-byte string that stands elsewhere too.

A corpus has no suffix array that one machine could hold, and needs none: only
suffixes that start at anchors are sorted. Every window of ``LENGTH`` bytes has
one anchor, the gram in it whose hash is least, so equal windows have equal
anchors at equal offsets. The windows that share an anchor are a fragment.

1. Anchors are counted over the corpus; those that stand once are done with.
2. Fragments alike in all their bytes are one, with a count: copies, however
   many, are collapsed before anything is grouped.
3. The distinct fragments of one anchor form an enhanced suffix array: sorted
   by what follows the anchor, with the common-prefix lengths of neighbours. A
   stack scan yields its tree of common-prefix intervals. Within an interval
   the occurrences are told apart by what stands before the anchor; where they
   agree for long enough, they and their extension are a maximal repeat group,
   with all its occurrences.
4. What is covered goes back to every text that holds the fragment.

An anchor with more than ``WIDE`` distinct fragments isn't sorted in one task:
its windows are counted by their hashes, which Spark adds up before shuffling.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import settle

from .common import map_texts, read, utf8
from .registry import query

LENGTH = 200                 # bytes of a repeated string
GRAM = 32                    # bytes an anchor is chosen by
WIDE = 20_000                # distinct fragments of an anchor that one task sorts
PIECE = 256 << 10            # bytes of text hashed at once
ROWS = 256                   # texts unpacked at once
SORTED = 8_000               # fragments sorted at once (whole groups; a group may be larger)

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F],
               np.uint64)


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place, doubled up from single bytes."""
    h, size, k = flat.astype(np.uint64) + np.uint64(1), 1, 0
    while size < GRAM:
        h = h[:-size] * MIX[k] + h[size:] * MIX[k + 1]
        h ^= h >> np.uint64(29)
        size, k = 2 * size, k + 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:size - width], x[width - size:]) if width > size else x


def pieces(raws: list[bytes]):
    """(texts, first byte of each in its own text) of about ``PIECE`` bytes; longer texts are cut with all windows kept."""
    held, at, size = [], [], 0
    for which, raw in enumerate(raws):
        for a in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            part = raw[a:a + PIECE + LENGTH - 1] if len(raw) > PIECE else raw
            if held and size + len(part) > 2 * PIECE:
                yield held, at
                held, at, size = [], [], 0
            held.append(part)
            at.append((which, a))
            size += len(part)
    if held:
        yield held, at


def fragments(raws: list[bytes]):
    """For pieces of the texts: text number, first window, windows and anchor's hash and offset of each fragment."""
    for held, at in pieces([r for r in raws]):
        flat = np.frombuffer(b"".join(held), np.uint8)
        if len(flat) < LENGTH:
            continue
        grams = gram_hashes(flat)
        packed = grams >> np.uint64(24) << np.uint64(24) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(packed, LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        size = np.fromiter(map(len, held), np.int64, len(held))
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(held)), size)[:len(anchor)]
        inside = np.arange(len(anchor)) + LENGTH <= (begin + size)[owner]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new & inside)
        # a fragment ends where the next begins or where its text has no further window
        stop = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside)
        which = np.array([w for w, _ in at], np.int64)[owner[first]]
        start = first - begin[owner[first]] + np.array([a for _, a in at], np.int64)[owner[first]]
        yield which, start, stop - first + 1, grams[anchor[first]].view(np.int64), anchor[first] - first


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``th`` and ``raw``: a text's hash and bytes; null is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("th"), text.alias("text"))


def anchor_counts(texts: DataFrame) -> DataFrame:
    """Anchors that stand twice or more."""
    def step(batch):
        got = [a for _, _, _, a, _ in fragments(utf8(batch.column("text")))]
        anchor, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
        return {"anchor": pa.array(anchor), "n": pa.array(n.astype(np.int64))}

    return (map_texts(texts, ["text"], "anchor long, n long", step).groupBy("anchor").agg(F.sum("n").alias("n"))
            .filter("n > 1").select("anchor"))


def placed_fragments(texts: DataFrame) -> DataFrame:
    """``anchor, frag, th, place`` of every fragment; ``place`` packs its first window, windows and anchor offset."""
    def step(batch):
        raws, ths = utf8(batch.column("text")), batch.column("th").to_numpy(zero_copy_only=False)
        out = [(np.zeros(0, np.int64),) * 4]
        for which, start, n, anchor, offset in fragments(raws):
            frag = np.fromiter((xxhash.xxh64_intdigest(raws[w][s:s + k + LENGTH - 1])
                                for w, s, k in zip(which.tolist(), start.tolist(), n.tolist())), np.uint64, len(which))
            out.append((anchor, frag.view(np.int64), ths[which], start << 16 | n << 8 | offset))
        return {name: pa.array(np.concatenate(x)) for name, x in zip(("anchor", "frag", "th", "place"), zip(*out))}

    return map_texts(texts, ["th", "text"], "anchor long, frag long, th long, place long", step)


START, WINDOWS, OFFSET = "shiftright(place, 16)", "(shiftright(place, 8) & 255)", "(place & 255)"


def packed(texts: DataFrame, *more: str) -> DataFrame:
    """The texts compressed, for a shuffle; ``size`` is that of the text."""
    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in more), "th long, size long, z binary"])
    box = []

    def step(batch):
        if not box:
            box.append(zstandard.ZstdCompressor(level=3))
        raws = utf8(batch.column("text"))
        return {**{c: batch.column(c) for c in (*more, "th")}, "size": pa.array([len(r) for r in raws], pa.int64()),
                "z": pa.array([box[0].compress(r) for r in raws], pa.binary())}

    return map_texts(texts, [*more, "th", "text"], schema, step)


def common_prefix(rows: list[bytes]) -> np.ndarray:
    """How many bytes each row shares with the one before (0 for the first)."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    width = int(size.max()) if len(rows) else 0
    table = np.zeros((len(rows), width + 1), np.uint8)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    table[:, :width][np.arange(width) < size[:, None]] = flat
    differ = table[1:] != table[:-1]
    differ[:, width] = True
    return np.concatenate([[0], np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1]))]).astype(np.int64)


def intervals(lcp: list[int]):
    """(depth, first, last) of the common-prefix intervals of an enhanced suffix array, inner ones first."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack[-1][0] > depth:
            top, left = stack.pop()
            yield top, left, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, left))


def maximal_repeats(anchors: list[int], before: list[bytes], after: list[bytes], length: int = LENGTH):
    """Maximal repeat groups of at least ``length`` bytes among suffixes at anchors.

    ``before`` is reversed. Yields (members, how far each reaches back, depth
    that all share after the anchor): members of an interval that agree before
    the anchor too, each with the longest agreement that another has with it.
    An interval whose members all go on alike to the left is extended so far
    and no further: a group is closed on both sides.
    """
    n = len(anchors)
    order = sorted(range(n), key=lambda i: (anchors[i], after[i]))
    lcp = common_prefix([after[i] for i in order])
    back = sorted(range(n), key=lambda i: (anchors[i], before[i]))
    left = common_prefix([before[i] for i in back])
    key, rkey = np.array([anchors[i] for i in order]), np.array([anchors[i] for i in back])
    lcp[1:][key[1:] != key[:-1]] = 0
    left[1:][rkey[1:] != rkey[:-1]] = -1
    rank = np.empty(n, np.int64)
    rank[back] = np.arange(n)
    members, lefts, back_of = rank[order], left.tolist(), np.array(back, np.int64)
    for depth, a, b in intervals(lcp.tolist()):
        if b == a + 1:                                         # the common case, without arrays
            x, y = int(members[a]), int(members[b])
            x, y = (x, y) if x < y else (y, x)
            reach = min(lefts[x + 1:y + 1])
            if reach + depth >= length:
                yield back_of[[x, y]], np.array([reach, reach]), depth
            continue
        own = np.sort(members[a:b + 1])
        # the agreement of neighbours in left order is the least on the way between them
        gap = np.minimum.reduceat(left[:own[-1] + 1], own[:-1] + 1)
        near = np.maximum(np.concatenate([[-1], gap]), np.concatenate([gap, [-1]]))
        fits = near + depth >= length
        if fits.any():
            # neighbours that don't agree far enough part the members into groups
            group = np.cumsum(np.concatenate([[False], gap + depth < length]))[fits]
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for rows, reach in zip(np.split(own[fits], at[1:]), np.split(near[fits], at[1:])):
                yield back_of[rows], reach, depth


def covered(rows: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of fragments (anchor, anchor's offset, copies, bytes): from where to where each is covered; empty where not."""
    after = [raw[p:p + LENGTH] for _, p, _, raw in rows]
    before = [raw[:p][::-1] for _, p, _, raw in rows]
    low, high = np.full(len(rows), LENGTH, np.int64), np.zeros(len(rows), np.int64)
    for members, reach, depth in maximal_repeats([r[0] for r in rows], before, after):
        low[members] = np.minimum(low[members], -reach)
        high[members] = np.maximum(high[members], depth)
    place = np.array([p for _, p, _, _ in rows], np.int64)
    size = np.array([len(raw) for _, _, _, raw in rows], np.int64)
    many = np.array([m for _, _, m, _ in rows]) > 1
    found = high > 0
    return (np.where(many | ~found, 0, place + low), np.where(many, size, np.where(found, place + high, 0)))


def spans(docs: DataFrame) -> DataFrame:
    """``th, spans`` of the texts that hold repeated strings: byte intervals, as found (they may overlap)."""
    texts = keyed(docs)
    held = settle(placed_fragments(texts).join(anchor_counts(texts), "anchor"), "fragments")
    distinct = held.groupBy("anchor", "frag").agg(F.min(F.struct("th", "place")).alias("at"), F.count(F.lit(1)).alias("m"))
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    distinct = settle(distinct.join(kinds, "anchor"), "distinct-fragments")

    # an anchor whose fragments are all alike: copies, covered whole
    whole = distinct.filter("kinds = 1").selectExpr("anchor", "frag", "0 AS low", "32767 AS high")
    mixed = distinct.filter("kinds > 1").selectExpr(
        "at.th AS th", "anchor", "frag", "at.place AS place", "m", f"kinds > {WIDE} AS wide")
    wanted = mixed.groupBy("th").agg(F.collect_list(F.struct("anchor", "frag", "place", "m", "wide")).alias("want"))
    one_of_each = packed(texts).dropDuplicates(["th"]).select("th", "z")

    def cut(batches):
        box = zstandard.ZstdDecompressor()
        for batch in few(batches):
            for z, want in zip(batch.column("z").to_pylist(), batch.column("want").to_pylist()):
                raw = box.decompress(z)
                rows = [{**w, "offset": w["place"] & 255,
                         "raw": raw[w["place"] >> 16:(w["place"] >> 16) + (w["place"] >> 8 & 255) + LENGTH - 1]} for w in want]
                for r in rows:
                    del r["place"]
                yield pa.RecordBatch.from_pylist(rows, schema=CUT)

    cuts = one_of_each.join(wanted, "th").select("z", "want").mapInArrow(
        cut, "anchor long, frag long, m long, wide boolean, offset int, raw binary")
    if distinct.filter(f"kinds > {WIDE}").isEmpty():
        narrow, found = cuts, None
    else:
        cuts = settle(cuts, "cut-fragments")
        narrow, found = cuts.filter("NOT wide"), _wide(cuts.filter("wide"))

    def scan(batches):
        rows: list[tuple] = []

        def answer(part):
            low, high = covered([(r[0], r[3], r[2], r[4]) for r in part])
            hit = np.flatnonzero(high > low)
            return pa.RecordBatch.from_arrays(
                [pa.array([part[i][0] for i in hit], pa.int64()), pa.array([part[i][1] for i in hit], pa.int64()),
                 pa.array(low[hit].astype(np.int32)), pa.array(high[hit].astype(np.int32))],
                names=["anchor", "frag", "low", "high"])

        for batch in batches:
            for a in range(0, batch.num_rows, SORTED):
                part = batch.slice(a, SORTED)
                rows += zip(*(part.column(c).to_pylist() for c in ("anchor", "frag", "m", "offset", "raw")))
                if len(rows) >= SORTED:                        # the last group may go on
                    end = len(rows)
                    while end and rows[end - 1][0] == rows[-1][0]:
                        end -= 1
                    if end:
                        yield answer(rows[:end])
                        rows = rows[end:]
        if rows:
            yield answer(rows)

    some = narrow.repartition("anchor").sortWithinPartitions("anchor", "frag").select(
        "anchor", "frag", "m", "offset", "raw").mapInArrow(scan, "anchor long, frag long, low int, high int")
    found = some if found is None else some.union(found)
    answers = whole.union(found)
    hits = held.join(answers, ["anchor", "frag"]).selectExpr(
        "th", f"{START} + low AS a", f"least({START} + high, {START} + {WINDOWS} + {LENGTH - 1}) AS b")
    # every copy of a text has the same hits: one of each, so that a list is bounded by its text however many copies there are
    return hits.distinct().groupBy("th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


CUT = pa.schema([("anchor", pa.int64()), ("frag", pa.int64()), ("m", pa.int64()), ("wide", pa.bool_()),
                 ("offset", pa.int32()), ("raw", pa.binary())])


def _wide(cuts: DataFrame) -> DataFrame:
    """The same answer for anchors with very many fragments, by counting windows."""
    def windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, n = row["raw"], len(row["raw"]) - LENGTH + 1
                h = [xxhash.xxh3_64_intdigest(raw[s:s + LENGTH]) for s in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["anchor"]] * n, pa.int64()), pa.array([row["frag"]] * n, pa.int64()),
                     pa.array(np.arange(n, dtype=np.int32)), pa.array(np.array(h, np.uint64).view(np.int64)),
                     pa.array([row["m"]] * n, pa.int64())], names=["anchor", "frag", "s", "h", "m"])

    each = cuts.select("anchor", "frag", "m", "raw").mapInArrow(windows, "anchor long, frag long, s int, h long, m long")
    twice = each.groupBy("anchor", "h").agg(F.sum("m").alias("n")).filter("n > 1").select("anchor", "h")
    return each.join(twice, ["anchor", "h"]).groupBy("anchor", "frag").agg(
        F.min("s").alias("low"), (F.max("s") + LENGTH).cast("int").alias("high"))


def few(batches):
    """The batches in slices of ``ROWS`` rows: what is unpacked from one stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def spans_of(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    """The spans of each row as pairs."""
    column = batch.column("spans")
    flat = column.flatten()
    pairs = list(zip(flat.field("a").to_numpy(zero_copy_only=False).tolist(), flat.field("b").to_numpy(zero_copy_only=False).tolist()))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [pairs[a:b] for a, b in zip([0, *ends], ends)]


def runs(found: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal covered runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted((a, min(b, size)) for a, b in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in removed:
        left.append(raw[at:a])
        at = b
    return b"".join([*left, raw[at:]])


def with_spans(docs: DataFrame, *more: str) -> DataFrame:
    return packed(keyed(docs, *more), *more).join(spans(docs), "th", "left")


def measure(docs: DataFrame, with_runs: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the removed byte ``runs`` of each row of ``docs``.

    Null is empty; texts under ``LENGTH`` bytes hold nothing to remove. Rows
    with the same text cover each other wholly, if it is long enough. Texts are
    told apart by a 64-bit hash.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_runs:
        schema += ", runs array<struct<a:long,b:long>>"
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        box = zstandard.ZstdDecompressor()
        for batch in few(batches):
            rows = []
            for doc_id, size, z, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "z")), spans_of(batch)):
                removed = runs(found, size)
                kept = cut_out(box.decompress(z), removed) if size else b""
                rows.append((doc_id, size, sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept).hexdigest(),
                             [{"a": a, "b": b} for a, b in removed]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), kind]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"][:6 if with_runs else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(cols, kinds, names)], names=names)

    return with_spans(docs, "doc_id").select("doc_id", "size", "z", "spans").mapInArrow(run, schema)


def remove(docs: DataFrame) -> DataFrame:
    """The documents without their repeated strings; every row stays, a null text stays null.

    A character that a removed run cuts through goes as a whole.
    """
    def run(batches):
        box = zstandard.ZstdDecompressor()
        for batch in few(batches):
            rows = []
            for row, found in zip(batch.drop_columns(["spans"]).to_pylist(), spans_of(batch)):
                removed = runs(found, row["size"])
                text = None if row["none"] else box.decompress(row["z"]).decode()
                if removed:
                    text = cut_out(text.encode(), removed).decode("utf-8", "ignore")
                rows.append({"doc_id": row["doc_id"], "text": text, "lang": row["lang"], "source": row["source"],
                             "n_chars": len(text) if removed else row["n_chars"]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                 ("n_chars", pa.int64())]))

    named = docs.withColumn("none", F.col("text").isNull())
    return with_spans(named, "doc_id", "lang", "source", "n_chars", "none").mapInArrow(
        run, "doc_id long, text string, lang string, source string, n_chars long")


@query("op8_repeats")
def op8(spark, sf):
    return measure(read(spark, sf, "documents"), with_runs=False)
