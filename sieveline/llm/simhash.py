"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints within ``LINK`` differing bits are linked. The bits are cut
into parts that group correlated bits; part i gets a threshold t_i, and any two
linked fingerprints are within t_i on some part as long as the (t_i + 1) sum to
``LINK + 1``. Thresholds are unequal: a dynamic programme spends that sum where
it costs least, by the rows probed and the candidate pairs estimated from a
sample of fingerprints. Each fingerprint is filed under its value on every part
in use and under the values within t_i of it; fingerprints that meet are
compared in full.

Groups of copies share a fingerprint, which is looked at once. A value that
very many fingerprints share is cut into blocks, and every pair of blocks is a
task of bounded size; what a task hands on is a spanning forest of the links it
found, never all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import settle

from .common import DOCUMENT_COLUMNS, LOWER_BYTES, map_texts, read, utf8
from .components import components
from .registry import query

BITS = 64
LINK = 3                     # differing bits of linked fingerprints
SHINGLE = 3
SEED = 42
SAMPLE = 4_000               # fingerprints that the plan of parts is fitted on
BLOCK = 4_096                # fingerprints of one part value compared in one piece
PAIR_COST = 0.01             # of comparing two fingerprints, against filing one


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row, repeats too; a shorter text is one shingle, a text without words none."""
    words = raw.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, at, starts, ends = memoryview(b" ".join(words)), 0, [], []
    for n in map(len, words):
        starts.append(at)
        ends.append(at + n)
        at += n + 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1:])]
    return np.array(hashes, np.uint64)


def majority(h: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed 64-bit number; of none, zero."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(h, len(h) // 100_000 + 1):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(raw: bytes) -> int:
    """The SimHash of a text's word shingles."""
    return majority(shingle_hashes(raw, SHINGLE))


def fingerprints(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """``doc_id, fp`` and the columns ``more`` of each row; a text without words has the fingerprint zero."""
    more = more or []
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in more), "fp long"])

    def step(batch):
        return {**{c: batch.column(c) for c in ["doc_id", *more]},
                "fp": pa.array([fingerprint(t) for t in utf8(batch.column("text"))], pa.int64())}

    return map_texts(docs, ["doc_id", *more, "text"], schema, step)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size: each starts with the freest bit left and takes those most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(0)
    norm = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    tied = np.abs(norm.T @ norm) / max(1, len(bits))
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda b: (spread[b], -b))
        group = sorted(left, key=lambda b: (b != first, -tied[first, b], b))[:size]
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def mask_of(group: list[int]) -> int:
    return sum(1 << b for b in group)


def plan(sample: np.ndarray, total: int) -> list[tuple[int, int]]:
    """(mask of bits, threshold) of the parts in use, at the least estimated cost for ``total`` fingerprints."""
    best, chosen = np.inf, []
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    for parts in range(2, LINK + 2):
        groups = group_bits(sample, parts)
        cost = []
        for g in groups:
            near = np.zeros(LINK + 1)
            own = sample & np.uint64(mask_of(g))
            for i in range(len(own) - 1):
                near += np.bincount(np.bitwise_count(own[i] ^ own[i + 1:]), minlength=BITS + 1)[:LINK + 1]
            filed = np.cumsum([comb(len(g), t) for t in range(LINK + 1)])
            # what meets under a value: a sample may hold no such pair, an even spread of values always would
            meet = np.maximum(np.cumsum(near) / pairs, filed / 2.0 ** len(g)) * (total / 2.0 * total) * filed
            cost.append([0.0, *(total * filed + PAIR_COST * meet)])
        # cheapest[s]: spending s units, t + 1 for each part (none: the part is not used)
        cheapest = {0: (0.0, ())}
        for c in cost:
            step: dict = {}
            for spent, (so_far, taken) in cheapest.items():
                for units in range(LINK + 2 - spent):
                    offer = (so_far + c[units], (*taken, units))
                    if offer < step.get(spent + units, (np.inf,)):
                        step[spent + units] = offer
            cheapest = step
        price, units = cheapest[LINK + 1]
        if price < best:
            best, chosen = price, [(mask_of(g), u - 1) for g, u in zip(groups, units) if u]
    return chosen


def filed_under(fps: np.ndarray, parts: list[tuple[int, int]]):
    """(part number, values) for each way a fingerprint is filed: its value, and those within the threshold."""
    for number, (mask, threshold) in enumerate(parts):
        bits = [b for b in range(BITS) if mask >> b & 1]
        own = fps & np.uint64(mask)
        for t in range(threshold + 1):
            for flips in combinations(bits, t):
                yield number, own ^ np.uint64(sum(1 << b for b in flips))


def forest(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints under the same key (keys in order)."""
    root = np.arange(len(fps))
    made: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at, d = np.arange(len(fps)), 0
    while len(at):
        d += 1
        at = at[at + d < len(fps)]
        at = at[keys[at] == keys[at + d]]
        hit = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= LINK]
        hit = hit[root[hit] != root[hit + d]]
        for i in hit.tolist():
            a, b = find(i), find(i + d)
            if a != b:
                root[max(a, b)] = min(a, b)
                made.append((i, i + d))
        if len(hit):                                           # flatten, so that the next pass sees what is joined
            while (flat := root[root]).tolist() != root.tolist():
                root = flat
    if not made:
        return fps[:0], fps[:0]
    a, b = np.array(made).T
    return fps[a], fps[b]


def links(nodes: DataFrame) -> DataFrame:
    """``a, b`` that connect all linked fingerprints of ``nodes`` (distinct ``fp``)."""
    total = nodes.count()
    rows = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    parts = plan(np.array([r.fp for r in rows], np.int64).view(np.uint64), total) if rows else []

    def file(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fps), 20_000):
                own = fps[a:a + 20_000]
                for number, values in filed_under(own, parts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), number, np.int32)), pa.array(values.view(np.int64)),
                         pa.array(own.view(np.int64))], names=["part", "value", "fp"])

    filed = nodes.select("fp").mapInArrow(file, "part int, value long, fp long")
    # values that many share are cut into blocks, and each pair of blocks is compared apart
    wide = filed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(
        "part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("cuts"))
    cut = filed.join(wide, ["part", "value"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1))
    placed = cut.withColumn("mine", mine).select("part", "value", "fp", "mine", other.alias("other")).select(
        F.xxhash64("part", "value", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")

    def compare(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def joined(k, f):
            a, b = forest(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0       # the last key may go on
            if whole:
                yield joined(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield joined(keys, fps)

    return placed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` (and columns ``more``) of each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, own id included.
    Null and empty texts share the fingerprint zero and are linked like any
    other; so are repeated rows. A row without an id takes the smallest id of
    its component, null if no row there has one.
    """
    marked = settle(fingerprints(docs, more), "fingerprints")
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # a plain table, so that Spark can split a fingerprint that very many rows share
    answer = settle(rooted.join(least, "root").select("fp", "component_id"), "components-of")
    return marked.join(answer, "fp")


def keep_one(docs: DataFrame, linked=near_duplicates) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, ties by its text's hash.

    ``linked`` finds the groups: rows with ``fp``, alike for copies, and ``component_id``. Only ids and hashes are shuffled to decide; a row repeated with id and text
    stays once.
    """
    hashed = docs.select(*DOCUMENT_COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    seen = linked(hashed, ["text_hash"]).groupBy("component_id", "doc_id", "text_hash").agg(
        F.min("fp").alias("fp"), F.count(F.lit(1)).alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    # a component whose rows all lack an id is told apart by nothing but its rows; each distinct text of it stays
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("none:"), F.col("fp").cast("string")))
    seen = settle(seen.withColumn("grp", group).withColumn("key", order), "near-groups")
    first = settle(seen.groupBy("grp").agg(F.min("key").alias("first")), "near-firsts")
    marked = seen.join(first, "grp").select("doc_id", "text_hash", "times", (F.col("key") == F.col("first")).alias("stays"))
    gone = marked.filter("NOT stays").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    same = (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("text_hash") == F.col("h"))
    left = hashed.join(gone, same, "left_anti")
    again = marked.filter("stays AND times > 1").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    if again.isEmpty():
        return left.select(*DOCUMENT_COLUMNS)
    once = left.join(again, same, "left_anti")
    return once.union(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*DOCUMENT_COLUMNS)


@query("op9_simhash")
def op9(spark, sf):
    found = near_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
