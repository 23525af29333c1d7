"""Near copies: SimHash partitions and MinHash bands, decided by the exact Jaccard similarity of word shingles.

Two texts are linked when their sets of ``SHINGLE``-word shingles have a
Jaccard similarity of ``SIMILARITY`` or more. Candidates are found by the
partitions of operator 9: each set has a 64-bit SimHash, filed by the generalised
pigeonhole principle (``simhash.links``), and sets whose fingerprints are joined
by links of 3 or fewer differing bits are candidates. At 0.8 some 10 of 64 bits
differ, up to 17 in one pair of a hundred, and no parts of 64 bits are
selective at that distance. So texts that agree on a band of MinHash values are
candidates too: a pair at 0.8 has no band in common once in 20 million
times. Similarity itself is never estimated: candidates are compared by their sets.

Texts with the same set are one node; nodes that are candidates of each other,
directly or through others, are a family. The sets of a family lie in blocks of bounded
size, each set in one block. Probes, some of the family's nodes, are sent to
its blocks, and a block compares all its sets with all its probes at once, by an
inverted index of their shingles. What a block hands on is a spanning forest of
the links it found. All nodes of a small family are probes. In a large one a few
nodes are, in rounds, until most of it is one component; then every node outside
its largest component is a probe, to the blocks where it has a candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.session import Scratch

from .common import map_texts, utf8
from .components import components
from .simhash import links as fingerprint_links
from .simhash import majority, shingle_hashes

SHINGLE = 5                  # words
SIMILARITY = (4, 5)          # least Jaccard similarity of linked texts, as a fraction
BANDS, BAND = 32, 4          # bands, and MinHash values in each
PROBES = 64                  # probes of a family in a round
ROUNDS = 3                   # rounds before all nodes outside the largest component are probes
HELD = 1_000_000             # shingles of a block, about
MATCHES = 1_000_000          # shingles of probes found in a block that are counted at once

FACTORS = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * BAND), np.int64).view(np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(raw: bytes) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.unique(shingle_hashes(raw, SHINGLE))


def bands(own: np.ndarray) -> np.ndarray:
    """A value for each band of a set's MinHash values."""
    least = np.full(BANDS * BAND, np.uint64(2**64 - 1))
    for a in range(0, len(own), 512):
        mixed = own[a:a + 512, None] * FACTORS[0]
        mixed += FACTORS[1]
        np.minimum(least, mixed.min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, BAND))], np.uint64).view(np.int64)


def marks(docs: DataFrame, more: list[str]) -> DataFrame:
    """``fp`` (a hash of the set, 0 for an empty one), its ``size``, ``sim`` (SimHash, null for an empty one) and ``bands``
    and the packed text of each row."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in more), "fp long, size long, sim long, bands array<bigint>, z binary"])

    def step(batch):
        box = zstandard.ZstdCompressor(level=3)
        fps, sizes, sims, values, packed = [], [], [], [], []
        for raw in utf8(batch.column("text")):
            own = shingles(raw)
            fps.append(xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0)
            sizes.append(len(own))
            sims.append(majority(own) if len(own) else None)
            values.append(bands(own) if len(own) else [])
            packed.append(box.compress(raw))
        return {**{c: batch.column(c) for c in ["doc_id", *more]}, "fp": pa.array(np.array(fps, np.uint64).view(np.int64)),
                "size": pa.array(sizes, pa.int64()), "sim": pa.array(sims, pa.int64()), "bands": pa.array(values, pa.list_(pa.int64())),
                "z": pa.array(packed, pa.binary())}

    return map_texts(docs, ["doc_id", *more, "text"], schema, step)


def as_sets(texts: DataFrame) -> DataFrame:
    """``fp, own``: each node's set, from its packed text."""
    def run(batches):
        box = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array(
                    [shingles(box.decompress(z)).tobytes() for z in part.column("z").to_pylist()], pa.binary())], names=["fp", "own"])

    return texts.select("fp", "z").mapInArrow(run, "fp long, own binary")


class Forest:
    """Components of labels; says which links join two."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def compare(held: list[tuple], probes: list[tuple]) -> list[tuple[int, int]]:
    """Links of ``probes`` with the nodes ``held`` (``fp, root, set`` both) that join different roots: a spanning forest of them."""
    size = np.array([len(s) for _, _, s in held])
    flat = np.concatenate([s for _, _, s in held])
    order = np.argsort(flat, kind="stable")
    owner, flat = np.repeat(np.arange(len(held)), size)[order], flat[order]
    forest, found = Forest(), []
    part, weight = [], 0

    def settle():
        asked = np.concatenate([p[2] for p in part])
        who = np.repeat(np.arange(len(part)), [len(p[2]) for p in part])
        low, high = np.searchsorted(flat, asked), np.searchsorted(flat, asked, "right")
        n = high - low
        at = np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())
        pair, both = np.unique(np.repeat(who, n) * np.int64(len(held)) + owner[at], return_counts=True)
        p, h = pair // len(held), pair % len(held)
        union = np.array([len(x[2]) for x in part])[p] + size[h] - both
        alike = both * SIMILARITY[1] >= SIMILARITY[0] * union
        for i, j in zip(p[alike].tolist(), h[alike].tolist()):
            a, b = part[i], held[j]
            if a[1] != b[1] and forest.join(a[1], b[1]):
                found.append((a[0], b[0]))

    for probe in probes:
        most = len(probe[2]) * len(held)
        if part and weight + most > MATCHES:
            settle()
            part, weight = [], 0
        part.append(probe)
        weight += most
    if part:
        settle()
    return found


def links(held: DataFrame, probes: DataFrame) -> DataFrame:
    """``a, b`` found between the sets of each block (``blk``) and the probes sent there. Both have ``blk, fp, root, own``."""
    def walk(batches):
        at, held_, probes_ = None, [], []

        def done():
            got = compare(held_, probes_) if held_ and probes_ else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for blk, probe, fp, root, own in zip(*(batch.column(c).to_pylist() for c in ("blk", "probe", "fp", "root", "own"))):
                if blk != at:
                    if at is not None:
                        yield done()
                    at, held_, probes_ = blk, [], []
                (probes_ if probe else held_).append((fp, root, np.frombuffer(own, np.uint64)))
        if at is not None:
            yield done()

    both = held.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True)))
    return both.repartition("blk").sortWithinPartitions("blk", "probe").select("blk", "probe", "fp", "root", "own").mapInArrow(
        walk, "a long, b long")


def by_fingerprint(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp, value``: nodes (``fp, sim``) whose SimHashes the partitions of operator 9 join have one value."""
    marked = nodes.filter("sim IS NOT NULL").select("fp", "sim")
    joined = components(fingerprint_links(scratch.settle(marked.select(F.col("sim").alias("fp")).distinct(), "near-simhashes")))
    rooted = marked.join(joined.withColumnRenamed("node", "sim"), "sim", "left")
    return rooted.select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("root", "sim")).alias("value"))


def families(filed: DataFrame) -> DataFrame:
    """``fp, family`` of nodes filed (``value, fp``) under shared values: nodes that values join have one family."""
    least = filed.groupBy("value").agg(F.min("fp").alias("least"))
    return components(filed.join(least, "value").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()).select(
        F.col("node").alias("fp"), F.col("root").alias("family"))


def roots(filed: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``node, root`` of the nodes linked to others. ``filed`` has ``value, fp`` of the values that several nodes share,
    ``sets`` has ``fp, own`` of those nodes."""
    sized = sets.join(families(filed), "fp").withColumn("n", F.octet_length("own") / 8)
    total = F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("nodes")
    of = scratch.settle(sized.groupBy("family").agg(*total).withColumn(
        "cuts", F.when(F.col("nodes") > PROBES, F.ceil(F.col("shingles") / HELD)).cast("long")), "near-families")
    small = of.filter("cuts IS NULL").agg(F.sum("shingles")).first()[0] or 0
    # small families share blocks; a large one has its own
    shared = F.pmod(F.xxhash64("family"), F.lit(int(small) // HELD + 1))
    own = F.xxhash64("family", F.pmod(F.xxhash64("fp"), F.col("cuts")))
    placed = scratch.settle(sized.drop("n").join(of.select("family", "cuts"), "family").withColumn(
        "blk", F.when(F.col("cuts").isNull(), shared).otherwise(own)), "near-placed")
    blocks = placed.filter("cuts IS NOT NULL").select("family", "blk").distinct()
    edges, at, nodes = None, None, placed.withColumn("root", F.col("fp"))
    for turn in range(ROUNDS + 1):
        if turn:
            nodes = placed.filter("cuts IS NOT NULL").join(at.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
                "root", F.coalesce("root", "fp"))
            open_ = nodes.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
            nodes = nodes.join(open_.select("family"), "family", "left_semi")
            before, nodes = state, scratch.settle(nodes, "near-open")
            scratch.drop(before)
        state = nodes
        if nodes.isEmpty():
            break
        if turn < ROUNDS:
            first = F.row_number().over(W.partitionBy("family").orderBy(F.xxhash64("fp", F.lit(turn)), "fp"))
            some = nodes.filter("cuts IS NOT NULL").select("family", "fp", "root", "own", first.alias("nth")).filter(F.col("nth") <= PROBES)
            probes = some.join(blocks, "family").select("blk", "fp", "root", "own")
            if not turn:
                probes = probes.unionByName(nodes.filter("cuts IS NULL").select("blk", "fp", "root", "own"))
        else:
            counts = nodes.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
            main = counts.groupBy("family").agg(F.max(F.struct("n", F.col("root").alias("main"))).alias("m")).select("family", "m.main")
            outside = nodes.join(main, "family").filter("root <> main").select("fp", "root", "own")
            # a probe goes to the blocks that hold a node under one of its values
            there = filed.join(nodes.select("fp", "blk"), "fp").select("value", "blk").distinct()
            sent = filed.join(outside.select("fp"), "fp", "left_semi").join(there, "value").select("fp", "blk").distinct()
            probes = outside.join(sent, "fp")
        found = scratch.settle(links(nodes.select("blk", "fp", "root", "own"), probes), "near-links")
        edges = found if edges is None else edges.union(found)
        at = components(edges)
    return at


def near_copies(docs: DataFrame, more: list[str] | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` (and ``more``) of each row: the smallest id its text is linked to, its own included.

    Null, empty and blank texts are alike. A row without an id takes the
    smallest id of its component, null if no row there has one. An empty table
    gives no rows; repeated rows are rows of one component.
    """
    more = more or []
    with Scratch() as scratch:
        marked = scratch.settle(marks(docs, more), "near-marks")
        nodes = scratch.settle(marked.groupBy("fp").agg(
            F.min("doc_id").alias("least"), F.any_value("sim").alias("sim"), F.any_value("bands").alias("bands")), "near-nodes")
        every = nodes.select("fp", F.explode("bands").alias("value")).union(by_fingerprint(nodes, scratch))
        shared = every.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("value")
        filed = scratch.settle(every.join(shared, "value", "left_semi"), "near-filed")
        wanted = filed.select("fp").distinct()
        packed = marked.select("fp", "z").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.any_value("z").alias("z"))
        at = roots(filed, scratch.settle(as_sets(packed), "near-sets"), scratch)
        if at is None:
            rooted = nodes.withColumn("root", F.col("fp"))
        else:
            rooted = nodes.join(at.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        rooted = rooted.select("fp", "root", "least")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        # a plain table, so that Spark can split a set that very many rows share
        answer = scratch.settle(rooted.join(least, "root").select("fp", "component_id"), "near-components")
        return scratch.keep(marked.select("doc_id", *more, "fp").join(answer, "fp"))
