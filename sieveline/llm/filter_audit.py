"""Filter interaction audit: what each filter removes under every order of the filters.

A document fails a set of filters, its mask. Under an order, the first filter of
the order that the mask holds removes it. Orders are numbered by their Lehmer
rank, so all orders that begin alike are an interval of ranks, and what a mask
loses at a step covers a few such intervals. Documents are counted by mask
first; each count is then added at the start of its intervals and taken off at
their ends, and one running sum over the ranks gives every order's figures.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, read, utf8
from .registry import query

UPPER = bytes(range(0x41, 0x5B))
FOLLOWING = bytes(range(0x80, 0xC0))         # bytes of a character after its first
SIGNS = re.compile(rb"[#$%&*|]")

# The filters' letters; the place of a letter is its bit. The last one compares
# documents with each other, the others read one text.
FILTERS = "ABCDE"
SAME = FILTERS.index("E")


def failed(raw: bytes) -> int:
    """The bits of the filters that a text fails by itself."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    points = len(raw.translate(None, FOLLOWING))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * points) << 2
            | (SIGNS.search(raw) is not None) << 3)


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of each row of ``docs``.

    Null is the empty text and a null source the empty part. A text that a
    smaller id has too fails ``E``; rows that share the smallest id all pass it,
    and a row without an id neither fails it nor makes others fail. Texts are
    read once; their digests alone are shuffled, and a text that very many rows
    share meets its smallest id under a key that holds the row's own id as well.
    """
    def step(batch):
        raw = utf8(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "part": batch.column("source").fill_null(""),
                "digest": pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
                "mask": pa.array([failed(x) for x in raw], pa.int32())}

    own = map_texts(docs, ["doc_id", "text", "source"], "doc_id long, part string, digest binary, mask int", step)
    least = own.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("least").isNull()
    return own.join(least, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 1 << SAME).otherwise(0)).alias("mask"))


def intervals(mask: int, n: int) -> list[tuple[int, int, int]]:
    """(step, first rank, end rank) of the orders of ``n`` filters in which ``mask`` is removed at that step."""
    found = []

    def walk(left: list[int], step: int, rank: int) -> None:
        size = factorial(len(left) - 1)
        for k, f in enumerate(left):                       # the k-th smallest filter left: Lehmer digit k
            at = rank + k * size
            if mask >> f & 1:
                found.append((step, at, at + size))
            elif len(left) > 1:
                walk(left[:k] + left[k + 1:], step + 1, at)

    walk(list(range(n)), 1, 0)
    return found


def events(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, change) where an interval of a mask starts or ends; ends that meet a start cancel."""
    change: dict[tuple[int, int, int], int] = {}
    for mask in range(1 << n):
        for step, a, b in intervals(mask, n):
            for rank, by in ((a, 1), (b, -1)):
                change[mask, step, rank] = change.get((mask, step, rank), 0) + by
    return [(*k, v) for k, v in sorted(change.items()) if v and k[2] < factorial(n)]


def audit(rows: DataFrame, letters: str = FILTERS, lost: list[str] | None = None) -> DataFrame:
    """Figures of every part, order of the filters and step.

    ``rows`` has ``part``, ``mask`` (bits of the filters that a row fails, in
    the order of ``letters``, which are sorted) and boolean columns ``lost`` whose
    true rows are counted where they are removed, as ``<name>_lost``. All figures
    are zero-filled; a table without rows has no parts. Whatever the number of
    rows, a part is 2 ** n counts after the first aggregation.
    """
    lost, n = lost or [], len(letters)
    spark = rows.sparkSession
    counts = rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in lost])

    def has(f):
        return F.col("mask").bitwiseAND(F.lit(1 << f)) != 0

    sums = counts.groupBy("part").agg(
        F.sum("n").alias("all"),
        F.array(*[F.sum(F.when(has(f), F.col("n")).otherwise(0)) for f in range(n)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(n)]).alias("only"))
    changes = spark.createDataFrame(events(n), "mask int, step int, rank int, change int")
    moved = counts.join(F.broadcast(changes), "mask").groupBy("part", "step", "rank").agg(       # as many rows as the filters give
        *[F.sum(F.col(c) * F.col("change")).alias(c) for c in ["n", *lost]])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    grid = (sums.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))))
    upto = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = grid.join(moved, ["part", "step", "rank"], "left").select(
        "part", "step", "rank", "all", "fails", "only",
        *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ["n", *lost]])
    order = F.element_at(orders, F.col("rank") + 1)
    filt = F.instr(F.lit(letters), F.substring(order, F.col("step"), F.lit(1)))
    named = summed.withColumn("filter_order", order).withColumn("filt", filt)
    so_far = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    fails = F.element_at("fails", F.col("filt"))
    return named.select(
        "part", "filter_order", "step",
        (F.col("all") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (fails - F.col("n")).alias("redundant"), F.element_at("only", F.col("filt")).alias("unique_fails"),
        *[F.col(c).alias(f"{c}_lost") for c in lost],
        F.sum("n").over(W.partitionBy("part", "filt")).alias("shapley"))


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with ``good`` and ``toxic``: whether any label row of the id says so. Ids without labels, and no id, say neither."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return masks.join(said, "doc_id", "left")


SQL = r"""WITH
  docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  firsts AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
  said AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
  fails AS (SELECT d.part, d.doc_id, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
     'C': 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 2 * length(d.t), 'D': regexp_matches(d.t, '[#$%&*|]'),
     'E': coalesce(d.doc_id > f.least, false)} AS x
    FROM docs d JOIN firsts f USING (t) LEFT JOIN said s ON s.doc_id = d.doc_id),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
  orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
  masks AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, x),
  steps AS (SELECT m.*, o.filter_order, s.step, substr(o.filter_order, s.step, 1) AS l,
      list_transform(range(1, s.step), lambda i: CASE substr(o.filter_order, i, 1) WHEN 'A' THEN m.x.A WHEN 'B' THEN m.x.B
        WHEN 'C' THEN m.x.C WHEN 'D' THEN m.x.D ELSE m.x.E END) AS before
    FROM masks m, orders o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) s),
  judged AS (SELECT *, CASE l WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END AS own,
    list_contains(before, true) AS gone, CAST(x.A AS INT) + CAST(x.B AS INT) + CAST(x.C AS INT) + CAST(x.D AS INT) + CAST(x.E AS INT) AS many
    FROM steps),
  summed AS (SELECT part, filter_order, step, l,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT own), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND own), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND own), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (own AND many = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT gone AND own), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (NOT gone AND own), 0) AS BIGINT) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM summed"""


@query("op11_filter_audit", SQL)
def op11(spark, sf):
    masks = labelled(failures(read(spark, sf, "documents")), read(spark, sf, "labels"))
    return audit(masks, lost=["good", "toxic"])
