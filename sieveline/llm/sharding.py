"""Sharding by proportional stratified interleaving, in DataFrame functions alone.

Rows of each source are put in a seeded order and numbered; row r of n gets the
fraction (r - u) / n, where u is a seeded number between 0 and 1 of the source,
so that sources of few rows spread as well. Sorted by that fraction, every
stretch of the whole holds each source in its proportion, so cutting the
sequence into equal runs gives shards that match the mixture, with counts at
most one apart.

No ordering runs in one task: the seeded hash of the whole row is uniform, so
its leading bits cut every source, however large, into blocks of about ``block``
rows; ranks are taken inside a block and blocks are offset by the sums of those
before. The same is done again for the fractions, which are uniform as well.
Rows alike in everything are one row with a count until they have their ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sieveline.session import settle

from .common import read
from .registry import query

BLOCK = 2_000


def interleave(docs: DataFrame, shards: int = 24, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one for each row of ``docs``.

    A null source is a stratum of its own; a null text counts 8 bytes and has
    the checksum of the empty text. Repeated rows are placed like any others:
    rows alike in id and text are interchangeable. An empty table gives no rows.
    """
    total = docs.count()
    blocks = max(1, math.ceil(total / max(block, math.isqrt(total))))

    def uniform(*parts):
        """60 bits of a hash of the parts."""
        said = F.concat_ws(":", F.lit(str(seed)), *parts)
        return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    own = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
                      stratum.alias("stratum")).groupBy("doc_id", "size", "text_crc32", "stratum").agg(F.count(F.lit(1)).alias("times"))
    h = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    rows = own.withColumn("h", h).withColumn("block", F.shiftright(F.shiftright("h", 30) * F.lit(blocks), 30))

    counts = rows.groupBy("stratum", "block").agg(F.sum("times").alias("n"))
    of_stratum = W.partitionBy("stratum")
    before = counts.select(
        "stratum", "block", F.sum("n").over(of_stratum).alias("of"),
        (F.sum("n").over(of_stratum.orderBy("block")) - F.col("n")).alias("before"))
    order = ["h", "doc_id", "text_crc32", "size"]
    inside = F.sum("times").over(W.partitionBy("stratum", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    offset = (uniform("stratum") + 1) / F.lit(float(2 ** 60 + 2))
    ranked = (rows.join(before, ["stratum", "block"])
              .withColumn("last", F.col("before") + inside)
              .withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("times") + 1, F.col("last"))))
              .withColumn("fraction", (F.col("rank") - offset) / F.col("of"))
              .withColumn("piece", F.least(F.floor(F.col("fraction") * blocks), F.lit(blocks - 1).cast("long"))))
    ranked = settle(ranked.select("doc_id", "size", "text_crc32", "stratum", "h", "fraction", "piece"), "interleave")

    # one row for each piece: the table of block sums, not of rows
    pieces = ranked.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    upto = pieces.select("piece", (F.sum("n").over(W.orderBy("piece")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("piece").orderBy("fraction", "stratum", *order))
    at = (ranked.join(upto, "piece").withColumn("at", F.col("before") + place - 1)
          .withColumn("shard", F.expr(f"(at * {shards}) div {max(total, 1)}")))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


# a checksum step for each byte: the table entry is eight halvings of the byte
_CRC_STEP = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
SQL = f"""WITH crc_table AS (
  SELECT list(t ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: {_CRC_STEP}) AS t FROM range(256) x(i))),
docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('s' || source, 'null') AS stratum FROM documents),
checked AS (SELECT doc_id, stratum, strlen(text) + 8 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'),
    lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM docs, crc_table),
summed AS (SELECT *, CAST('0x' || md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || text_crc32 || ':' || size)[1:15] AS BIGINT) AS h,
  CAST(CAST('0x' || md5('7:' || stratum)[1:15] AS BIGINT) + 1 AS DOUBLE) / 1152921504606846978.0::DOUBLE AS u FROM checked),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) - u)
  / count(*) OVER (PARTITION BY stratum) AS fraction FROM summed),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id, text_crc32, size) - 1 AS pos,
  count(*) OVER () AS total FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(pos * 24 // total AS INTEGER) AS shard,
  CAST(pos - ((pos * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed"""


@query("op7_sharding", SQL)
def op7(spark, sf):
    return interleave(read(spark, sf, "documents"))
