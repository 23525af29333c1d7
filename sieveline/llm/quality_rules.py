"""Quality rules as a bitmask ledger.

Every rule is evaluated once over the whole text; the ledger keeps what was
measured and one bit for each rule that failed. Policies are versioned masks
over those bits: applying one, or finding what each rule alone costs under it,
reads the ledger and never the texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, read
from .common import texts as text_batches
from .registry import query

# name -> SQL over the measurements, true where the document fails. The place
# in this list is the rule's bit and never changes; new rules go at the end.
RULES = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "n_letters >= 20 AND 10 * n_upper > 5 * n_letters"),
    ("exclaiming", "10 * n_exclaims > 3 * n_words"),
    ("few_letters", "10 * n_letters < 4 * word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]

# version -> the rules a kept document must pass
POLICIES = {
    1: BASE,
    2: BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["shouting"] | BIT["exclaiming"],
    3: (1 << len(RULES)) - 1,
}
CURRENT = 3

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper",
            "n_exclaims"]
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that the sequence holds twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    bits = int(ids.max()).bit_length()
    key = ids[:n].astype(np.int64)
    for k in range(1, width):
        if (k + 1) * bits > 62:                                # rank what is packed so far, then go on
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            if int(key.max()).bit_length() + bits > 62:        # pragma: no cover - over 2**31 distinct words
                raise ValueError("text too long")
        key = (key << bits) | ids[k:n + k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    edge = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The measurements of a text; null has no words."""
    text = text or ""
    words = WORD.findall(text)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    caseless = "".join(words)
    letters = caseless if caseless.isalpha() else "".join(filter(str.isalpha, caseless))
    upper = 0 if letters.islower() else sum(map(str.isupper, letters))
    return (len(words), len(caseless), len(SYMBOLS.findall(text)), len(lines), len(lines) - len(set(lines)),
            repeated_words(ids) if len(words) > len(seen) else 0, len(letters), upper, text.count("!"))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, each measurement and ``failed``, the bits of the rules that failed.

    One row for each row of ``docs``, repeated ids included; null and empty
    texts measure zero throughout (and fail ``too_few_words``).
    """
    def step(batch):
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"),
                **{m: pa.array([r[i] for r in rows], pa.int64()) for i, m in enumerate(MEASURES)}}

    made = map_texts(docs, ["doc_id", "text"], SCHEMA, step)
    bits = " | ".join(f"IF({rule}, {BIT[name]}L, 0L)" for name, rule in RULES)
    return made.withColumn("failed", F.expr(bits))


def passes(version: int = CURRENT, failed: str = "failed"):
    """True where no rule of that version of the policy failed."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablation(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: how many fail it, and how many would be kept but for it.

    One pass over the ledger: documents are counted by their failure bits
    first, and the few distinct masks are then compared with each rule.
    """
    mask = POLICIES[version]
    masks = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit"))
                      for n, _ in RULES if BIT[n] & mask])
    one = masks.withColumn("r", F.explode(rules))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or("bits").alias("seen_with"))


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` as they are with ``_failed``, the ledger's bits of each row, measured where the text lies."""
    own = docs.schema
    schema = T.StructType([*own.fields, *(T.StructField(f"_m_{m}", T.LongType()) for m in MEASURES)])

    def run(batches):
        for batch in text_batches(batches):
            rows = [measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES)))],
                                             names=schema.names)

    bits = " | ".join(f"IF({rule}, {BIT[name]}L, 0L)" for name, rule in RULES)
    bits = re.sub(rf"\b({'|'.join(MEASURES)})\b", r"_m_\1", bits)
    return docs.mapInArrow(run, schema).select(*own.names, F.expr(bits).alias("_failed"))


def keep(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The documents that no rule of the policy fails, all columns as they were.

    The policy reads the ledger's bits, which are measured beside the text:
    nothing is joined or shuffled. Null, empty and blank texts have too few
    words and go; repeated rows are each judged; an empty table stays one.
    """
    return marked(docs).filter(passes(version, "_failed")).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        passes().alias("kept"), F.col("failed").alias("failed_bits"))


_MEASURED = r"""
  words AS (SELECT rowid AS r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM (
    SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS text FROM documents)),
  windows AS (SELECT r, i, w[i:i + 4] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
  twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
  repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
  lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (
    SELECT r, unnest(string_split(text, chr(10))) AS l FROM words)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
  measured AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '\pL')) AS n_letters,
    len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_exclaims
    FROM words LEFT JOIN lines l USING (r) LEFT JOIN repeats p USING (r))"""
_BITS = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)

SQL = f"""WITH {_MEASURED},
  bits AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed_bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {BASE} <> 0 AS base_failed,
  failed_bits & {POLICIES[CURRENT]} = 0 AS kept, failed_bits FROM bits"""


@query("op2_quality_rules", SQL)
def op2(spark, sf):
    return digest(read(spark, sf, "documents"))


ABLATION_SQL = f"""WITH {_MEASURED},
  bits AS (SELECT CAST({_BITS} AS BIGINT) & {POLICIES[CURRENT]} AS bits FROM measured),
  rules AS (SELECT unnest([{", ".join(f"'{n}'" for n, _ in RULES if BIT[n] & POLICIES[CURRENT])}]) AS rule,
    unnest([{", ".join(str(BIT[n]) for n, _ in RULES if BIT[n] & POLICIES[CURRENT])}]) AS bit)
SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only, bit_or(bits) AS seen_with
FROM bits, rules GROUP BY rule"""


@query("quality_ablation", ABLATION_SQL)
def quality_ablation(spark, sf):
    """What each rule of the current policy fails, and fails alone, from the ledger of operator 2."""
    return ablation(ledger(read(spark, sf, "documents")))
