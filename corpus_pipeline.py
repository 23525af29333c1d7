"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns documents; the last
returns their tokens. ``run`` writes each stage's result to the shared folder
and reads it back, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import bpe, decontaminate, near_copies, quality_rules, repeats, simhash
from sieveline.llm.common import DOCUMENT_COLUMNS, read
from sieveline.llm.queries import ORACLES, QUERIES
from sieveline.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rules. Null and empty texts have too few words and go."""
    return quality_rules.keep(docs.select(*DOCUMENT_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 and more.

    The smallest id stays, ties by the text's hash; texts without words are one group.
    """
    return simhash.keep_one(docs, near_copies.near_copies)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that stand more than once."""
    return repeats.remove(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; a null text stays null, and all stay where the benchmark is empty."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of the ids and of what they decode to."""
    return bpe.encode(docs, bpe.vocabulary())


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("suffix_dedup", repeated_text),
          ("decontamination", benchmark_text), ("bpe", tokens)]

# fingerprints, suffix sorting and merges have no form in SQL: the stages are
# tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


QUERIES["pipeline"] = run
if ORACLE_SQL:
    ORACLES["pipeline"] = ORACLE_SQL
