"""Columns that a table has besides its own, named as the operators name theirs, change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sieveline.llm import (bpe, classifier, decontaminate, filter_audit, language, licenses, near_copies, quality_rules,
                           repeats, sharding, simhash, token_alignment, token_counts)
from sieveline.llm.common import DOCUMENT_COLUMNS

from .conftest import ODD

NAMES = ["th", "z", "size", "spans", "none", "fp", "text_hash", "stratum", "h", "rank", "at", "shard", "held_out", "score",
         "failed", "words", "raw", "component_id", "row", "bucket", "label", "x", "edits", "value", "part", "key", "n", "ids"]
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "A passage of some length that stands in two documents, word for word, and is long enough to be found there. " * 4


@pytest.fixture
def tables(spark, documents):
    docs = documents(*ODD, (20, LONG + "first"), (21, LONG + "second one"))
    bench = spark.createDataFrame([(1, LONG), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, 0, 0), (None, 1, 0), (20, 1, None)],
                                   "doc_id long, quality int, toxic int")
    return docs, bench, labels


OPERATORS = {
    "decontaminate": lambda d, b, q: decontaminate.scan(d, b), "clean": lambda d, b, q: decontaminate.clean(d, b),
    "rules": lambda d, b, q: quality_rules.digest(d), "classify": lambda d, b, q: classifier.classify(d, q),
    "bpe": lambda d, b, q: bpe.encode(d, PATH, size=30), "trees": lambda d, b, q: token_counts.build(d, PATH),
    "licenses": lambda d, b, q: licenses.scan(d), "sharding": lambda d, b, q: sharding.interleave(d, shards=3),
    "repeats": lambda d, b, q: repeats.measure(d), "remove": lambda d, b, q: repeats.remove(d),
    "simhash": lambda d, b, q: simhash.near_duplicates(d), "keep_one": lambda d, b, q: simhash.keep_one(d),
    "language": lambda d, b, q: language.identify(d), "keep": lambda d, b, q: quality_rules.keep(d).select(*DOCUMENT_COLUMNS),
    "near_copies": lambda d, b, q: near_copies.near_copies(d),
    "keep_one_near": lambda d, b, q: simhash.keep_one(d, near_copies.near_copies),
    "align": lambda d, b, q: token_alignment.align(d), "audit": lambda d, b, q: filter_audit.audit(filter_audit.failures(d))}


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_change_nothing(tables, name):
    more = [t.withColumns({n: F.lit("own") for n in NAMES if n not in t.columns}) for t in tables]
    def rows(ts):
        return sorted(map(str, OPERATORS[name](*ts).collect()))
    assert rows(tables) == rows(more)
