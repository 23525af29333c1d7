import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import bpe
from sieveline.llm import token_counts as C

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)
COUNTER = C.Counter(bpe.load(PATH))
BITS = ["the", " quick", "  ", "\n\n ", "'", "s ", "'re", "<|end", "oftext|>", "<|endoftext|>", "é", "12", "!?", " ", "x"]


def n(text):
    return len(OWN.encode(text, add_special_tokens=False).ids)


def state(text):
    words = COUNTER.split(text)
    chars, tokens = C.segments(words, COUNTER.counts(words))
    return text, chars, tokens, C.tree(tokens)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_edited_counts_match_a_full_count(seed):
    r = random.Random(seed)
    keep, C.SEGMENT = C.SEGMENT, r.choice([4, 16, 64])
    try:
        s = state("".join(r.choice(BITS) for _ in range(r.choice([0, 5, 80, 400]))))
        for _ in range(4):
            a = r.randrange(len(s[0]) + 1)
            b = min(len(s[0]), a + r.choice([0, 0, 1, 7, 60]))
            new = "".join(r.choice(BITS) for _ in range(r.choice([0, 1, 3, 20])))
            want = s[0][:a] + new + s[0][b:]
            *s, _ = C.edit(COUNTER, *s, a, b, new)
            assert s[0] == want and sum(s[1]) == len(want)
            assert C.total(s[3]) == sum(s[2]) == n(want)
            assert s[3] == C.tree(s[2])
    finally:
        C.SEGMENT = keep


def test_only_the_neighbourhood_is_encoded():
    s = state("some plain words in a row. " * 2000)
    *after, encoded = C.edit(COUNTER, *s, 30_000, 30_004, "other")
    assert encoded < 6 * C.SEGMENT and C.total(after[3]) == n(after[0])


def test_table_of_edits(spark, documents):
    docs = documents(*ODD)
    edits = spark.createDataFrame([(7, 2, 5, 9, "zz"), (7, 1, 0, 3, None), (4, 1, 99, 120, " end"), (2, 1, 0, 0, "new")],
                                  "doc_id long, seq int, start int, end int, text string")
    got = C.apply_edits(C.with_edits(C.build(docs, PATH), edits), PATH).collect()
    assert len(got) == len(ODD)
    text = {r.doc_id: r.text for r in got}
    assert text[4] == "word end" and text[2] == "new"
    seven = ODD[6][1][3:]
    assert text[7] == seven[:5] + "zz" + seven[9:]
    for r in got:
        assert r.n_tokens == n(r.text)
    assert C.build(documents().limit(0), PATH).collect() == []
    trees = C.build(docs.withColumn("edits", F.lit(None).cast(C.EDIT)), PATH, "edits")
    assert all(r.n_tokens == r.n_tokens_before and r.n_encoded == 0 for r in C.apply_edits(trees, PATH).collect())
