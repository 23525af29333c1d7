import re
from collections import Counter

from sieveline.llm import quality_rules as Q

from .conftest import ODD

TEXTS = ["a b c d e f g h i j k", "one two three four five six seven eight nine ten eleven. " * 3, "THE!! BIG!! SHOUT!! " * 9,
         "### *** plain $$$ words %%% here &&& for | all | of | us", "line\nline\nline\nother words here\nline\n" + "x y z " * 9,
         "Eine ganz gewöhnliche Zeile mit Wörtern, die sich nicht wiederholen, und noch einige dazu für die Länge."]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def rows():
    return [*ODD, *((100 + i, t) for i, t in enumerate(TEXTS))]


def test_measures_match_brute_force(spark, documents):
    got = Q.digest(documents(*rows())).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((d, *brute(t)) for d, t in rows()), key=str)
    assert all(not (r.kept and r.base_failed) for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert 105 in kept and not kept & {1, 2, 3, 101, 102, 103, 104}
    assert Q.digest(documents().limit(0)).collect() == []


def test_keeping_agrees_with_the_ledger(spark, documents):
    docs = documents(*rows())
    want = sorted(r.doc_id for r in Q.ledger(docs).filter(Q.passes()).collect())
    assert sorted(r.doc_id for r in Q.keep(docs).collect()) == want
    assert Q.keep(docs).columns == docs.columns


def test_ablation_matches_a_recount(spark, documents):
    entries = Q.ledger(documents(*rows())).cache()
    bits = [r.failed for r in entries.collect()]
    for version, mask in Q.POLICIES.items():
        for r in Q.ablation(entries, version).collect():
            bit = Q.BIT[r.rule]
            assert r.n_failed == sum(1 for b in bits if b & bit)
            assert r.n_only == sum(1 for b in bits if b & mask == bit)


def test_long_sequences_pack_exactly():
    import numpy as np
    ids = np.arange(70_000) % 66_000
    assert Q.repeated_words(ids) == 8_000
