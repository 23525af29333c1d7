import random
import re

import numpy as np
import xxhash

from sieveline.llm import simhash as S
from sieveline.llm.components import components

from .conftest import ODD

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, link=S.LINK):
    root = list(range(len(ids)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= link:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def made():
    r = random.Random(5)
    rows = []
    for i in range(40):
        w = [r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(30)) for _ in range(80)]
        rows.append((100 + i, " ".join(w)))
        for k in range(r.choice([0, 0, 1, 4])):
            w = list(w)
            w[r.randrange(80)] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(w)))
    return rows + ODD + rows[:2]


def test_matches_brute_force(spark, documents, monkeypatch):
    rows = made()
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], fps, brute_components([d for d, _ in rows], fps)), key=str)
    for block in (S.BLOCK, 3):                                 # blocks so small that shared values are cut
        monkeypatch.setattr(S, "BLOCK", block)
        got = S.near_duplicates(documents(*rows)).collect()
        assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert S.near_duplicates(documents().limit(0)).collect() == []


def test_one_document_of_each_group_stays(spark, documents):
    rows = made()
    comp = dict(zip(rows, brute_components([d for d, _ in rows], [brute_fp(t) for _, t in rows])))
    kept = [(r.doc_id, r.text) for r in S.keep_one(documents(*rows)).collect()]
    assert len(kept) == len(set(kept)) == len(set(comp.values()))
    assert all(comp[k] == k[0] for k in kept if comp[k] is not None)


def test_plans_cover_every_pair_within_the_limit():
    rng = np.random.default_rng(0)
    skewed = rng.integers(0, 2**63, 300, np.int64).view(np.uint64) & np.uint64(0x0F0FFFFFFFFFFFF0)
    for total in (1000, 10**7, 10**11):
        parts = S.plan(skewed, total)
        assert sum(t + 1 for _, t in parts) == S.LINK + 1
        masks = [m for m, _ in parts]
        assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
        for _ in range(200):
            flips = rng.choice(64, S.LINK, replace=False)
            diff = sum(1 << int(b) for b in flips)
            assert any(bin(diff & m).count("1") <= t for m, t in parts)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
