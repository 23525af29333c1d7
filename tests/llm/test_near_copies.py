import random

import corpus_pipeline
from sieveline.llm import near_copies as N

from .conftest import ODD

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_set(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_components(rows):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if brute_similar(sets[i], sets[j]) and root[i] != root[j]:
                gone = root[i]
                root = [root[j] if r == gone else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(r) for r in root]


def made():
    r = random.Random(7)
    rows = []
    for i in range(30):
        w = [r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(30)) for _ in range(120)]
        rows.append((100 + i, " ".join(w)))
        for k in range(r.choice([0, 1, 2, 6])):                # chains, on both sides of the least similarity
            w = list(w)
            for at in r.sample(range(120), r.randrange(1, 5)):
                w[at] = f"changed{i}x{k}"
            rows.append((1000 + 10 * i + k, " ".join(w)))
    w = [f"w{k}" for k in range(104)]                          # 100 shingles
    exact = [(5000, " ".join(w)), (5001, " ".join(w[:84])), (5002, " ".join(w[:83] + [])), (5003, " ".join(w[8:] + ["z"] * 3))]
    return rows + exact + ODD + rows[:2]


def test_matches_brute_force_jaccard(spark, documents, monkeypatch):
    rows = made()
    want = sorted(zip([d for d, _ in rows], brute_components(rows)), key=str)
    # as it is; families of many blocks, in rounds; every node outside the largest component a probe at once
    for rounds, probes, held in ((N.ROUNDS, N.PROBES, N.HELD), (2, 2, 150), (0, 2, 300)):
        monkeypatch.setattr(N, "ROUNDS", rounds)
        monkeypatch.setattr(N, "PROBES", probes)
        monkeypatch.setattr(N, "HELD", held)
        got = N.near_copies(documents(*rows)).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert N.near_copies(documents().limit(0)).collect() == []


def test_a_block_hands_on_a_forest():
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(80):
        w = list(base)
        w[r.randrange(60)] = f"x{r.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    nodes = [(i, i, N.shingles(t.encode())) for i, t in enumerate(texts)]
    found = N.compare(nodes, nodes)
    sets = [brute_set(t) for t in texts]
    links = [(i, j) for i in range(80) for j in range(i) if brute_similar(sets[i], sets[j])]
    assert len(links) > 400 and len(found) <= 79 and all((max(p), min(p)) in links for p in found)
    a, b = N.Forest(), N.Forest()
    for x, y in links:
        a.join(x, y)
    for x, y in found:
        b.join(x, y)
    assert [a.find(i) for i in range(80)] == [b.find(i) for i in range(80)]


def test_the_stage_leaves_no_linked_pair(spark, documents):
    rows = made()
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, documents(*rows), "").collect()]
    sets = [brute_set(t) for _, t in kept]
    assert not any(brute_similar(sets[i], sets[j]) for i in range(len(kept)) for j in range(i))
    comp = dict(zip(rows, brute_components(rows)))
    assert {comp[k] for k in kept} == set(comp.values()) and len(kept) == len(set(comp.values()))


def test_fingerprint_partitions_find_candidates(spark, documents, monkeypatch):
    """Without a band in common, texts whose SimHashes are within 3 bits are still found, and compared by their sets."""
    monkeypatch.setattr(N, "bands", lambda own: [])
    r = random.Random(1)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), (3, " ".join(["start", *base[1:]])),
            (4, " ".join(base[::-1])), (5, " ".join(base).upper()), (6, None), (7, "")]
    sims = [N.majority(N.shingles(t.encode())) for _, t in rows[:4]]
    assert all((sims[0] ^ s) % 2 ** 64 and ((sims[0] ^ s) % 2 ** 64).bit_count() <= 3 for s in sims[1:3])
    got = {x.doc_id: x.component_id for x in N.near_copies(documents(*rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 6}
