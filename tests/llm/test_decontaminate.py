import hashlib
import random
import re

import numpy as np

from sieveline.llm import decontaminate as D

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, w[k:k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    if i is not None:
                        names.add(str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed=3, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["Ünï", "漢"]
    def text(k): return r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(k))
    items = [(i, text(r.choice([3, 8, 10, 14, 30]))) for i in range(20)] + [(5, text(12)), (None, text(11)), (77, None), (78, "!")]
    docs = [(i, text(r.choice([0, 5, 40, 90])) + " " + r.choice(items[:22])[1] + " zz " + text(5)) for i in range(n)]
    return docs + [docs[0], docs[0]] + ODD, items


def test_matches_brute_force(spark, documents, monkeypatch):
    docs, items = made()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard, block in ((1 << 20, 1 << 24), (200, 60)):       # one shard and block; many of each
        monkeypatch.setattr(D, "SHARD_WORDS", shard)
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        got = D.scan(documents(*docs), bench).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == brute(docs, items)
    assert D.scan(documents().limit(0), bench).collect() == []
    assert not any(r.contaminated for r in D.scan(documents(*docs), bench.limit(0)).collect())


def test_cleaned_texts_hold_no_window(spark, documents):
    docs, items = made(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = [(r.doc_id, r.text) for r in D.clean(documents(*docs), bench).collect()]
    assert len(left) == len(docs)
    assert all(not b[-1] for b in brute(left, items))
    dirty = {b[0] for b in brute(docs, items) if b[-1]}
    before = {d: t for d, t in docs}
    assert all(t == before[d] for d, t in left if d not in dirty)


def test_suffix_array_search_and_location():
    r = np.random.default_rng(2)
    for n, sigma in ((50, 2), (400, 3), (300, 40)):
        s = np.concatenate([r.integers(1, sigma + 1, n), r.integers(1, 3, n), np.ones(90, int), [0]]).astype(np.int64)
        order = D.suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        index = D.FMIndex(s, sigma + 2)
        assert sorted(index.locate(np.arange(len(s)))) == list(range(len(s)))
        win = np.array([[0, 1, 2], [1, 1, 1], [0, 0, 1]])
        low, high = index.search(win)
        for w, a, b in zip(win, low, high):
            w = w[w > 0].tolist()
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [
                i for i in range(len(s)) if s[i:i + len(w)].tolist() == w]
