import numpy as np

from sieveline.llm import language as L
from sieveline.llm.common import learn_fold

from .conftest import ODD

EN = "the house and the garden are near the old river where they walked "
DE = "das haus und der garten liegen nahe dem alten fluss wohin sie gingen "


def test_learns_predicts_and_finds_mixtures(spark, documents):
    rows = [(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, EN * 2 + DE * 2, None), (101, EN, "xx")]
    held = learn_fold(3, 1)
    df = documents(*rows, *((d, t) for d, t in ODD))
    got = {r.doc_id: r for r in L.identify(df, held).collect()}
    assert {got[i].lang_pred for i in range(12, 40, 2)} == {"de"} and {got[i].lang_pred for i in range(13, 40, 2)} == {"en"}
    assert {k for k, v in got[100].shares.items() if v > 0.2} == {"de", "en"}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.identify(documents().limit(0)).collect() == []
    unlabelled = L.identify(documents((1, "abc"), (2, None))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_counts_match_brute_force():
    texts = ["Ab c", "", "x1é", "İi ΑΣ"]
    key, n = L.grams(texts)
    got = {(int(k) >> L.BITS): 0 for k in key}
    for k, c in zip(key, n):
        got[int(k) >> L.BITS] += int(c)
    for i, t in enumerate(texts):
        flat = "".join(c if c.isalpha() or (c > "\x7f" and L.LETTER.match(c)) else " " for c in f" {t.lower()} ")
        want = 0
        for size in L.SIZES:
            for j in range(len(flat) - size + 1):
                g = flat[j:j + size]
                want += (g[0] != " " or g[-1] != " ") and " " not in g[1:-1]
        assert got.get(i, 0) == want


def test_em_matches_one_document_at_a_time():
    rng = np.random.default_rng(1)
    like, n = rng.random((3, 50)).astype(np.float32), rng.integers(1, 4, 50)
    start = np.array([0, 20])
    share, value = L.mixture(like, n, start, np.ones((3, 2)))
    for d, (a, b) in enumerate([(0, 20), (20, 50)]):
        s = np.ones(3) / 3
        for _ in range(L.ROUNDS):
            part = like[:, a:b] * s[:, None]
            s = (part / part.sum(0) * n[a:b]).sum(1) / n[a:b].sum()
        assert np.allclose(share[:, d], s, atol=1e-4)
        assert np.isclose(value[d], (np.log((like[:, a:b] * s[:, None]).sum(0)) * n[a:b]).sum(), rtol=1e-4)


def test_long_texts_count_the_same(monkeypatch):
    import random
    r = random.Random(2)
    texts = ["".join(r.choice("abcÉÜß漢 .,\u03a3\u0130\n") for _ in range(n)) for n in (0, 40, 500, 3, 2000, 150)] + ["x" * 700]
    want = [x.tolist() for x in L.grams(texts)]
    for size in (7, 64, 300):
        monkeypatch.setattr(L, "LONG", size)
        assert [x.tolist() for x in L.grams(texts)] == want
