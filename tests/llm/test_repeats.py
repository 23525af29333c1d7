import hashlib
import random
from collections import Counter

from sieveline.llm import repeats as R

from .conftest import ODD


def brute(rows, length=R.LENGTH):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i:i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed=1):
    r = random.Random(seed)
    def prose(k): return "".join(r.choice("abcdefghij éü\n") for _ in range(k))
    passages = [prose(k) for k in (150, 199, 200, 201, 230, 400, 900)]
    rows = []
    for i in range(60):
        parts = [prose(r.choice([0, 3, 60, 500]))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(0, 60)
            parts += [p[a:] if r.random() < 0.5 else p[:len(p) - a], prose(r.choice([0, 1, 40, 300]))]
        rows.append((1000 + i, "".join(parts)))
    period = ("xyz" * 200, "xyz" * 90 + "!", "q" * 199, "q" * 205)
    near = prose(600)
    edits = [near[:k] + "#" + near[k + 1:] for k in (30, 210, 300, 301, 590)]
    return rows + [(500 + i, t) for i, t in enumerate([*period, near, *edits, near])] + ODD


def test_matches_brute_force(spark, documents, monkeypatch):
    rows = made()
    want = brute(rows)
    assert sum(w[2] > 0 for w in want) > 20
    for wide, piece in ((R.WIDE, R.PIECE), (1, 777)):          # sorted; then counted, with long texts in pieces
        monkeypatch.setattr(R, "WIDE", wide)
        monkeypatch.setattr(R, "PIECE", piece)
        got = R.measure(documents(*rows)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert R.measure(documents().limit(0)).collect() == []


def test_spans_of_copies_are_listed_once(spark, documents):
    r = random.Random(3)
    text = "".join(r.choice("abcdefghij ") for _ in range(900))
    copies = [(i, text) for i in range(40)]
    got = R.spans(documents(*copies)).collect()
    assert len(got) == 1 and 0 < len(got[0].spans) == len({(x.a, x.b) for x in got[0].spans}) <= 900
    assert sorted((tuple(x)[:5] for x in R.measure(documents(*copies)).collect()), key=str) == brute(copies)


def test_removal_keeps_rows_and_whole_characters(spark, documents):
    rows = made(4)
    got = R.remove(documents(*rows)).collect()
    assert len(got) == len(rows)
    want = {b[0]: b for b in brute(rows)}
    before = dict(rows)
    for r in got:
        if r.doc_id not in (8, None) and not want[r.doc_id][2]:
            assert r.text == before[r.doc_id]
        assert r.text is None or len(r.text) == r.n_chars


def test_intervals_of_a_suffix_array():
    text = "mississippi"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = R.common_prefix([text[i:].encode() for i in order]).tolist()
    got = {(d, a, b) for d, a, b in R.intervals(lcp)}
    want = set()
    for a in range(len(lcp)):
        for b in range(a + 1, len(lcp)):
            d = min(lcp[a + 1:b + 1])
            if d and lcp[a] < d and (b + 1 == len(lcp) or lcp[b + 1] < d):
                want.add((d, a, b))
    assert got == want
