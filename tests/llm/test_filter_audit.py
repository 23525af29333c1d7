import random
from collections import Counter
from itertools import permutations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import filter_audit as A

from .conftest import ODD


def brute(rows, letters, lost):
    """Every order applied to every row: {(part, order, step): figures}."""
    made = {}
    for part in {r["part"] for r in rows}:
        own = [r for r in rows if r["part"] == part]
        total = Counter()
        for order in map("".join, permutations(letters)):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                f = letters.index(letter)
                fails = [r for r in left if r["mask"] >> f & 1]
                left = [r for r in left if not r["mask"] >> f & 1]
                total[letter] += len(fails)
                made[part, order, step] = [len(left), len(fails), sum(r["mask"] >> f & 1 for r in gone),
                                           sum(r["mask"] == 1 << f for r in own), *[sum(bool(r[c]) for r in fails) for c in lost]]
                gone = gone + fails
        for (p, order, step), v in made.items():
            if p == part:
                v.append(total[order[step - 1]])
    return made


def rows_of(df, lost):
    names = ["kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in lost], "shapley"]
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


@given(st.integers(1, 5), st.data())
def test_intervals_are_the_orders_of_a_step(n, data):
    mask = data.draw(st.integers(0, 2 ** n - 1))
    want = {}
    for rank, order in enumerate(permutations(range(n))):
        step = next((s for s, f in enumerate(order, 1) if mask >> f & 1), None)
        want[rank] = step
    got = {r: step for step, a, b in A.intervals(mask, n) for r in range(a, b)}
    assert got == {r: s for r, s in want.items() if s}


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    for letters in ("ABCDE", "PQR", "Z"):
        rows = [{"part": rng.choice(["", "web", "hot", "hot"]), "mask": rng.randrange(2 ** len(letters)),
                 "good": rng.choice([True, False, None]), "toxic": rng.random() < 0.2} for _ in range(200)]
        df = spark.createDataFrame([tuple(r.values()) for r in rows], "part string, mask int, good boolean, toxic boolean")
        assert rows_of(A.audit(df, letters, ["good", "toxic"]), ["good", "toxic"]) == brute(rows, letters, ["good", "toxic"])
        assert rows_of(A.audit(df, letters), []) == brute(rows, letters, [])


def plain_mask(text, doc_id, others):
    t = text or ""
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
    return ((len(w) < 200) | (100 * len(set(w)) < 50 * len(w)) << 1 | (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) << 2
            | any(c in "#$%&*|" for c in t) << 3
            | (doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x in others)) << 4)


TEXTS = [*ODD, (30, "SHOUT $ loud"), (31, "SHOUT $ loud"), (-5, "SHOUT $ loud"), (32, " ".join(map(str, range(300)))),
         (33, "long " * 400_000), (34, None), (34, None), (35, "É" * 60 + "AB"), (None, "SHOUT $ loud"), (36, "a\x1cb\x85c d " * 80)]


def test_failures_of_odd_texts(documents):
    got = sorted(((r.doc_id, r.mask) for r in A.failures(documents(*TEXTS)).collect()), key=str)
    assert got == sorted(((d, plain_mask(t, d, TEXTS)) for d, t in TEXTS), key=str)


def test_query_on_odd_tables(spark, documents):
    docs = documents(*[(d, t, None, [None, "", "web"][i % 3]) for i, (d, t) in enumerate(TEXTS)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, None, 1), (None, 1, 1), (31, 1, None), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    good, toxic = {1, 31}, {1, 7}
    rows = [{"part": [None, "", "web"][i % 3] or "", "mask": plain_mask(t, d, TEXTS), "good": d in good, "toxic": d in toxic}
            for i, (d, t) in enumerate(TEXTS)]
    want = brute(rows, "ABCDE", ["good", "toxic"])
    more = {n: F.lit("own") for n in ["part", "mask", "digest", "least", "good", "n", "rank", "step", "all"]}
    for d, q in ((docs, labels), (docs.withColumns(more), labels.withColumns(more))):
        got = A.audit(A.labelled(A.failures(d), q), lost=["good", "toxic"])
        assert rows_of(got, ["good", "toxic"]) == want
    assert A.audit(A.labelled(A.failures(docs.limit(0)), labels), lost=["good", "toxic"]).count() == 0
    alone = A.audit(A.labelled(A.failures(docs), labels.limit(0)), lost=["good", "toxic"])
    assert {r.good_lost for r in alone.collect()} == {0}
