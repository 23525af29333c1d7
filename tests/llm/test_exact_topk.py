import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import exact_topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, asks=lambda i: i % 50 == 0):
    """Every pair scored: the answer as sorted tuples."""
    part = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = []
    for at, (i, q) in enumerate(part):
        if asks(i):
            far = 2 ** 63 - 1
            scored = sorted((-max(-far, min(far, sum(a * b for a, b in zip(q, v)))), j) for p, (j, v) in enumerate(part) if p != at and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def answer(df, k=5, asks=None):
    got = T.top_k(df, F.col("vec_id") % 50 == 0 if asks is None else asks, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_odd_vectors(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 0) for i in range(120)]
    rows += [(50, rows[50][1], 0), (50, None, 0), (100, [], 0), (101, [], 1), (None, [1.0] * 6, 0), (150, [nan] + [0.0] * 5, 0),
             (200, [inf] * 6, 0), (200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (250, [0.5, 0.25], 0), (300, [0.0] * 6, 0), (7, [0.5] * 6, 0),
             (8, [0.5] * 6, 0), (0, [1e9] * 6, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert answer(df) == brute(rows, 5)
    more = df.withColumns({n: F.lit("own") for n in ["pack", "width", "ids", "asks", "x", "grp", "place", "score", "rank", "from"]})
    assert answer(more) == brute(rows, 5)
    assert answer(df.limit(0)) == [] and answer(df, asks=F.lit(None).cast("boolean")) == []
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert answer(few) == brute(rows[:3], 5) and len(answer(few)) == 2


def test_many_equal_rows(spark):
    rows = [(i % 7, [0.1, -0.2, 0.3], 0) for i in range(400)] + [(i, [float(i), 1.0, -float(i)], 0) for i in range(60)]
    assert answer(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows, 5)


def test_beyond_a_long(spark):
    rows = [(0, [1e15] * 3, 0), (1, [1e15] * 3, 0), (2, [-1e15] * 3, 0), (50, [3e38] * 3, 0), (51, [1e-3] * 3, 0), (52, [0.5] * 3, 0)]
    assert answer(spark.createDataFrame(rows, SCHEMA)) == brute(rows, 5)
    big = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert answer(big) == [(0, 1, 1, 2 ** 63 - 1), (0, 2, 2, 1 - 2 ** 63)]


@pytest.mark.parametrize("kind", ["even", "clusters", "skewed", "huge"])
def test_lists_against_all_scores(kind):
    """One block: what is read and left out never changes the k best."""
    rng = np.random.default_rng(5)
    n, width, m, k = 700, 16, 20, 5
    x = rng.normal(0, 40, (n, width))
    if kind == "clusters":
        x = rng.normal(0, 60, (10, width))[rng.integers(0, 10, n)] + rng.normal(0, 2, (n, width))
    if kind == "skewed":
        x = x * np.geomspace(50, 0.01, width)
    if kind == "huge":
        x = x * 2.0 ** 24
    x = np.floor(x)
    down = np.argsort(-x, axis=0, kind="stable").T.astype("<u2")
    block = T.Block(width, np.arange(n).astype("<i8").tobytes(), x.astype("<f8").tobytes(), down.tobytes())
    own = np.arange(m) * 3
    for at, (ids, score) in zip(own, block.top(x[own], own, k)):
        want = sorted((-int(s), i) for i, s in enumerate(x.astype(int).astype(object) @ x[at].astype(int).astype(object)) if i != at)[:k]
        assert [(-s, i) for s, i in want] == [(int(s), i) for s, i in zip(score, ids)]


def test_structured_lists_are_not_read_to_the_end():
    """With a few strong dimensions the outsiders are out long before the end."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(0, 1, (4000, 12)) * np.geomspace(4000, 2, 12))
    down = np.argsort(-x, axis=0, kind="stable").T.astype("<u2")
    block = T.Block(12, np.arange(4000).astype("<i8").tobytes(), x.astype("<f8").tobytes(), down.tobytes())
    block.top(x[:50], np.arange(50), 5)
    assert max(block.unread) < 4000 * 0.9
