import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import classifier as C
from sieveline.llm.common import learn_fold

from .conftest import ODD

GOOD = "the plain words of a story go on and on with nothing odd about them at all "
BAD = "*** BUY!!! *** NOW!!! *** "


def test_learns_from_labels_it_may_see(spark, documents):
    rows = [(i, (GOOD if i % 3 else BAD) * (1 + i % 5) + f"w{i}") for i in range(20, 420)]
    docs = documents(*rows, *ODD)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20, 420)], "doc_id long, quality int, toxic int")
    got = C.classify(docs, labels, learn_fold(4, 2)).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held if 20 <= r.doc_id]) > 0.97
    # labels of held-out rows change nothing
    wrong = labels.withColumn("quality", F.when(learn_fold(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in C.classify(docs, wrong, learn_fold(4, 2)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)
    assert C.classify(documents().limit(0), labels).collect() == []
    assert {r.score for r in C.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_vectors_match_brute_force(spark, documents):
    texts = ["one two three two", "two one\nTHREE", None, ""]
    got = {r.row: r for r in C.count_vectors(documents(*texts)).collect()}
    plus, minus = C.index_vectors()
    want = {}
    for t in texts:
        _, *streams = C.tokens([(t or "").encode()])
        for rows in streams:
            for i, a in enumerate(rows.tolist()):
                v = want.setdefault(a, np.zeros(C.DIM + 1, int))
                v[-1] += 1
                for j in range(max(0, i - C.REACH), min(len(rows), i + C.REACH + 1)):
                    if j != i:
                        v[plus[rows[j]]] += 1
                        v[minus[rows[j]]] -= 1
    assert set(got) == set(want)
    for row, v in want.items():
        assert [got[row][f"c{k}"] for k in range(C.DIM)] == v[:-1].tolist() and got[row].n == v[-1]


def test_same_word_same_row_wherever_it_stands():
    _, a, _ = C.tokens([b"alpha beta gamma", b"beta"])
    _, b, _ = C.tokens([b"x BETA, alpha"])
    assert a[1] == a[3] == b[1] and a[0] == b[3]


def test_temperature_is_fitted_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, C.FEATURES))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    net = C.Network().fit(x, y)
    assert net.temperature > 1 and abs(net.score(x).mean() - y.mean()) < 0.1


def test_long_texts_pool_the_same(spark, documents, monkeypatch):
    import random

    import numpy as np
    r = random.Random(2)
    texts = ["".join(r.choice(["alpha ", "Beta", "\n", "12 ", "!! ", "漢 ", "beta beta "]) for _ in range(n)) for n in (0, 5, 300, 900, 40)]
    docs = documents(*texts)
    want = sorted(map(tuple, C.count_vectors(docs).collect()))
    vectors, weight = C.word_vectors(docs)
    pooled = C.pool([t.encode() for t in texts], vectors, weight)
    monkeypatch.setattr(C, "LONG", 100)
    assert all(len(C.pieces(t.encode())) > 1 for t in texts if len(t) > 400)
    assert sorted(map(tuple, C.count_vectors(docs).collect())) == want
    assert np.allclose(C.pool([t.encode() for t in texts], vectors, weight), pooled, rtol=1e-4, atol=1e-5)


def test_one_text_of_a_repeated_id_is_learned_from(spark, documents):
    docs = documents(*[(i % 3, f"text {i} of words") for i in range(30)])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    first, again = (sorted(map(tuple, C.classify(d, labels).collect())) for d in (docs, docs.repartition(5)))
    assert first == again


def test_training_rows_are_pooled_a_megabyte_at_a_time(spark, documents, monkeypatch):
    """op3_classifier: what a task holds while it pools labelled texts does not follow the batches Spark hands it."""
    seen = []
    whole = C.map_texts

    def watched(docs, columns, schema, step, limit=8 << 20):
        seen.append(limit)
        return whole(docs, columns, schema, step, limit)
    monkeypatch.setattr(C, "map_texts", watched)
    docs = documents(*[(i, "good words " * 5 if i % 2 else "#### $$$ 1 2 3") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert C.classify(docs, labels).count() == 40
    assert seen[0] <= 1 << 20
