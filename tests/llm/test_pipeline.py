import random

import corpus_pipeline
from sieveline.llm import decontaminate, quality_rules

from .test_bpe import expected
from .test_decontaminate import brute as brute_hits
from .test_quality_rules import brute as brute_quality
from .test_repeats import brute as brute_repeats
from .test_simhash import brute_components, brute_fp


def made():
    r = random.Random(9)
    def prose(k): return " ".join(r.choice("abcdefghijklmnop") + r.choice("aeiouéü") + r.choice("rstlmn") * r.randrange(1, 3)
                                  + r.choice("aeiou") for _ in range(k)) + "."
    shared, test = prose(70), prose(30)
    rows = [(i, prose(r.choice([40, 120]))) for i in range(40)]
    rows += [(100 + i, prose(60) + "\n" + shared + "\n" + prose(50)) for i in range(5)]
    rows += [(200 + i, prose(50) + " " + test + " " + prose(20)) for i in range(4)]
    rows += [(300 + i, rows[i][1]) for i in range(6)] + [(400, None), (401, "too short"), (402, "again and again it goes " * 30)]
    return rows, [(1, test), (2, prose(25))]


def test_stages_match_brute_force(spark, documents, tmp_path):
    rows, items = made()
    documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    good, unique, once, clean = steps
    assert good == sorted((d, t) for d, t in rows if not brute_quality(t)[-1]
                          and quality_rules.measure(t)[2] * 10 <= 2 * quality_rules.measure(t)[0])
    comp = brute_components([d for d, _ in good], [brute_fp(t) for _, t in good])
    assert unique == [g for g, c in zip(good, comp) if c == g[0]] and len(unique) < len(good)
    removed = {b[0]: b[2] for b in brute_repeats(unique)}
    assert [d for d, _ in once] == [d for d, _ in unique] and sum(map(bool, removed.values())) >= 5
    for (d, before), (_, after) in zip(unique, once):
        assert (after == before) == (not removed[d])
        assert 0 <= len(before.encode()) - removed[d] - len(after.encode()) <= 6 or not removed[d]
    assert not any(b[-1] for b in brute_hits(clean, items)) and sum(b[-1] for b in brute_hits(once, items)) >= 4
    hit = {b[0] for b in brute_hits(once, items) if b[-1]}
    assert all(a == b for a, b in zip(once, clean) if a[0] not in hit)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((d, *expected(t)) for d, t in clean)
    assert decontaminate.WINDOW == 10


def test_an_empty_table_runs_through(spark, documents, tmp_path):
    documents().limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
