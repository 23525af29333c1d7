from collections import Counter
from zlib import crc32

from sieveline.llm import sharding as S

from .conftest import ODD


def test_shards_are_even_and_match_the_mixture(spark, documents, monkeypatch):
    rows = [(i, f"text {i}", None, "big" if i % 3 else f"s{i % 7}") for i in range(3000)] + ODD
    for block in (S.BLOCK, 100):
        got = S.interleave(documents(*rows), shards=24, block=block).collect()
        assert len(got) == len(rows)
        shards = Counter(r.shard for r in got)
        assert set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
        for s, n in shards.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        source = {i: s for i, _, _, s in rows[:3000]}
        for s in range(24):
            big = sum(source.get(r.doc_id) == "big" for r in got if r.shard == s and r.doc_id is not None)
            assert abs(big - 2000 / 24) <= 3
        text = {d: t for d, t, *_ in rows if d not in (8, 9, *range(11))}
        for r in got:
            if r.doc_id in text:
                raw = text[r.doc_id].encode()
                assert (r.size, r.text_crc32) == (len(raw) + 8, crc32(raw))


def test_placement_does_not_depend_on_blocks_or_partitions(spark, documents):
    docs = documents(*((i, f"t{i}", None, f"s{i % 3}") for i in range(500)))
    one = sorted(map(tuple, S.interleave(docs, block=7).collect()), key=str)
    assert one == sorted(map(tuple, S.interleave(docs.repartition(13)).collect()), key=str)
    assert S.interleave(documents().limit(0)).collect() == []
    assert [(r.shard, r.slot, r.size) for r in S.interleave(documents((1, None))).collect()] == [(0, 0, 8)]


def test_rows_without_ids_and_sources_of_one_row(spark, documents):
    """A third of the rows without an id, equal rows among them, and many sources with a row each: even shards, no crowded block."""
    rows = [(None if i % 3 == 0 else i, f"text {i if i % 2 else 0}", None, "hot" if i % 2 else f"s{i}") for i in range(6000)]
    rows += [(None, "the same", None, "hot")] * 2000
    got = S.interleave(documents(*rows), shards=8, block=200).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(sizes[s]))
    hot = Counter(r.shard for r in got if r.text_crc32 == next(x.text_crc32 for x in got if x.size == 16))
    assert max(hot.values()) - min(hot.values()) <= 40
