import hashlib
import struct

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sieveline.llm import bpe
from sieveline.llm.transducer import Transducer, compile_words

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)
SPEC = bpe.load(PATH)
PLAIN = bpe.Encoder(SPEC, compile_words({b" the": [262], b"the": [1169]}))


def expected(text):
    ids = OWN.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256(OWN.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_rows_match_the_library(spark, documents):
    got = bpe.encode(documents(*ODD), PATH, size=20, with_ids=True).collect()
    assert len(got) == len(ODD)
    want = sorted(((d, *expected(t)) for d, t in ODD), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == want
    assert next(r.ids for r in got if r.doc_id == 4) == OWN.encode("word").ids
    assert bpe.encode(documents().limit(0), PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdlletrvm<|endoftext|> 　é1٣"), st.characters(
    exclude_categories=["Cs", "Cn", "Co"])), max_size=80))
def test_any_text_encodes_as_the_library_does(text):
    ids, ends = PLAIN.encode([text])
    assert ids.tolist() == OWN.encode(text, add_special_tokens=False).ids
    assert PLAIN.decode(ids, ends)[0].decode() == OWN.decode(ids.tolist(), skip_special_tokens=False)


def test_long_words_merge_alike():
    word = "abcabcdefxyzthethe" * 30
    assert PLAIN.encode([word])[0].tolist() == OWN.encode(word).ids


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "é", "a"])}
    t = Transducer(compile_words(words))
    probe = [*words, b"", b"t", b"tapsx", b"to", b"z"]
    rank = t.rank(probe)
    assert (rank[len(words):] == -1).all()
    for w, r in zip(words, rank.tolist()):
        assert t.ids[t.offset[r]:t.offset[r + 1]].tolist() == words[w]
    assert len(t.final) < sum(map(len, words))


def test_a_lexicon_of_words_that_are_all_as_frequent(spark, documents):
    """Where one step of counts holds more words than the lexicon takes, a share of them is taken."""
    docs = documents(" ".join(f"word{i}" for i in range(4000)))
    spec = bpe.load(PATH)
    n = len(Transducer(bpe.compile_lexicon(docs, spec, 1000)).offset) - 1
    assert 800 < n < 1200


def test_frequent_words_are_chosen_by_one_comparison(spark):
    """op4_bpe: the condition does not grow with the number of steps of the histogram."""
    counts = {f"w{i}": int(1.05 ** i) + 1 for i in range(300)} | {f"v{i}": 1 for i in range(2000)}
    counted = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = bpe.frequent(counted, 250)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 1
    words = {r.word for r in got.collect()}
    assert {f"w{i}" for i in range(60, 300)} <= words and len(words) <= 260
    assert len(bpe.frequent(counted, 10_000).collect()) == 2300 and 300 <= len(bpe.frequent(counted, 1300).collect()) < 1500
