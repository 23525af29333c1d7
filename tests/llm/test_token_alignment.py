import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import token_alignment as A
from sieveline.llm.bpe import byte_letters

from .conftest import ODD

FILES = A.vocabularies()


@pytest.fixture(scope="module")
def plain():
    """Both libraries as they come: text -> tokens of either side as (id, bytes), or nothing if they do not come back."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in zip(second.encode(text), second.encode(text, out_type=str))]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])
    return tokens


def ends(tokens):
    out, at = [], 0
    for i, x in tokens:
        at += len(x)
        out.append((at, i))
    return out


def brute(rows, tokens):
    """Figures of (doc_id, text) rows, as sorted tuples, and the counts of pairs."""
    each = []
    for doc_id, text in rows:
        a, b = tokens(text)
        ea, eb = ends(a), ends(b)
        common = sorted({e for e, _ in ea} & {e for e, _ in eb})
        groups, low = [], 0
        for high in common:
            groups.append(",".join(str(i) for e, i in ea if low < e <= high) + "|" + ",".join(str(i) for e, i in eb if low < e <= high))
            low = high
        links = [(i, j) for e, i in ea for f, j in eb if e == f]
        each.append((doc_id, len(a), len(b), groups, links))
    count = Counter(x for *_, links in each for x in links)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    figures = [(d, a, b, len(g), len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls),
                hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, ls in each]
    return sorted(figures, key=str), {(i, j): (n, n == most[j]) for (i, j), n in count.items()}


def figures(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


WORDS = ["the", "of", "Ünïcödé", "漢字", "\U0001F600", "naïve", "don't", "it's", "3.14", "<|endoftext|>", "</s>", "<0x0A>", "▁", "x\x00y",
         "tokenization", "\t", "\n\n", "   ", "a　b", "ﬁ", "QWERTY", "##", "é"]


def sample(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice([" ", "", "  "]).join(rng.choice(WORDS) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    return [*rows, *[(d, t) for d, t in ODD if t is None or len(t) < 10_000], (500, "a" * 3000), (501, " " * 500), (502, None), (500, "the of the of")]


@pytest.mark.parametrize("radices,links,fan", [(64, 2_000_000, 128), (5, 150, 3), (1, 40, 2)])
def test_against_both_libraries(documents, plain, radices, links, fan):
    rows = sample(radices, 60)
    docs = documents(*rows).repartition(4)
    want, count = brute(rows, plain)
    assert figures(A.align(docs, FILES, radices, links, fan)) == want
    got = {(r.a, r.b): (r.n, r.best) for r in A.pair_counts(docs, FILES, radices, links, fan).collect()}
    assert got == count


def test_further_columns_and_empty_tables(documents):
    docs = documents(*sample(9, 10))
    more = docs.withColumns({n: F.lit("own") for n in ["block", "radix", "run", "told", "pairs", "body", "runs", "n", "grp"]})
    assert figures(A.align(docs)) == figures(A.align(more))
    assert A.align(docs.limit(0)).count() == 0


def test_long_texts_are_cut_where_no_token_joins(plain, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["plain", "words", "it's 3.5", "x  y", "\nline", "end."]) for _ in range(4000))
    assert "".join(A.cut(" " + text, 100)) == " " + text and len(A.cut(" " + text, 100)) > 50
    monkeypatch.setattr(A, "PIECE", 300)
    gather = A.Gatherer(A.Aligner(*FILES), 4, 10 ** 9)
    gather.add(1, text)
    gather.settle()
    [want], _ = brute([(1, text)], plain)
    row = gather.rows[0]
    assert (row[2], row[3], row[4], row[5].hexdigest()) == (want[1], want[2], want[3], want[7])


def test_very_long_runs():
    """White space and one letter in millions: beyond the pattern matcher's stack, still whole."""
    align = A.Aligner(*FILES)
    for text in (" " * 1_500_000, "\n" * 300_000 + "x", "é" * 200_000):
        good, na, nb, groups, said, owner, a, b = align([" " + text])
        assert good[0] and na[0] and nb[0] and groups[0] == len(a) == len(b)


def test_merging_runs():
    rng = np.random.default_rng(4)
    runs, every = [], Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 50, 30) << A.A_BITS | rng.integers(0, 3, 30))
        n = rng.integers(1, 9, len(keys))
        every.update(dict(zip(keys.tolist(), n.tolist())))
        runs.append(A.squeeze(np.stack([keys, n])))
    most = {}
    for k, n in every.items():
        most[k >> A.A_BITS] = max(most.get(k >> A.A_BITS, 0), n)
    for run, said in zip(runs, A.told(runs)):
        keys = A.unsqueeze(run).reshape(2, -1)[0].tolist()
        n, best = A.unsqueeze(said).reshape(2, -1).tolist()
        assert n == [every[k] for k in keys] and best == [every[k] == most[k >> A.A_BITS] for k in keys]
    whole = A.unsqueeze(A.merged(runs)).reshape(2, -1).tolist()
    assert dict(zip(*whole)) == dict(every) and whole[0] == sorted(whole[0])
