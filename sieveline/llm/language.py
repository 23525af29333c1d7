"""Language identification as inference of a mixture.

A document is a bag of letter n-grams drawn from several languages at once.
Expectation-maximisation estimates each language's share from the n-gram
likelihoods; of the nested sets of its largest languages, the one whose
likelihood, less a penalty for each further language, is best is the
document's language set.

N-grams are hashed into a table of fixed size, so the model is bounded by
languages times ``BUCKETS`` whatever the corpus holds. Counts come from every
row that may be learned from; tasks add theirs up before anything is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn_fold, map_texts, read
from .common import texts as text_batches
from .registry import query

BITS = 16
BUCKETS = 1 << BITS
SIZES = (1, 2, 3, 4)         # code points in an n-gram
SMOOTHING = 0.5
ROUNDS = 8                   # of expectation-maximisation; shares settle well before
PENALTY = 3.0                # log-likelihood a further language must gain, times log of the n-grams
MAX_LANGUAGES = 2_000        # the model is languages x BUCKETS; more labels than this is an error, not a cut
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
LONG = 1 << 20               # characters of a text whose n-grams are held at once


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text: key ``text index << BITS | bucket`` ascending, and how often each stands.

    Case is ignored; everything but letters becomes one blank on which words
    begin and end. Texts of over ``LONG`` characters are counted a stretch at a time.
    """
    long = [i for i, t in enumerate(texts) if len(t) > LONG]
    if not long:
        return _grams(texts)
    made = [_grams(["" if len(t) > LONG else t for t in texts]), *(_long_grams(texts[i], i) for i in long)]
    key, n = (np.concatenate(c) for c in zip(*made))
    order = np.argsort(key, kind="stable")
    return key[order], n[order]


def _long_grams(text: str, index: int) -> tuple[np.ndarray, np.ndarray]:
    flat, total, reach = " " + text.lower() + " ", np.zeros(BUCKETS, np.int64), max(SIZES) - 1
    for a in range(0, len(flat), LONG):
        part = flat[a:a + LONG + reach]                        # n-grams that start in the stretch, whole
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        key, n = _count(code, _letters(code), np.zeros(len(code), np.int64), LONG)
        total[key] += n
    seen = np.flatnonzero(total)
    return index << BITS | seen, total[seen]


def _letters(code: np.ndarray) -> np.ndarray:
    known = np.zeros(int(code.max()) + 1, bool)
    used = np.unique(code)
    known[used[[bool(LETTER.match(chr(c))) for c in used.tolist()]]] = True
    return known[code]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = " " + "  ".join(texts).lower() + " "
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(code)
    # lower-casing may lengthen a text, so places come from the lowered ones
    sizes = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(owner) != len(code):                                # a final sigma and the like: lower one by one
        flat = " " + "  ".join(t.lower() for t in texts) + " "
        return grams_of(flat, texts)
    return _count(code, letter, owner)


def grams_of(flat: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.fromiter((bool(LETTER.match(c)) for c in flat), bool, len(flat))
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 for t in texts])
    return _count(code, letter, owner)


def _count(code: np.ndarray, letter: np.ndarray, owner: np.ndarray, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and counts of the n-grams that start before ``upto``."""
    symbol = np.where(letter, code, 32).astype(np.uint64)
    keys, mixed = [], np.zeros(len(symbol), np.uint64)
    for size in range(1, max(SIZES) + 1):
        n = len(symbol) - size + 1
        if n <= 0:
            break
        mixed = (mixed[:n] * np.uint64(0x9E3779B97F4A7C15)) + symbol[size - 1:] * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        if size in SIZES:
            bucket = ((mixed + np.uint64(size)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
            whole = (owner[:n] == owner[size - 1:]) & (letter[:n] | letter[size - 1:])
            if size > 2:                                       # blanks only at the ends
                for k in range(1, size - 1):
                    whole &= letter[k:n + k]
            if upto is not None:
                whole[upto:] = False
            keys.append(owner[:n][whole] << BITS | bucket[whole].astype(np.int64))
    flat = np.sort(np.concatenate(keys))
    if not len(flat):
        return flat, flat
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[first], np.diff(np.concatenate([first, [len(flat)]]))


def count_grams(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over rows of ``text, lang``; each task sends a bucket of a language once."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in text_batches(batches, 1 << 20):
            langs = batch.column("lang").to_pylist()
            key, n = grams([t or "" for t in batch.column("text").to_pylist()])
            which, bucket = key >> BITS, key & (BUCKETS - 1)
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], np.int64)[which]
            for i, name in enumerate(names):
                mine = of == i
                if name not in total:
                    total[name] = np.zeros(BUCKETS, np.int64)
                total[name] += np.bincount(bucket[mine], n[mine], BUCKETS).astype(np.int64)
        for name, row in total.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(row[seen])],
                names=["lang", "bucket", "n"])

    return (labelled.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, held) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each bucket under each, from the rows that aren't ``held``."""
    usable = docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = count_grams(usable)
    # fixed-size: at most MAX_LANGUAGES x BUCKETS numbers, packed by language
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("row")).limit(MAX_LANGUAGES + 1)
    found = {}
    for r in rows.toLocalIterator():
        row = np.zeros(BUCKETS)
        got = np.array(r.row, np.int64).reshape(-1, 2)
        row[got[:, 0]] = got[:, 1]
        found[r.lang] = row
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(found)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    table = np.stack([found[x] for x in langs]) + SMOOTHING
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def mixture(like: np.ndarray, n: np.ndarray, start: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each language for many documents at once, and each document's log-likelihood.

    Languages are rows: ``like`` has a column for each (document, n-gram),
    ``allowed`` one for each document; ``start`` is where a document's n-grams
    begin and ``n`` how often each stands.
    """
    size = np.diff(np.concatenate([start, [len(n)]]))
    share = (allowed / allowed.sum(0)).astype(np.float32)
    total = np.add.reduceat(n, start).astype(np.float32)
    weight = n.astype(np.float32)
    for _ in range(ROUNDS):
        part = np.repeat(share, size, 1)
        part *= like
        part *= weight / part.sum(0)
        share = np.add.reduceat(part, start, axis=1) / total
    part = np.repeat(share, size, 1)
    part *= like
    return share, np.add.reduceat(np.log(part.sum(0)) * n, start)


def infer(texts: list[str], langs: list[str], log_p: np.ndarray) -> list[tuple[str, float, dict]]:
    """(language, its share, the set with shares) of each text; ``und`` where a text has no letter."""
    out = [(UNKNOWN, 0.0, {})] * len(texts)
    if not langs:
        return out
    key, n = grams(texts)
    if not len(key):
        return out
    owner = key >> BITS
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    docs, rows = owner[start], log_p[:, key & (BUCKETS - 1)]
    size = np.diff(np.concatenate([start, [len(n)]]))
    penalty = PENALTY * np.log(np.add.reduceat(n, start) + 1)
    top = rows.max(0)
    like = np.exp(rows - top)                                  # likelihoods relative to the best, so that none vanishes
    share, full = mixture(like, n, start, np.ones((len(langs), len(docs))))
    order = np.argsort(-share, axis=0, kind="stable")
    alone = np.add.reduceat((np.take_along_axis(rows, np.repeat(order[:1], size, 1), 0)[0] - top) * n, start)
    best, chosen = alone, np.zeros_like(share)
    np.put_along_axis(chosen, order[:1], 1, 0)
    # all languages together are likelier than any set of them: where even that
    # doesn't pay for a second language, one it is
    open_ = np.flatnonzero(full - penalty > alone)
    for k in range(2, len(langs) + 1):                         # nested sets; a document leaves when one more doesn't pay
        if not len(open_):
            break
        mine = np.flatnonzero(np.repeat(np.isin(np.arange(len(docs)), open_), size))
        allowed = np.zeros((len(langs), len(open_)))
        np.put_along_axis(allowed, order[:k, open_], 1, 0)
        first = np.concatenate([[0], np.cumsum(size[open_])[:-1]])
        got, value = mixture(like[:, mine], n[mine], first, allowed)
        score = value - penalty[open_] * (k - 1)
        better = score > best[open_]
        chosen[:, open_[better]] = got[:, better]
        best[open_[better]] = score[better]
        open_ = open_[better]
    most = chosen.argmax(0)
    for i, d in enumerate(docs.tolist()):
        shares = {langs[j]: float(chosen[j, i]) for j in np.flatnonzero(chosen[:, i] > 1e-4)}
        out[d] = (langs[most[i]], min(1.0, float(chosen[most[i], i])), shares)
    return out


def identify(docs: DataFrame, held=None, with_shares: bool = True) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and ``shares`` of each row of ``docs``.

    ``held`` marks rows whose label isn't learned from (none by default). Texts
    that are null, empty or without a letter are ``und`` with a score of 0, as
    are all where nothing could be learned. Equal shares go to the language
    that sorts first.
    """
    held = F.lit(False) if held is None else held
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, held))
    schema = "doc_id long, held_out boolean, lang_pred string, score double" + ", shares map<string,double>" * with_shares

    def step(batch):
        langs, log_p = model.value
        texts, found = [t or "" for t in batch.column("text").to_pylist()], []
        room = max(1, (1 << 20) // max(1, len(langs)))         # characters whose n-grams are held at once
        a = 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) <= room:
                size += len(texts[b])
                b += 1
            found += infer(texts[a:b], langs, log_p)
            a = b
        made = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64())}
        if with_shares:
            made["shares"] = pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))
        return made

    return map_texts(docs.select("doc_id", "text", held.alias("held_out")), ["doc_id", "text", "held_out"], schema, step)


@query("op10_language")
def op10(spark, sf):
    return identify(read(spark, sf, "documents"), learn_fold(3, 1), with_shares=False)
