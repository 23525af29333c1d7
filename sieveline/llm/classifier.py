"""A quality classifier: random-indexing word vectors, pooled, under a small network.

Every word has a sparse random index vector, derived from its hash; a word's
vector is the sum of the index vectors around it, over the whole corpus. Words
are hashed into a table of fixed size, so vectors are bounded whatever the
corpus holds, and tasks add theirs up before anything is shuffled. A second,
small vocabulary holds the shapes of words (case, length, digits, marks).

A document is its pooled vectors with a few pooling statistics. A two-layer
network is trained on a bounded sample of labelled rows, and its temperature is
set on a part of the sample that it wasn't trained on, so that scores are
calibrated probabilities.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn_fold, map_texts, read, utf8
from .common import texts as text_batches
from .registry import query

BUCKETS = 1 << 15            # hashed words
SHAPES = 1 << 9              # hashed shapes
ROWS = BUCKETS + SHAPES
DIM = 64
REACH = 2                    # words on each side that count as around
TRAIN_ROWS = 20_000          # labelled rows the network is fitted on, at most
HIDDEN, EPOCHS, BATCH, RATE = 32, 25, 128, 2e-3
THRESHOLD = 0.7
LONG = 1 << 20               # bytes of a text whose tokens are held at once
POOLED = 1 << 20             # bytes of texts pooled at once, about: some 100 bytes are held for each
BLANKS = re.compile(rb"[ \t\x0b\x0c\r]")

# a byte's class: blank, word (letters, digits, multi-byte), mark, line break
KIND = np.full(256, 2, np.int8)
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KIND[0x0A] = 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each row's index vector is +1 and -1."""
    rng = np.random.default_rng(20240601)
    plus = rng.integers(0, DIM, ROWS)
    return plus, (plus + rng.integers(1, DIM, ROWS)) % DIM


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the texts in order: its text's number, its word's row and its shape's row."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = KIND[flat]
    start = np.flatnonzero((kind != 0) & (np.concatenate([[0], kind[:-1]]) != kind))
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.flatnonzero(np.concatenate([kind[1:] != kind[:-1], [True]])) + 1
    end = edge[np.searchsorted(edge, start, "right")]
    size = end - start
    # bytes before each place, weighed by their place in the token: prefix sums give every token's hash
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(flat)]])))
    weight = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    weight ^= weight >> np.uint64(31)
    weight *= np.uint64(0xBF58476D1CE4E5B9)
    value = (LOWER[flat].astype(np.uint64) + np.uint64(1)) * (weight | np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    mixed = (total[end] - total[start]) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    word = (mixed % np.uint64(BUCKETS)).astype(np.int64)
    def upto(mask):
        return np.concatenate([[0], np.cumsum(mask)])
    upper, digit = upto((flat >= 0x41) & (flat <= 0x5A)), upto((flat >= 0x30) & (flat <= 0x39))
    caps, nums = upper[end] - upper[start], digit[end] - digit[start]
    case = np.where(caps == 0, 0, np.where(2 * caps > size, 2, 1))
    own = np.where(kind[start] == 2, flat[start].astype(np.int64), 0)                  # a mark is its own shape
    shape = ((own * 4 + case) * 2 + (nums > 0)) * 8 + np.minimum(size, 7)
    shape = BUCKETS + (shape * 4 + kind[start]) % 509
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, start, "right"), word, shape


def pieces(text: bytes) -> list[bytes]:
    """A long text in pieces of some ``LONG`` bytes, cut at blanks; a token of twice that is several tokens."""
    at, out = 0, []
    while len(text) - at > 2 * LONG:
        m = BLANKS.search(text, at + LONG, at + 2 * LONG)
        to = m.start() if m else at + 2 * LONG
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def streams(texts: list[bytes]):
    """(text of each token, word and shape rows, how many leading tokens are repeated): all short texts at once, then each
    piece of the long ones, with the last ``REACH`` tokens of the piece before it."""
    yield (*tokens([b"" if len(t) > LONG else t for t in texts]), 0)
    for i, text in enumerate(texts):
        if len(text) > LONG:
            last = np.zeros((2, 0), np.int64)
            for part in pieces(text):
                _, *rows = tokens([part])
                both = np.concatenate([last, rows], 1)
                yield np.full(both.shape[1], i), *both, last.shape[1]
                last = both[:, max(0, both.shape[1] - REACH):]


def count_vectors(docs: DataFrame) -> DataFrame:
    """``row, n`` and ``DIM`` sums over every text of ``docs``: the vectors before scaling."""
    plus, minus = index_vectors()
    columns = [f"c{i}" for i in range(DIM)]

    def run(batches):
        sums, seen = np.zeros(ROWS * DIM, np.int64), np.zeros(ROWS, np.int64)
        for batch in text_batches(batches, 2 << 20):
            for owner, *kinds, again in streams(utf8(batch.column("text"))):
                for rows in kinds:
                    seen += np.bincount(rows[again:], minlength=ROWS)
                    for d in range(1, REACH + 1):
                        near = owner[d:] == owner[:-d]
                        near[:max(0, again - d)] = False                   # counted with the piece before
                        a, b = rows[:-d][near], rows[d:][near]
                        for x, y in ((a, b), (b, a)):
                            sums += np.bincount(x * DIM + plus[y], minlength=ROWS * DIM)
                            sums -= np.bincount(x * DIM + minus[y], minlength=ROWS * DIM)
        used = np.flatnonzero(seen)
        for a in range(0, len(used), 4096):
            part = used[a:a + 4096]
            got = sums.reshape(ROWS, DIM)[part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(seen[part]), *(pa.array(got[:, i].copy()) for i in range(DIM))],
                names=["row", "n", *columns])

    schema = "row int, n long, " + ", ".join(f"{c} long" for c in columns)
    return docs.select("text").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table of vectors (fixed size) and each row's pooling weight, from every text of ``docs``."""
    vectors, n = np.zeros((ROWS, DIM), np.float32), np.zeros(ROWS)
    got = count_vectors(docs).toPandas()                       # ROWS rows at most
    at = got["row"].to_numpy(np.int64)
    n[at] = got["n"].to_numpy()
    vectors[at] = got[[f"c{i}" for i in range(DIM)]].to_numpy(np.float32)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.where(norm > 0, norm, 1)
    share = n / max(1.0, n[:BUCKETS].sum())
    return vectors, (1e-3 / (1e-3 + share)).astype(np.float32)


FEATURES = 2 * DIM + 6


def pool(texts: list[bytes], vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row of features for each text; all zero where it has no token."""
    long = [i for i, t in enumerate(texts) if len(t) > LONG]
    if long:
        out = pool([b"" if len(t) > LONG else t for t in texts], vectors, weight)
        for i in long:
            out[i] = pool_long(texts[i], vectors, weight)
        return out
    out = np.zeros((len(texts), FEATURES), np.float32)
    owner, word, shape = tokens(texts)
    if not len(owner):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    docs, n = owner[first], np.diff(np.concatenate([first, [len(owner)]])).astype(np.float32)
    for k, rows in enumerate((word, shape)):
        w = weight[rows] if k == 0 else np.ones(len(rows), np.float32)
        total = np.add.reduceat(vectors[rows] * w[:, None], first, axis=0)
        out[docs, k * DIM:(k + 1) * DIM] = total / np.add.reduceat(w, first)[:, None]
    key = np.sort(owner * BUCKETS + word)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    run = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
    whose = key[new] // BUCKETS
    kinds = np.bincount(whose, minlength=len(texts))[docs]
    most = np.zeros(len(texts))
    np.maximum.at(most, whose, run)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])])
    extra = [np.log1p(n), kinds / n, most[docs] / n, np.add.reduceat(again.astype(np.float32), first) / n,
             kinds / np.sqrt(n), np.linalg.norm(out[docs, :DIM], axis=1)]
    out[docs, 2 * DIM:] = np.stack(extra, 1)
    return out


def pool_long(text: bytes, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same features of one long text, a piece at a time."""
    sums, weights = np.zeros((2, DIM)), np.zeros(2)
    times, n, again, last = np.zeros(BUCKETS, np.int64), 0, 0, -1
    for part in pieces(text):
        _, word, shape = tokens([part])
        for k, rows in enumerate((word, shape)):
            w = weight[rows] if k == 0 else np.ones(len(rows), np.float32)
            sums[k] += w @ vectors[rows]
            weights[k] += w.sum()
        times += np.bincount(word, minlength=BUCKETS)
        n += len(word)
        again += int((np.concatenate([[last], word[:-1]]) == word).sum()) if len(word) else 0
        last = int(word[-1]) if len(word) else last
    out = np.zeros(FEATURES)
    if n:
        kinds = int((times > 0).sum())
        out[:2 * DIM] = (sums / weights[:, None]).ravel()
        out[2 * DIM:] = [np.log1p(n), kinds / n, times.max() / n, again / n, kinds / np.sqrt(n), np.linalg.norm(out[:DIM])]
    return out.astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Network:
    """Two layers over standardised features; ``fit`` also sets the temperature."""

    def __init__(self, mean=0.0, scale=1.0, layers=(), temperature=1.0, constant=0.5):
        self.mean, self.scale, self.layers, self.temperature, self.constant = mean, scale, layers, temperature, constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.constant)
        return sigmoid(self.logits(x) / self.temperature).astype(float)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if len(y):
            self.constant = float((y.sum() + 1) / (len(y) + 2))
        if len(set(y.tolist())) < 2:                           # nothing to tell apart: the base rate
            return self
        rng = np.random.default_rng(11)
        order = rng.permutation(len(y))
        held, own = order[:len(y) // 5], order[len(y) // 5:]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-4
        self.layers = [rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN),
                       rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), 0.0]
        z = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(EPOCHS):
            rng.shuffle(own)
            for a in range(0, len(own), BATCH):
                part = own[a:a + BATCH]
                w1, b1, w2, b2 = self.layers
                h = np.maximum(z[part] @ w1 + b1, 0)
                off = (sigmoid(h @ w2 + b2) - y[part]) / len(part)
                back = np.outer(off, w2) * (h > 0)
                grads = [z[part].T @ back + 1e-4 * w1, back.sum(0), h.T @ off + 1e-4 * w2, off.sum()]
                t += 1
                for i, g in enumerate(grads):                  # Adam
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.layers[i] = self.layers[i] - RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        if len(held):
            raw, want = self.logits(x[held]), y[held]
            tries = np.exp(np.linspace(np.log(0.25), np.log(8), 71))
            p = [np.clip(sigmoid(raw / t), 1e-6, 1 - 1e-6) for t in tries]
            self.temperature = float(tries[int(np.argmin([-(want * np.log(q) + (1 - want) * np.log(1 - q)).mean() for q in p]))])
        return self


def train(docs: DataFrame, labels: DataFrame, held, model) -> Network:
    """A network fitted on at most ``TRAIN_ROWS`` labelled ids, by the order of their hash, none of them ``held``.

    Of several rows with one id the text with the smallest hash is learned from.
    """
    spark = docs.sparkSession
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held)
             .groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).collect())
    if not known:
        return Network()
    chosen = spark.createDataFrame([(r.doc_id, int(r.quality)) for r in known], "label_id long, label int")

    def step(batch):
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"),
                "x": [row.tobytes() for row in pool(utf8(batch.column("text")), *model.value)]}

    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    once = own.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))      # TRAIN_ROWS rows at most
    rows = map_texts(once, ["doc_id", "text", "label"], "doc_id long, label int, x binary", step, POOLED)
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), FEATURES).astype(float)
    return Network().fit(x, np.array([r.label for r in got], float))


def classify(docs: DataFrame, labels: DataFrame, held=None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    ``held`` marks ids whose labels are not learned from (none by default).
    Texts that are null or empty have no features and get the network's score
    for those; without labels every score is 0.5. Repeated rows score alike.
    """
    held = F.lit(False) if held is None else held
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(word_vectors(docs))
    network = sc.broadcast(vars(train(docs, labels, held, model)))

    def step(batch):
        raw, scores = utf8(batch.column("text")), []
        a = 0
        while a < len(raw):                                    # about a megabyte of text is pooled at once
            b, size = a + 1, len(raw[a])
            while b < len(raw) and size + len(raw[b]) <= POOLED:
                size += len(raw[b])
                b += 1
            scores.append(Network(**network.value).score(pool(raw[a:b], *model.value)))
            a = b
        score = np.concatenate(scores)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score),
                "predicted": pa.array((score >= THRESHOLD).astype(np.int32))}

    return map_texts(docs.select("doc_id", "text", held.alias("held_out")), ["doc_id", "text", "held_out"],
                     "doc_id long, held_out boolean, score double, predicted int", step)


@query("op3_classifier")
def op3(spark, sf):
    return classify(read(spark, sf, "documents"), read(spark, sf, "labels"), learn_fold(4, 2))
