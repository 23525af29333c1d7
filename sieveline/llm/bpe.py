"""Byte-level BPE encoding and decoding through a lexicon of frequent words.

Words are counted over the whole corpus; the frequent ones, with the ids they
encode to, are compiled into a minimal acyclic transducer that tasks map into
memory. A batch's distinct words are looked up there at once, and words it does
not hold are merged exactly. The vocabulary file is a parameter; the driver
reads it, and its merges travel with the job.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import settle

from .common import map_texts, read
from .common import texts as text_batches
from .registry import query
from .transducer import Transducer, compile_words

# Words in the lexicon, at most: the most frequent. It bounds what is broadcast
# (about 40 bytes a word); all others are merged.
LEXICON = 50_000
COUNTED = 300_000            # distinct words a task holds before it hands its counts on
BATCH = 2 << 20              # bytes of text encoded together: it bounds a task's arrays, of which decoding makes the largest
LONG = 64                    # bytes; longer words are merged one by one

# The pattern that splits text before merging, with white space
# spelt out as the Unicode property.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes as themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """Merges, token bytes and special tokens of a vocabulary file, in compact arrays."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    tokens: list[bytes] = [b""] * size
    for token, i in vocab.items():
        tokens[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    first = np.zeros(256, np.int64)
    for c, b in letters.items():
        first[b] = vocab[c]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    return {"first": first, "keys": keys, "made": made, "special": special, "tokens": tokens}


class Merger:
    """Exact merging of words, many at a time."""

    def __init__(self, spec: dict):
        self.first = spec["first"]
        order = np.argsort(spec["keys"])
        self.keys, self.rank, self.made = spec["keys"][order], order, spec["made"][order]
        self.merges = dict(zip(spec["keys"].tolist(), zip(range(len(order)), spec["made"].tolist())))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words as a ragged table.

        Each round merges, in every word at once, the best-ranked pair and the
        leftmost of equals, until a word has none left.
        """
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        size = np.fromiter((0 if len(w) > LONG else len(w) for w in words), np.int64, len(words))
        ids = self.first[np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        done = [(np.full(len(r), i), np.array(r, np.int64)) for i in long
                for r in [self.merge_long(self.first[np.frombuffer(words[i], np.uint8)].tolist())]]
        none = np.int64(1) << 62
        while len(ids):
            key = np.concatenate([ids[:-1] << 20 | ids[1:], [0]])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & np.concatenate([owner[1:] == owner[:-1], [False]])
            score = np.where(hit, self.rank[at] << 32 | np.arange(len(ids)), none)
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(score, start)
            place = best[best < none] & (1 << 32) - 1
            ids[place] = self.made[at[place]]
            stays = np.ones(len(ids), bool)
            stays[place + 1] = False
            alive = np.repeat(best < none, np.diff(np.concatenate([start, [len(ids)]])))
            done.append((owner[~alive], ids[~alive]))
            ids, owner = ids[alive & stays], owner[alive & stays]
        owner = np.concatenate([np.zeros(0, np.int64), *(d[0] for d in done)])
        flat = np.concatenate([np.zeros(0, np.int64), *(d[1] for d in done)])
        order = np.argsort(owner, kind="stable")
        return (np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64),
                flat[order].astype(np.uint32))

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for one word of any length, with a heap and links."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := merges.get(ids[i] << 20 | ids[after[i]])) is not None:
                heapq.heappush(heap, (m[0], i, m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or merges.get(ids[i] << 20 | ids[j]) != (rank, made):
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class Numbering(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Splitter:
    """Words of a text as the tokenizer splits it; special tokens are words of their own."""

    def __init__(self, special: dict[str, int]):
        self.find = regex.compile(SPLIT).findall
        self.special = special
        order = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, order)) + ")").split if special else None

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.find(text)
        words: list[str] = []
        for part in self.cut(text):
            words += [part] if part in self.special else self.find(part)
        return words


def spread(offset: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that the rows ``which`` of a ragged table take, one after another; and where each row's end."""
    size = offset[which + 1] - offset[which]
    end = np.cumsum(size)
    return np.repeat(offset[which] - end + size, size) + np.arange(end[-1] if len(end) else 0), end


def table(rows: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.concatenate([[0], np.cumsum(size)]), np.fromiter((x for r in rows for x in r), np.uint32, int(size.sum()))


class Encoder:
    """Texts to ids and back, a batch at a time."""

    def __init__(self, spec: dict, lexicon: bytes):
        self.special = spec["special"]
        self.split, self.merge, self.lexicon = Splitter(self.special), Merger(spec), Transducer(lexicon)
        size = np.fromiter(map(len, spec["tokens"]), np.int64, len(spec["tokens"]))
        self.token_at = np.concatenate([[0], np.cumsum(size)])
        self.token_bytes = np.frombuffer(b"".join(spec["tokens"]), np.uint8)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words as a ragged table."""
        raw = [w.encode() for w in words]
        rank = self.lexicon.rank(raw)
        for i, w in enumerate(words):
            if w in self.special:
                rank[i] = -1
        unseen = np.flatnonzero(rank < 0)
        extra_at, extra = self.merge([raw[i] for i in unseen.tolist()])
        special = [k for k, i in enumerate(unseen.tolist()) if words[i] in self.special]
        if special:
            rows = np.split(extra, extra_at[1:-1])
            for k in special:
                rows[k] = [self.special[words[unseen[k]]]]
            extra_at, extra = table(rows)
        known = len(self.lexicon.ids)
        offset = np.concatenate([self.lexicon.offset, known + extra_at[1:]])
        source = rank.copy()
        source[unseen] = len(self.lexicon.offset) - 1 + np.arange(len(unseen))
        at, end = spread(offset, source)
        return np.concatenate([[0], end]), np.concatenate([self.lexicon.ids, extra])[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's end."""
        number = Numbering()
        flat, ends = [], []
        for text in texts:
            flat += map(number.__getitem__, self.split(text))
            ends.append(len(flat))
        which = np.array(flat, np.int64)
        offset, ids = self.word_ids(list(number))
        at, end = spread(offset, which)
        end = np.concatenate([[0], end])
        return ids[at].astype("<u4"), end[np.array(ends, np.int64)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's bytes in UTF-8; a malformed sequence becomes the replacement character."""
        at, end = spread(self.token_at, ids.astype(np.int64))
        flat = self.token_bytes[at].tobytes()
        end = np.concatenate([[0], end])[ends].tolist()
        parts = [flat[a:b] for a, b in zip([0, *end], end)]
        return [p if p.isascii() else p.decode("utf-8", "replace").encode() for p in parts]


def word_counts(docs: DataFrame, special: dict[str, int]) -> DataFrame:
    """``word, n`` over every text; tasks add up their own words first."""
    def count(batches):
        split, total = Splitter(special), {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                               pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for batch in text_batches(batches, BATCH):
            number, flat = Numbering(), []
            for text in batch.column("text").to_pylist():
                flat += map(number.__getitem__, split(text or ""))
            seen = np.bincount(np.array(flat, np.int64), minlength=len(number)).tolist()
            for word, n in zip(number, seen):
                total[word] = total.get(word, 0) + n
            if len(total) >= COUNTED:
                yield rows()
                total.clear()
        if total:
            yield rows()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, size: int) -> DataFrame:
    """The most frequent words of ``counted``, ``size`` at most.

    A histogram of counts, in steps of a few per cent, says from which step on
    words fit; of the step that would be too many, an even share by the words'
    hash (so ``size`` is kept up to chance).
    """
    step = F.floor(F.log2("n") * 16)
    room, top = size, F.lit(True)
    for row in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        if row.words >= room:                                  # all higher steps fit whole
            share = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(room / row.words * (1 << 20))
            top = (step > row.step) | ((step == row.step) & share)
            break
        room -= row.words
    return counted.filter(top)


def compile_lexicon(docs: DataFrame, spec: dict, size: int = LEXICON) -> bytes:
    """The transducer of the corpus's most frequent words, ``size`` at most. Only these come to the driver."""
    counted = settle(word_counts(docs, spec["special"]), "word-counts").filter(F.octet_length("word") <= LONG)
    words = [r.word.encode() for r in frequent(counted, size).select("word").collect() if r.word not in spec["special"]]
    at, ids = Merger(spec)(words)
    return compile_words({w: ids[a:b].tolist() for w, a, b in zip(words, at.tolist(), at[1:].tolist())})


def encode(docs: DataFrame, path: str, size: int = LEXICON, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and the ``ids`` of each row of ``docs``.

    Null is encoded as the empty text: no ids. Repeated rows and ids are each
    encoded; texts of any length are encoded whole.
    """
    spec = load(path)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((spec, compile_lexicon(docs, spec, size)))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    box: list[Encoder] = []

    def step(batch):
        if not box:
            box.append(Encoder(*held.value))
        coder = box[0]
        ids, ends = coder.encode([t or "" for t in batch.column("text").to_pylist()])
        starts = [0, *ends.tolist()]
        raw = memoryview(ids.tobytes())
        made = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(starts), pa.int64()),
                "ids_sha256": [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(starts, starts[1:])],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in coder.decode(ids, ends)]}
        if with_ids:
            made["ids"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
        return made

    return map_texts(docs, ["doc_id", "text"], schema, step, BATCH)


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe")
def op4(spark, sf):
    return encode(read(spark, sf, "documents"), vocabulary(), with_ids=False)
