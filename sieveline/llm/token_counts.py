"""Edit-aware token counts.

A document keeps a tree over its segments: a segment is a run of whole words of
the tokenizer's split, about ``SEGMENT`` characters, with its length and its
token count; above them stand the sums of ``FAN`` nodes each. An edit re-encodes
the segments it touches, with enough context before it, and goes on only until
a word ends where an old segment began; from there on the old counts hold, for
a word depends on nothing before it. Sums change along the paths to the root.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, Numbering, Splitter, load, vocabulary
from .common import read, texts
from .registry import query

SEGMENT = 256                # characters of a segment, about
FAN = 16
# Characters before an edit that may split differently for it: a word looks
# two ahead of its end, and a special token is found by all of its own.
LOOK = 2

TREE = "doc_id long, text string, chars array<int>, tokens array<int>, sums array<long>"
EDIT = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Token counts of words, merged a batch at a time; what was merged is remembered, within a bound."""

    def __init__(self, spec: dict, remembered: int = 200_000):
        self.split, self.merge, self.special = Splitter(spec["special"]), Merger(spec), spec["special"]
        self.remembered, self.known = remembered, {}
        self.context = max([LOOK, *(len(s) for s in self.special)]) + LOOK

    def learn(self, words) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > self.remembered:
            self.known, fresh = {}, list(words)
        at, _ = self.merge([w.encode() for w in fresh])
        self.known.update(zip(fresh, np.diff(at).tolist()))
        self.known.update((s, 1) for s in self.special)

    def counts(self, words: list[str]) -> list[int]:
        try:
            return [self.known[w] for w in words]
        except KeyError:
            self.learn(set(words))
            return [self.known[w] for w in words]


def segments(words: list[str], counts: list[int]) -> tuple[list[int], list[int]]:
    """Characters and tokens of runs of words."""
    chars, tokens, size, n = [], [], 0, 0
    for w, c in zip(words, counts):
        size += len(w)
        n += c
        if size >= SEGMENT:
            chars.append(size)
            tokens.append(n)
            size = n = 0
    if size:
        chars.append(size)
        tokens.append(n)
    return chars, tokens


def tree(tokens: list[int]) -> list[int]:
    """The levels above the segments, each with the sums of ``FAN`` nodes below, the root last."""
    out, level = [], tokens
    while True:
        level = [sum(level[i:i + FAN]) for i in range(0, len(level), FAN)] or [0]
        out += level
        if len(level) == 1:
            return out


def total(sums: list[int]) -> int:
    return sums[-1]


def path_update(tokens: list[int], sums: list[int], changed: list[int]) -> list[int]:
    """Sums after the given segments changed their counts, their number unchanged: only their paths are redone."""
    sums, below, base, size = list(sums), tokens, 0, len(tokens)
    while True:
        changed = sorted({i // FAN for i in changed})
        width = max(1, -(-size // FAN))
        for i in changed:
            sums[base + i] = sum(below[i * FAN:(i + 1) * FAN])
        if width == 1:
            return sums
        below, size, base = sums[base:base + width], width, base + width


class Edit(NamedTuple):
    """What an edit leaves to be counted: the text after it, the words to encode and the segments they replace."""
    text: str
    words: list[str]
    first: int
    last: int
    encoded: int


def place_edit(counter: Counter, text: str, chars: list[int], start: int, end: int, new: str) -> Edit:
    """Splits what ``text[start:end]`` becoming ``new`` touches, and no more."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    bounds = np.concatenate([[0], np.cumsum(chars)]).astype(np.int64)
    first = int(np.searchsorted(bounds, max(0, start - counter.context), "right")) - 1 if chars else 0
    first = min(first, max(0, len(chars) - 1))
    begin = int(bounds[first]) if chars else 0
    after, shift = text[:start] + new + text[end:], len(new) - (end - start)
    tail = int(np.searchsorted(bounds, end))
    old_starts = {b + shift: i for i, b in enumerate(bounds[tail:].tolist(), tail)}
    last, stop = len(chars), len(after)
    # encode a little past the edit, and on only while no word ends where an old segment began
    reach = start + len(new) + counter.context + SEGMENT
    while True:
        upto = min(len(after), reach)
        cut = upto < len(after)
        words, at = counter.split(after[begin:upto]), begin
        found = None
        for k, w in enumerate(words):
            if k and at >= start + len(new) and at in old_starts:
                found = (k, at)
                break
            at += len(w)
            if cut and at > upto - counter.context:            # words near the cut may go on beyond it
                break
        if found:
            words, stop = words[:found[0]], found[1]
            last = old_starts[stop]
            break
        if not cut:
            break
        reach = begin + 2 * (reach - begin)
    return Edit(after, words, first, last, stop - begin)


def count_edit(counter: Counter, made: Edit, chars: list[int], tokens: list[int], sums: list[int]):
    """The document's segments and sums with the edit's words counted."""
    fresh = segments(made.words, counter.counts(made.words))
    made_chars = chars[:made.first] + fresh[0] + chars[made.last:]
    made_tokens = tokens[:made.first] + fresh[1] + tokens[made.last:]
    if len(made_tokens) == len(tokens):
        moved = list(range(made.first, made.first + len(fresh[1])))
        sums = path_update(made_tokens, sums, moved) if moved else sums
    else:
        sums = tree(made_tokens)
    return made.text, made_chars, made_tokens, sums


def edit(counter: Counter, text: str, chars: list[int], tokens: list[int], sums: list[int], start: int, end: int,
         new: str) -> tuple[str, list[int], list[int], list[int], int]:
    """The document after ``text[start:end]`` became ``new``; and how many characters were encoded for it."""
    made = place_edit(counter, text, chars, start, end, new)
    return *count_edit(counter, made, chars, tokens, sums), made.encoded


def build(docs: DataFrame, path: str, *more: str) -> DataFrame:
    """``doc_id, text, chars, tokens, sums`` (and columns ``more``): the tree of each row of ``docs``.

    A null or empty text has no segments and a root of 0.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    kinds = dict(docs.dtypes)
    schema = ", ".join([TREE, *(f"{c} {kinds[c]}" for c in more)])

    def run(batches):
        counter = Counter(spec.value)
        for batch in texts(batches, 2 << 20):
            split = [counter.split(t or "") for t in batch.column("text").to_pylist()]
            number = Numbering()
            for words in split:
                for w in words:
                    number[w]
            counter.learn(number)
            made = [segments(w, counter.counts(w)) for w in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array([m[0] for m in made], pa.list_(pa.int32())),
                 pa.array([m[1] for m in made], pa.list_(pa.int32())),
                 pa.array([tree(m[1]) for m in made], pa.list_(pa.int64())), *(batch.column(c) for c in more)],
                names=["doc_id", "text", "chars", "tokens", "sums", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """Trees (with a column ``edits``) after their edits, in order: each edit's places are those of the text before it.

    ``doc_id, text, chars, tokens, sums, n_tokens_before, n_tokens, n_encoded``;
    places beyond the text are taken to its end, a null replacement is empty, a
    null or empty list changes nothing.
    """
    spec = trees.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        counter = Counter(spec.value)
        for batch in texts(batches, 2 << 20):
            given = batch.to_pylist()
            states = [(r["text"] or "", r["chars"], r["tokens"], r["sums"]) for r in given]
            todo = [[e for e in r["edits"] or () if e is not None] for r in given]
            encoded = [0] * len(given)
            # the first edits of all documents, then the second ones: words are merged for all together
            for turn in range(max(map(len, todo), default=0)):
                made = {i: place_edit(counter, *states[i][:2], e[turn]["start"] or 0, e[turn]["end"] or 0, e[turn]["text"] or "")
                        for i, e in enumerate(todo) if turn < len(e)}
                counter.learn({w for m in made.values() for w in m.words})
                for i, m in made.items():
                    states[i] = count_edit(counter, m, *states[i][1:])
                    encoded[i] += m.encoded
            rows = [(r["doc_id"], *state, total(r["sums"]), total(state[3]), n) for r, state, n in zip(given, states, encoded)]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())],
                     pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "text", "chars", "tokens", "sums", "n_tokens_before", "n_tokens", "n_encoded"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return trees.select("doc_id", "text", "chars", "tokens", "sums", "edits").mapInArrow(
        run, TREE + ", n_tokens_before long, n_tokens long, n_encoded long")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits of a table ``doc_id, seq, start, end, text``, in order of ``seq``.

    Edits without an id, or of an id without a tree, change nothing; a tree
    without edits stays as it is; rows that share an id each get its edits.
    """
    each = F.struct("seq", "start", "end", "text")
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("e")).select(
        "doc_id", F.transform("e", lambda x: F.struct(x["start"], x["end"], x["text"])).cast(EDIT).alias("edits"))
    return trees.join(lists, "doc_id", "left")


@query("op5_token_counts")
def op5(spark, sf):
    """Every document counted, then counted again after three edits that its own row gives."""
    docs = read(spark, sf, "documents")
    size = F.coalesce(F.length("text"), F.lit(0))
    place = F.pmod(F.xxhash64("doc_id"), size + 1).cast("int")
    def at(start, end, text):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))
    source = F.coalesce(F.col("source"), F.lit(""))
    edits = F.array(at(place, place + 12, F.concat(F.lit(" edited by "), source, F.lit("'s 2nd pass.\n"))),
                    at(F.lit(0), F.lit(0), F.concat(source, F.lit(": "))),
                    at(place / 2, place / 2 + 40, F.lit("")))
    trees = build(docs.withColumn("edits", edits), vocabulary(), "edits")
    return apply_edits(trees, vocabulary()).select(
        "doc_id", "n_tokens_before", "n_tokens", F.size("tokens").cast("long").alias("n_segments"), "n_encoded")
