"""Benchmark decontamination through an FM-index of every training shard.

Tasks gather documents into shards of a bounded number of words and index each
shard's word sequence: a suffix array gives the Burrows-Wheeler transform, kept
as a wavelet matrix, whose ranks answer a backward search of all benchmark
windows at once. Occurrences are located by walking back to sampled suffix
positions, and each document's hits are merged into spans to remove.

The alphabet is the benchmark's: a run of words that no benchmark text holds
breaks every match, so it is one separator in the index. The benchmark travels
to the tasks in blocks of proven size; each shard is searched with every block.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import DOCUMENT, DOCUMENT_COLUMNS, WORD_BYTES, read, utf8
from .common import texts as text_batches
from .registry import query

WINDOW = 10
SHARD_WORDS = 1 << 20        # words in a shard (a longer document is a shard of its own)
BLOCK_BYTES = 16 << 20       # benchmark text in a broadcast block
SAMPLED = 32                 # one suffix position in so many is kept
# symbols: the shard's end, once, below all others; a document's end; a run of
# words that no item holds; the benchmark's words
LAST, END, OTHER, FIRST_WORD = 0, 1, 2, 3


class Block(NamedTuple):
    """Windows of some benchmark items."""
    ids: dict[bytes, int]            # word -> symbol
    windows: np.ndarray              # a row for each distinct window, zero-padded on the left
    size: np.ndarray
    item_at: np.ndarray              # ragged: the items that hold each window
    items: np.ndarray
    names: list[str | None]


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def make_block(items: list[tuple], width: int = WINDOW) -> Block:
    """Items are (id, text); a null text has no words, a null id is searched but not named."""
    ids: dict[bytes, int] = {}
    held: dict[tuple, set[int]] = {}
    names = sorted({None if i is None else str(i) for i, _ in items}, key=lambda x: (x is not None, x))
    number = {n: k for k, n in enumerate(names)}
    for item, text in items:
        symbols = [ids.setdefault(w, len(ids) + FIRST_WORD) for w in words_of((text or "").encode())]
        which = number[None if item is None else str(item)]
        for i in range(max(1, len(symbols) - width + 1) if symbols else 0):
            held.setdefault(tuple(symbols[i:i + width]), set()).add(which)
    windows = np.zeros((len(held), width), np.int64)
    for k, w in enumerate(held):
        windows[k, width - len(w):] = w
    size = np.fromiter(map(len, held), np.int64, len(held))
    at = np.concatenate([[0], np.cumsum([len(v) for v in held.values()])]).astype(np.int64)
    return Block(ids, windows, size, at, np.array([i for v in held.values() for i in sorted(v)], np.int64), names)


def blocks(benchmark: DataFrame, width: int = WINDOW) -> list:
    """The benchmark as broadcasts (plain tuples) of about ``BLOCK_BYTES`` of text each, one in the driver's memory at a time."""
    sc, out, part, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        part.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= BLOCK_BYTES:
            out.append(sc.broadcast(tuple(make_block(part, width))))
            part, size = [], 0
    if part:
        out.append(sc.broadcast(tuple(make_block(part, width))))
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; from the second round on, only suffixes not yet told apart are sorted.

    Sorts packed integers (class, class ahead, position), which bounds a shard
    to 2**21 symbols; longer ones are sorted by index instead.
    """
    n = len(s)
    packs = n < 1 << 21
    order = np.argsort(s, kind="stable")
    new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))        # a class is named by its first place
    ahead = 1
    while True:
        edge = np.concatenate([new, [True]])
        tied = np.flatnonzero(~(edge[:-1] & edge[1:]))                         # places in classes of two and more
        if not len(tied):
            return order
        at = order[tied]
        follow = np.where(at + ahead < n, rank[np.minimum(at + ahead, n - 1)] + 1, 0)
        own = rank[at]
        if packs:
            key = np.sort(own << 42 | follow << 21 | at)
            at, pair = key & (1 << 21) - 1, key >> 21
        else:
            by = np.lexsort((at, follow, own))
            at, pair = at[by], own[by] * (n + 1) + follow[by]
        order[tied] = at
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[tied] = first
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
        ahead *= 2


class Ranked:
    """A bit sequence with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.zeros = n - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Backward search and location over one shard's symbols (``LAST`` closes them and stands nowhere else)."""

    def __init__(self, s: np.ndarray, symbols: int):
        order = suffix_array(s)
        last = s[order - 1]                                    # the first suffix wraps to LAST
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        self.levels, left = [], last
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (left >> bit & 1) == 1
            self.levels.append((bit, Ranked(ones)))
            left = np.concatenate([left[~ones], left[ones]])
        self.base = self._down(np.arange(symbols), np.zeros(symbols, np.int64))
        keep = order % SAMPLED == 0
        self.kept, self.sample = Ranked(keep), order[keep]
        self.n = len(s)

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, level in self.levels:
            ones = level.ones(place)
            place = np.where(symbol >> bit & 1 == 1, level.zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        return self._down(symbol, place) - self.base[symbol]

    def symbol(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for bit, level in self.levels:
            ones, one = level.ones(place), level.at(place)
            out |= one.astype(np.int64) << bit
            place = np.where(one, level.zeros + ones, place - ones)
        return out

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix-array interval of each zero-padded window, from its last word to its first."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((windows[:, k] != LAST) & (low < high))
            if len(live):
                c = windows[live, k]
                low[live] = self.before[c] + self.rank(c, low[live])
                high[live] = self.before[c] + self.rank(c, high[live])
        return low, high

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array places: walk back to a sampled one."""
        place, steps = place.copy(), np.zeros(len(place), np.int64)
        out, live = np.empty(len(place), np.int64), np.arange(len(place))
        while len(live):
            done = self.kept.at(place[live])
            hit = live[done]
            out[hit] = self.sample[self.kept.ones(place[hit])] + steps[hit]
            live = live[~done]
            c = self.symbol(place[live])
            place[live] = self.before[c] + self.rank(c, place[live])
            steps[live] += 1
        return out


HITS = 1 << 20               # occurrences located at once


def search_shard(docs: list[list[bytes]], block: Block) -> tuple[list, set[tuple[int, str]]]:
    """(document, first word, past the last word) of merged hits, and (document, item) pairs."""
    get, parts = block.ids.get, []
    for words in docs:
        parts.append(np.fromiter((get(w, OTHER) for w in words), np.int64, len(words)))
        parts.append(np.array([END]))
    flat = np.concatenate([*parts, [LAST]])
    # a run of other words is one separator; places keep their word numbers
    keep = np.flatnonzero((flat != OTHER) | (np.concatenate([[END], flat[:-1]]) != OTHER))
    index = FMIndex(flat[keep], len(block.ids) + FIRST_WORD)
    low, high = index.search(block.windows)
    found = np.flatnonzero(high > low)
    cover, pairs = np.zeros(len(flat) + 1, np.int64), set()
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    count = high[found] - low[found]
    ends = np.cumsum(count)
    for a in range(0, int(ends[-1]) if len(ends) else 0, HITS):
        nth = np.arange(a, min(a + HITS, int(ends[-1])))
        of = np.searchsorted(ends, nth, "right")
        which = found[of]
        at = keep[index.locate(low[which] + nth - (ends[of] - count[of]))]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.size[which], -1)
        doc = np.searchsorted(starts, at, "right") - 1
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            pairs.update((d, block.names[i]) for i in block.items[block.item_at[w]:block.item_at[w + 1]].tolist()
                         if block.names[i] is not None)
    inside = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    spans = []
    for a, b in edge.reshape(-1, 2).tolist():
        d = int(np.searchsorted(starts, a, "right")) - 1
        spans.append((d, a - int(starts[d]), b - int(starts[d])))
    return spans, pairs


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def byte_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as byte intervals, from the first word's start to the last one's end."""
    is_word = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]))).reshape(-1, 2)
    return [(int(edge[a, 0]), int(edge[b - 1, 1])) for a, b in spans]


def shards(batches):
    """Rows of the batches with their words, in lists of bounded size."""
    held, size = [], 0
    for batch in batches:
        for row, raw in zip(batch.to_pylist(), utf8(batch.column("text"))):
            words = words_of(raw)
            if held and size + len(words) > SHARD_WORDS:
                yield held
                held, size = [], 0
            held.append((row, raw, words))
            size += len(words) + 1
    if held:
        yield held


def find(held: list, parts: list) -> tuple[list, list]:
    """For each row of a shard: merged word spans and the names of items found, over all blocks."""
    spans, items = [[] for _ in held], [set() for _ in held]
    for part in parts:
        block = Block(*part.value)
        if len(block.windows):
            hits, pairs = search_shard([w for _, _, w in held], block)
            for d, a, b in hits:
                spans[d].append((a, b))
            for d, name in pairs:
                items[d].add(name)
    return [merge(s) for s in spans], items


def scan(docs: DataFrame, benchmark: DataFrame, with_spans: bool = True) -> DataFrame:
    """Hits of each row of ``docs``.

    ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, and with
    ``with_spans`` the ``items`` found and the byte ``spans`` to remove. Null
    and empty texts, of either table, have no words: such a document is clean
    and such an item finds nothing, as does an empty benchmark. Repeated rows
    are searched each; items that share an id count once.
    """
    parts = blocks(benchmark)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if with_spans:
        schema += ", items array<string>, spans array<struct<start:long,end:long>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for held in shards(text_batches(batches)):
            spans, items = find(held, parts)
            hit = [sum(b - a for a, b in s) for s in spans]
            named = [sorted(i) for i in items]
            cols = [pa.array([r["doc_id"] for r, _, _ in held], pa.int64()),
                    pa.array([len(w) for _, _, w in held], pa.int64()), pa.array(hit, pa.int64()),
                    pa.array([len(i) for i in named], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in named]),
                    pa.array([h > 0 for h in hit])]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if with_spans:
                cols += [pa.array(named, pa.list_(pa.string())),
                         pa.array([[{"start": a, "end": b} for a, b in byte_spans(raw, s)] if s else []
                                   for (_, raw, _), s in zip(held, spans)], kind)]
                names += ["items", "spans"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the benchmark's passages; rows, and texts without hits, stay as they are.

    A removed passage leaves a line break, and the text is searched again until
    nothing is found, since what stood on its sides may now read on. Null and
    empty texts stay, as all do where the benchmark is empty; repeated rows are
    each cleaned.
    """
    parts = blocks(benchmark)

    def run(batches):
        for held in shards(text_batches(batches)):
            todo = list(range(len(held)))
            while todo:
                spans, _ = find([held[i] for i in todo], parts)
                again = []
                for i, found in zip(todo, spans):
                    if found:
                        row, raw, _ = held[i]
                        at, left = 0, []
                        for a, b in byte_spans(raw, found):
                            left.append(raw[at:a])
                            at = b
                        raw = b"\n".join([*left, raw[at:]])
                        text = raw.decode()
                        held[i] = ({**row, "text": text, "n_chars": len(text)}, raw, words_of(raw))
                        again.append(i)
                todo = again
            yield pa.RecordBatch.from_pylist([r for r, _, _ in held], schema=SCHEMA)

    return docs.select(*DOCUMENT_COLUMNS).mapInArrow(run, DOCUMENT)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                    ("n_chars", pa.int64())])

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH
  d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b
    WHERE len(w) > 0))),
  sizes AS (SELECT DISTINCT n FROM windows),
  places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
  hits AS (SELECT r, i, p.n, item_id FROM places p JOIN windows USING (n, win)),
  covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hits) GROUP BY r),
  items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (
    SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""


@query("op1_decontaminate", SQL)
def op1(spark, sf):
    return scan(read(spark, sf, "documents"), read(spark, sf, "benchmark"), with_spans=False)
