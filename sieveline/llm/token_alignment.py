"""Alignment of two tokenizers over a corpus, with corpus-wide counts of token pairs.

Two tokenizations of a text are aligned at the byte offsets where tokens of both
end. Each such place links the two tokens that end there. How often a pair of
ids is linked in the whole corpus, and whether that is the most for its id of
the second tokenizer, takes a count over all links:

* tasks gather blocks of documents and sort their pair-document records by
  second id, first id and document. Records stay in their block; its distinct
  pairs, with the links each has there, are cut by radix of the second id into
  compressed runs.
* a task takes the runs of one radix and merges them with a heap. The order is
  by second id, so once an id's pairs have passed, its maximum is known, and
  every run is told the totals of the pairs it brought.
* a block's totals come back to it and are summed for its documents.

A run holds a pair once, however often it is linked, so a pair that makes a
third of all links weighs no more than others. Runs are merged ``FAN`` at a time
in as many levels as that takes, and totals go down the same levels.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import settle

from .bpe import SPLIT, byte_letters, spread, vocabulary
from .common import read
from .common import texts as text_batches
from .registry import query

PIECE = 1 << 20              # bytes of a text tokenized at once, about: longer ones are cut between words
LINKS = 2_000_000            # records of a block, about, and
DOCS = 100_000               # its documents, at most
RADICES = 64
FAN = 128                    # runs merged by one heap
A_BITS = 24                  # of a pair's key, for the first id

SPACE = "▁"             # stands for a space in the second vocabulary
BLOCK = "block long, doc_ids binary, figures binary, digests binary, body binary, runs array<binary>"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unsqueeze(raw: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class ByteLevel:
    """The byte-level BPE of a vocabulary file. Special tokens in a text are plain text."""

    def __init__(self, spec: str):
        import public_tokenizers
        import tiktoken
        made = json.loads(spec)
        letters, special = byte_letters(), {t["content"] for t in made["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(SPLIT).findall
        self.bytes = [b""] * (max(made["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.own.encode_to_numpy(text, disallowed_special=())
        except ValueError:                             # a run of white space beyond the pattern matcher's stack
            return np.fromiter((i for w in self.split(text) for i in self.own._encode_single_piece(w)), np.uint32)


class Pieces:
    """The piece BPE of a model, whose encoder puts a space before a text."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(self.own.get_piece_size()):
            piece = self.own.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.own.is_byte(i) else piece.replace(SPACE, " ").encode())

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.own.encode(texts, num_threads=1)]


def vocabularies(a: str | None = None, b: str | None = None) -> tuple[str, bytes]:
    """The contents of both vocabulary files, read by the driver. Each is a few megabytes, whatever the corpus."""
    if b is None:
        import public_tokenizers
        b = public_tokenizers.path("piece_bpe_32k.model")
    with open(a or vocabulary(), encoding="utf-8") as f, open(b, "rb") as g:
        return f.read(), g.read()


# A place where both tokenizers start a token: a space between two letters.
BETWEEN = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def cut(text: str, size: int) -> list[str]:
    """A text in pieces of ``size`` characters or somewhat more, cut where neither tokenizer joins; all but the first start with a space."""
    at, out = 0, []
    while len(text) - at > size and (m := BETWEEN.search(text, at + size)):
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


class Aligner:
    """Pieces of texts to groups and links."""

    def __init__(self, spec: str, model: bytes):
        self.sides = ByteLevel(spec), Pieces(model)
        self.size = [np.array([len(x) for x in s.bytes], np.int64) for s in self.sides]
        self.at = [np.concatenate([[0], np.cumsum(n)]) for n in self.size]
        self.flat = [np.frombuffer(b"".join(s.bytes), np.uint8) for s in self.sides]
        # an id as it is written: followed by a comma, or by what ends its side of a group
        self.said = [np.array([f"{i}{end}".encode() for end in (",", last) for i in range(len(s.bytes))], object)
                     for s, last in zip(self.sides, ("|", ";"))]

    def __call__(self, pieces: list[str]):
        """For each piece, which starts with a space: whether its bytes come back, tokens of either side, groups, and the
        groups as written; and for all links, in order, their piece, first and second id."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(x) for x in raw], np.int64)
        got = self.sides[0](pieces), self.sides[1]([p[1:] for p in pieces])
        good = np.ones(len(pieces), bool)
        ids, owner, count = [], [], []
        for side, made in enumerate(got):
            n = np.array([len(x) for x in made], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint32), *made]).astype(np.int64)
            at, end = spread(self.at[side], flat)
            back = self.flat[side][at].tobytes()
            ends = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])].tolist()
            good &= np.array([back[x:y] == r for x, y, r in zip(ends, ends[1:], raw)], bool)
            ids.append(flat), count.append(n), owner.append(np.repeat(np.arange(len(pieces)), n))
        keep = [good[o] for o in owner]
        ids, owner = [x[k] for x, k in zip(ids, keep)], [x[k] for x, k in zip(owner, keep)]
        count = [np.where(good, n, 0) for n in count]
        ends = [np.cumsum(self.size[s][ids[s]]) for s in (0, 1)]          # both count the same bytes
        flags = [np.zeros(int(size[good].sum()) + 1, bool) for _ in ends]
        for f, e in zip(flags, ends):
            f[e] = True
        last = [flags[1][ends[0]], flags[0][ends[1]]]                     # whether a token ends a group
        ia, ib = (np.flatnonzero(x) for x in last)
        group = [np.cumsum(x) - x for x in last]
        place = [np.arange(len(ids[0])) + np.concatenate([[0], ib + 1])[group[0]], np.arange(len(ids[1])) + (ia + 1)[group[1]]]
        words = np.empty(len(ids[0]) + len(ids[1]), object)
        for s in (0, 1):
            words[place[s]] = self.said[s][ids[s] + last[s] * len(self.size[s])]
        upto = np.concatenate([[0], np.cumsum(count[0] + count[1])]).tolist()
        said = [b"".join(words[x:y].tolist()) for x, y in zip(upto, upto[1:])]
        groups = np.bincount(owner[0][ia], minlength=len(pieces))
        return good, count[0], count[1], groups, said, owner[0][ia], ids[0][ia], ids[1][ib]


class Gatherer:
    """Documents in, blocks out."""

    def __init__(self, align: Aligner, radices: int, links: int):
        self.align, self.radices, self.limit = align, radices, links
        self.made = 0
        self.clear()

    def clear(self):
        self.rows: list[list] = []                     # doc_id, good, n_a, n_b, groups, digest
        self.links: list[tuple] = []
        self.held = 0
        self.pieces: list[tuple[int, str]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None):
        self.rows.append([doc_id, bool(text), 0, 0, 0, hashlib.sha256()])
        if text:
            for piece in cut(" " + text, PIECE):
                self.pieces.append((len(self.rows) - 1, piece))
                self.size += len(piece)
                if self.size >= PIECE:
                    self.settle()

    def settle(self):
        """Aligns the pieces held so far."""
        if not self.pieces:
            return
        good, na, nb, groups, said, owner, a, b = self.align([p for _, p in self.pieces])
        rows = np.array([i for i, _ in self.pieces])
        for i, ok, x, y, g, s in zip(rows.tolist(), good.tolist(), na.tolist(), nb.tolist(), groups.tolist(), said):
            row = self.rows[i]
            row[1] &= ok
            row[2] += x
            row[3] += y
            row[5].update(b";" * (row[4] > 0) + s[:-1])
            row[4] += g
        self.links.append((b << A_BITS | a, rows[owner].astype(np.int32)))
        self.held += len(a)
        self.pieces, self.size = [], 0

    def full(self) -> bool:
        return self.held >= self.limit or len(self.rows) >= DOCS

    def block(self) -> pa.RecordBatch:
        self.settle()
        good = np.array([r[1] for r in self.rows])
        key, row = (np.concatenate(c) for c in zip(*self.links)) if self.links else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        key, row = key[good[row]], row[good[row]]                        # no links of a text that doesn't come back
        pairs, which = np.unique(key, return_inverse=True)
        # (radix, second id, first id) is the order of runs
        radix = (pairs >> A_BITS) % self.radices
        order = np.argsort(radix, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        record, times = np.unique(row.astype(np.int64) << 32 | rank[which], return_counts=True)
        per_doc = np.bincount(record >> 32, minlength=len(self.rows))
        total = np.bincount(rank[which], minlength=len(pairs))
        bounds = np.searchsorted(radix[order], np.arange(self.radices + 1)).tolist()
        runs = [squeeze(np.stack([pairs[order[x:y]], total[x:y]])) if y > x else None for x, y in zip(bounds, bounds[1:])]
        figures = np.array([[r[2], r[3], r[4]] if r[1] else [0, 0, 0] for r in self.rows], "<i8").reshape(-1, 3)
        digests = b"".join(r[5].digest() if r[1] else bytes(32) for r in self.rows)
        ids = np.array([[0, 1] if r[0] is None else [r[0], 0] for r in self.rows], "<i8").reshape(-1, 2)
        body = squeeze(np.concatenate([per_doc, record & 0xFFFFFFFF, times]).astype("<i8"))
        number, self.made = (TaskContext.get().partitionId() << 32) + self.made, self.made + 1
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (squeeze(ids), squeeze(figures), digests, body)),
             pa.array([runs], pa.list_(pa.binary()))], names=[f.split()[0] for f in BLOCK.split(", ")])


def blocks(docs: DataFrame, files: tuple[str, bytes], radices: int = RADICES, links: int = LINKS) -> DataFrame:
    """Documents aligned, in blocks with their records and runs."""
    held = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        gather = Gatherer(Aligner(*held.value), radices, links)
        for batch in text_batches(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                gather.add(i, text.as_py())
                if gather.full():
                    yield gather.block()
        if gather.rows:
            yield gather.block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


def pairs_of(run: bytes) -> tuple[list[int], list[int]]:
    got = unsqueeze(run).reshape(2, -1)
    return got[0].tolist(), got[1].tolist()


def merge(runs: list[bytes]):
    """Each second id of sorted runs, in order: its pairs, as (key, links in all runs, [runs that hold it])."""
    def walk(number: int, run: bytes):
        for key, n in zip(*pairs_of(run)):
            yield key, number, n

    side, held = None, []
    for key, number, n in heapq.merge(*(walk(i, r) for i, r in enumerate(runs))):
        if held and held[-1][0] == key:
            held[-1][1] += n
            held[-1][2].append(number)
            continue
        if side != key >> A_BITS:
            if held:
                yield held
            side, held = key >> A_BITS, []
        held.append([key, n, [number]])
    if held:
        yield held


def told(runs: list[bytes]) -> list[bytes]:
    """For each run the totals of its pairs, in its order, and whether each is the highest of its second id."""
    total: list[list[int]] = [[] for _ in runs]
    best: list[list[bool]] = [[] for _ in runs]
    for pairs in merge(runs):
        most = max(n for _, n, _ in pairs)
        for _, n, holders in pairs:
            for i in holders:
                total[i].append(n)
                best[i].append(n == most)
    return [squeeze(np.array([t, b], "<i8")) for t, b in zip(total, best)]


def merged(runs: list[bytes]) -> bytes:
    """One run of all pairs of ``runs``."""
    flat = [(key, n) for pairs in merge(runs) for key, n, _ in pairs]
    return squeeze(np.array(flat, "<i8").reshape(-1, 2).T.copy())


ANSWER = "radix int, run long, told binary"


def totals(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """``radix, run, told``: what each of ``runs`` (``radix, run, pairs``) is told about its pairs.

    Up to ``fan`` runs of a radix are merged by one task. More are merged in
    groups first; the groups' runs are told, and tell their own members.
    """
    most = runs.groupBy("radix").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def answer(table: pa.Table, said: list[bytes]) -> pa.Table:
        return pa.table([table.column("radix"), table.column("run"), pa.array(said, pa.binary())], names=["radix", "run", "told"])

    if most <= fan:
        return runs.groupBy("radix").applyInArrow(lambda t: answer(t, told(t.column("pairs").to_pylist())), ANSWER)

    def up(table: pa.Table) -> pa.Table:
        return pa.table([table.column("radix")[:1], table.column("grp")[:1],
                         pa.array([merged(table.column("pairs").to_pylist())], pa.binary())], names=["radix", "run", "pairs"])

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        keys = unsqueeze(above.column("pairs")[0].as_py()).reshape(2, -1)[0]
        known = unsqueeze(above.column("told")[0].as_py()).reshape(2, -1)
        said = [squeeze(known[:, np.searchsorted(keys, unsqueeze(r).reshape(2, -1)[0])]) for r in table.column("pairs").to_pylist()]
        return answer(table, said)

    grouped = runs.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(-(-most // fan))))
    over = settle(grouped.groupBy("radix", "grp").applyInArrow(up, "radix int, run long, pairs binary"), "pair-runs")
    known = over.join(totals(over, fan), ["radix", "run"]).withColumnRenamed("run", "grp")
    return grouped.groupBy("radix", "grp").cogroup(known.groupBy("radix", "grp")).applyInArrow(down, ANSWER)


def runs_of(made: DataFrame) -> DataFrame:
    return made.select(F.col("block").alias("run"), F.posexplode("runs").alias("radix", "pairs")).filter("pairs IS NOT NULL")


def pair_counts(docs: DataFrame, files: tuple[str, bytes] | None = None, radices: int = RADICES, links: int = LINKS,
                fan: int = FAN) -> DataFrame:
    """``a, b, n, best``: how many links of the corpus hold each pair of ids, and whether no pair of ``b`` has more."""
    runs = runs_of(settle(blocks(docs, files or vocabularies(), radices, links), "pair-blocks"))

    def spell(batches):
        for batch in batches:
            for pairs, said in zip(batch.column("pairs").to_pylist(), batch.column("told").to_pylist()):
                key, (n, best) = unsqueeze(pairs).reshape(2, -1)[0], unsqueeze(said).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(key & (1 << A_BITS) - 1), pa.array(key >> A_BITS), pa.array(n),
                                                  pa.array(best.astype(bool))], names=["a", "b", "n", "best"])

    return runs.join(totals(runs, fan), ["radix", "run"]).select("pairs", "told").mapInArrow(
        spell, "a long, b long, n long, best boolean").distinct()


def align(docs: DataFrame, files: tuple[str, bytes] | None = None, radices: int = RADICES, links: int = LINKS,
          fan: int = FAN) -> DataFrame:
    """Figures of each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    The first tokenizer encodes a space and the text, the second the text.
    Null and empty texts, and texts whose bytes do not come back from the tokens
    of either side, have no tokens: zeros, and '' for the digest. They take no
    part in counts. Repeated rows count as often as they stand; ids may be null
    or repeat. Texts of any length are aligned whole, about a megabyte at a time.
    """
    made = settle(blocks(docs, files or vocabularies(), radices, links), "pair-blocks")
    back = totals(runs_of(made), fan).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("radix", "told"))).alias("told"))

    def finish(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                ids, figures = unsqueeze(r["doc_ids"]).reshape(-1, 2), unsqueeze(r["figures"]).reshape(-1, 3)
                said = [unsqueeze(t["told"]).reshape(2, -1) for t in r["told"] or []]
                n, best = np.concatenate([np.zeros((2, 0), np.int64), *said], 1)
                body = unsqueeze(r["body"])
                per_doc = body[:len(ids)]
                pair, times = body[len(ids):].reshape(2, -1)
                end = np.concatenate([[0], np.cumsum(per_doc)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[end]) for x in (times * best[pair], times * n[pair])]
                digest = [r["digests"][at:at + 32].hex() if g else "" for at, g in zip(range(0, 32 * len(ids), 32), figures[:, 2].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[:, 0], mask=ids[:, 1] > 0), *(pa.array(np.ascontiguousarray(figures[:, k])) for k in (0, 1, 2, 2)),
                     *(pa.array(s) for s in sums), pa.array(digest, pa.string())], names=[f.split()[0] for f in RESULT.split(", ")])

    return made.join(back, made.block == back.run, "left").select("doc_ids", "figures", "digests", "body", "told").mapInArrow(finish, RESULT)


@query("op13_token_alignment")
def op13(spark, sf):
    return align(read(spark, sf, "documents"))
