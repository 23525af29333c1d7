"""Exact top-k inner products by sorted lists without random access.

Vectors are packed into blocks; a block keeps, for every dimension, its rows in
the order of that component. A query reads each list from the end that is best
for it, all lists to the same depth, and keeps for every row a lower bound (its
components read so far, the worst value for the others) and an upper bound (the
last value read for the others). Reading goes on until the rows that can still
be among the k best are few; their final scores are then resolved exactly.

Blocks and tiles of queries meet on keys: each task gets one block and a few
tiles, whatever the table's size, and hands on k rows for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.session import settle

from .common import read
from .registry import query

SCALE = 256
BLOCK = 16_384               # rows of a block, at most
TILE = 128                   # queries that read a block's lists together
TILES = 8                    # tiles (about) that meet a block in one task
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1)     # of the lists, after which bounds are compared
LONGEST = 2 ** 63 - 1
FEW = 1 / 16                 # of a block's rows: so many that can still qualify are resolved

PACKED = "pack long, width int, ids binary, asks binary, vectors binary, lists binary"
TILED = "grp int, width int, packs binary, places binary, ids binary, vectors binary"


def scaled(vectors: DataFrame, column: str, asks: Column) -> DataFrame:
    """``vec_id, x, asks`` of the rows that take part: those with an id and a vector all of whose components are finite numbers."""
    x = F.col(column).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"),
                                       F.coalesce(asks, F.lit(False)).alias("asks"))


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of rows of one length, with the sorted list of each dimension. Ids and vectors are little-endian arrays; components are whole numbers, held as doubles."""
    def run(batches):
        held: dict[int, list] = {}
        made = 0

        def block(width):
            nonlocal made
            ids, asks, x = (np.concatenate(c) for c in zip(*held.pop(width)))
            order = np.argsort(-x, axis=0, kind="stable").T                    # [dimension, place]
            number, made = (TaskContext.get().partitionId() << 32) + made, made + 1
            cells = [number, width, ids.astype("<i8").tobytes(), asks.tobytes(), x.astype("<f8").tobytes(), order.astype("<u2").tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(["pack", "width", "ids", "asks", "vectors", "lists"], cells))], schema=SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = part.column("x")
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                asks = part.column("asks").to_numpy(zero_copy_only=False).astype(np.uint8)
                for width in np.unique(size).tolist():
                    which = np.flatnonzero(size == width)
                    flat = lists.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False)
                    x = np.floor(SCALE * flat.astype(np.float64)).reshape(len(which), width)
                    held.setdefault(width, []).append((ids[which], asks[which], x))
                    if sum(len(h[0]) for h in held[width]) > BLOCK - 2048:
                        yield block(width)
                while sum(len(h[0]) for own in held.values() for h in own) > BLOCK:        # many lengths at once
                    yield block(max(held, key=lambda w: sum(len(h[0]) for h in held[w])))
        for width in list(held):
            yield block(width)

    SCHEMA = pa.schema([("pack", pa.int64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "asks", "vectors", "lists"))])
    return rows.mapInArrow(run, PACKED)


def tiles(packs: DataFrame) -> tuple[DataFrame, int]:
    """The queries of all blocks, ``TILE`` together, each with the place of its own row; and how many groups of tiles (``grp``) there are at most."""
    def asked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["asks"], np.uint8))
                x = np.frombuffer(r["vectors"], "<f8").reshape(len(r["asks"]), r["width"])
                ids = np.frombuffer(r["ids"], "<i8")[at]
                for a in range(0, len(at), TILE):
                    b = slice(a, a + TILE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at[b]), r["pack"])), pa.array(at[b]), pa.array(ids[b]),
                         pa.array(np.full(len(at[b]), r["width"], np.int32)), pa.array([v.tobytes() for v in x[at[b]]], pa.binary())],
                        names=["pack", "place", "vec_id", "width", "x"])

    def gather(batches):
        held: dict[int, list] = {}

        def tile(width):
            packs_, places, ids, vectors = zip(*held.pop(width))
            arrays = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([width], pa.int32()),
                      *(pa.array([np.array(c, "<i8").tobytes()], pa.binary()) for c in (packs_, places, ids)),
                      pa.array([b"".join(vectors)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["grp", "width", "packs", "places", "ids", "vectors"])

        for batch in batches:
            for p, place, i, width, x in zip(*(batch.column(c).to_pylist() for c in ("pack", "place", "vec_id", "width", "x"))):
                own = held.setdefault(width, [])
                own.append((p, place, i, x))
                if len(own) == TILE:
                    yield tile(width)
        for width in list(held):
            yield tile(width)

    found = settle(packs.select("pack", "width", "ids", "asks", "vectors").mapInArrow(
        asked, "pack long, place long, vec_id long, width int, x binary"), "topk-queries")
    parts = -(-found.count() // (TILES * TILE)) or 1
    return found.repartition(parts, "pack", "place").mapInArrow(gather, TILED), parts


class Block:
    """A block's rows and lists, as a reader of both ends of every list sees them."""

    def __init__(self, width: int, ids: bytes, vectors: bytes, lists: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.n, self.width = len(self.ids), width
        self.x = np.frombuffer(vectors, "<f8").reshape(self.n, width)
        down = np.frombuffer(lists, "<u2").reshape(width, self.n).astype(np.intp)
        value = np.take_along_axis(self.x.T, down, 1)
        # [end, dimension, depth]: the row read there and its component
        self.rows, self.values = np.stack([down, down[:, ::-1]]), np.stack([value, value[:, ::-1]])
        self.most = float(np.abs(value).max()) if value.size else 0.0
        self.unread: dict[int, np.ndarray] = {}

    def left(self, depth: int) -> np.ndarray:
        """[end * dimension, row]: 1 where that list has not shown the row by ``depth``."""
        if depth not in self.unread:
            open_ = np.zeros((2, self.width, self.n))
            np.put_along_axis(open_, self.rows[:, :, depth:], 1.0, 2)
            self.unread[depth] = open_.reshape(2 * self.width, self.n)
        return self.unread[depth]

    def resolve(self, can: np.ndarray, q: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and final scores of the k best of the rows ``can``."""
        if whole:
            score = (self.x[can] @ q).astype(np.int64)
        else:
            by = [int(v) for v in q]
            exact = [sum(int(a) * b for a, b in zip(row, by)) for row in self.x[can].tolist()]
            score = np.array([max(-LONGEST, min(LONGEST, s)) for s in exact], np.int64)
        best = np.lexsort((self.ids[can], -score))[:k]
        return self.ids[can][best], score[best]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int):
        """For each query the rows that can be among its k best, and their exact scores; ``own`` is a row to leave out, or -1."""
        n, every = self.n, np.arange(self.width)
        bound = float(np.abs(queries).max(initial=0)) * self.most * max(1, self.width)
        whole = bound < 2.0 ** 53                                        # doubles hold every sum exactly
        slack = 0.0 if whole else bound * 2.0 ** -40
        out: list = [None] * len(queries)
        if not bound < 2.0 ** 1000:                                      # no bounds to compare: every row can qualify
            return [self.resolve(np.flatnonzero(np.arange(n) != o), q, k, False) for q, o in zip(queries, own)]
        q = queries
        end = (queries < 0).astype(np.intp)
        worst = self.values[end, every, -1] * q                          # [query, dimension]
        low = np.repeat(worst.sum(1)[:, None], n, 1)
        active, read_to = np.arange(len(q)), 0
        for share in DEPTHS:
            depth = min(n, max(read_to + 1, int(n * share)))
            for i in active.tolist():
                rows = self.rows[end[i], every, read_to:depth]
                gain = self.values[end[i], every, read_to:depth] * q[i][:, None]
                gain -= worst[i][:, None]
                low[i] += np.bincount(rows.ravel(), gain.ravel(), n)
            read_to = depth
            if depth == n:
                high = low[active]
            else:
                spread = self.values[end[active], every, depth] * q[active] - worst[active]
                both = np.zeros((len(active), 2, self.width))
                both[np.arange(len(active))[:, None], end[active], every] = spread
                high = low[active] + both.reshape(len(active), -1) @ self.left(depth)
            going = []
            for i, up in zip(active.tolist(), high):
                seen = low[i].copy()
                if own[i] >= 0:
                    seen[own[i]], up[own[i]] = -np.inf, -np.inf
                least = np.partition(seen, n - k)[n - k] if n > k else -np.inf
                can = np.flatnonzero((up >= least - 2 * slack) & (up > -np.inf))
                if depth == n or len(can) <= max(4 * k, n * FEW):
                    out[i] = self.resolve(can, q[i], k, whole)
                else:
                    going.append(i)
            active = np.array(going, np.intp)
            if not len(active):
                break
        return out


def top_k(vectors: DataFrame, asks: Column, k: int = 5, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each row where ``asks`` is true.

    Components become floor(256 * x); the score is their integer inner product,
    ties go to the smaller id. A query's own row is no candidate; another row
    with its id is, and repeated rows are each a query and a candidate. Rows
    without an id, and null vectors or such with a null or non-finite
    component, take no part; vectors of other lengths than the query's are no
    candidates for it. Fewer candidates than k are all returned; a query
    without any has no row. An inner product beyond a long counts as the largest long
    (or as its negative).
    """
    packs = settle(pack(scaled(vectors, column, asks)), "topk-packs")
    tiled, groups = tiles(packs)
    wanted = settle(tiled, "topk-tiles").join(packs.select(F.col("pack").alias("block"), "width"), "width")
    left = packs.drop("asks").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for b in blocks.to_pylist():
            block = Block(b["width"], b["ids"], b["vectors"], b["lists"])
            for t in asked.to_pylist():
                from_, place, ids = (np.frombuffer(t[c], "<i8") for c in ("packs", "places", "ids"))
                q = np.frombuffer(t["vectors"], "<f8").reshape(len(ids), t["width"])
                own = np.where(from_ == b["pack"], place, -1)
                for p, at, i, (v, score) in zip(from_.tolist(), place.tolist(), ids.tolist(), block.top(q, own, k)):
                    found += [(p, at, i, int(a), int(s)) for a, s in zip(v, score)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)],
                        names=["from", "place", "query_id", "vec_id", "score"])

    each = left.groupBy("pack", "grp").cogroup(wanted.groupBy("block", "grp")).applyInArrow(
        meet, "from long, place long, query_id long, vec_id long, score long")
    best = F.row_number().over(W.partitionBy("from", "place").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(
      list_transform(embedding, lambda x: coalesce(isfinite(CAST(x AS DOUBLE)), false)), false)),
  pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.x) = len(c.x)),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op12_exact_topk", SQL)
def op12(spark, sf):
    return top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)
