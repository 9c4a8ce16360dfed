"""Exact top-k inner-product search by three-phase uniform threshold.

A score is the sum of LISTS partial scores, one for each slice of the vector's components.  Rows are packed where they are read,
in pieces; each piece is dealt, by some rounds of k-means of its own, into tiles of some TILE rows that lie close together.  A tile
bounds its rows' partial scores with a query: |x - c| <= r on each slice gives  q.c - |q| r <= q.x <= q.c + |q| r.  Pieces make up
row blocks, some BLOCKS of them whatever the table's size, as far as CELLS components in a task allow.  In each phase a task takes
one row block into memory and the pieces of queries (a stated share of the rows) pass by it, one after the other:

1. gather: of each row block a query looks at the LOOK tiles with the highest bounds only, takes the K best entries of each of
   their LISTS local score lists, and sends the scores of the K best of these; the K-th best of all that is sent is a safe cutoff:
   the K-th best score of all rows is at least that;
2. collect: each query's cutoff goes back to the row blocks with the query.  A row with a score of at least the cutoff has a
   partial score of at least the uniform threshold cutoff / LISTS; a tile whose bounds are all under it, or whose bounds
   together are under the cutoff, is left out unmultiplied.  In tiles that few queries have left, partial scores are computed list
   by list, and an entry goes as soon as what is known and the bounds of the rest are under the cutoff; tiles that most queries
   have left are multiplied together, half of the lists first if a try shows that this leaves few entries;
3. resolve: the lists that are left are added up, exactly, for the entries that are left only; those under the cutoff are
   dropped (a block's own K-th best score raises it), each block keeps its K best, and the blocks' results are merged.

Components are integers, floor(SCALE * x), kept in 16 bits where they fit; sums are exact in single precision where the product of
the norms is under 2^24, in double precision up to 2^53, beyond which Python's integers do the work, without bounds (saturated to
64 bits in the result).  No vector is collected and none broadcast; a task holds one row block and one piece of queries.  `search`
can count the multiplied components (an accumulator), which tests hold against brute force.

Nulls: rows with a null id or vector, or with a null or non-finite component, take no part.  Shorter vectors are taken as
filled up with zeros.  Each row of queries is a query of its own: `copy` tells those of equal ids apart (0, 1, ... in the order of
their vectors), and rows with its id are its own.  Repeated rows of other ids are candidates each.  Ties go to smaller ids.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workers import importable
from .common import stored, table

K, LISTS, SCALE, EVERY = 5, 4, 256, 50
ROW_BLOCK, QUERY_BLOCK = 16_384, 512
TILE, ROUNDS, LOOK = 64, 2, 2
#: row blocks of a large table; components of a row block and of a piece at most
BLOCKS, CELLS, PIECE_CELLS = 48, 1 << 24, 1 << 19
#: rows multiplied at once; share of entries under which they are worth picking out
STRIP, FEW = 1_024, 0.02
SINGLE, DOUBLE = 2.0**24, 2.0**53


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (float or double) of the rows that take part."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))


def tiled(x: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of x's rows and the beginnings of its tiles, of 2 * tile rows at most: k-means from rows at even distances, by inner products."""
    n = -(-len(x) // tile)
    centre = x[np.linspace(0, len(x) - 1, n).astype(int)]
    near = np.zeros(len(x), np.int64)
    with np.errstate(all="ignore"):
        for step in range(ROUNDS + 1):
            near = (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
            if step < ROUNDS:
                order = np.argsort(near, kind="stable")
                begin = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
                count = np.diff(np.append(begin, len(x)))
                centre[near[order][begin]] = np.add.reduceat(x[order], begin) / count[:, None] if x.shape[1] else 0
    order = np.argsort(near, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
    return order, np.concatenate([np.arange(i, j, 2 * tile) for i, j in zip(begin, np.append(begin[1:], len(x)))])


PIECE = "part long, piece long, n long, width long, keys binary, ids binary, vectors binary, extra binary, tiles binary"


def packed(df: DataFrame, most: int, scale: int, extra: str | None = None, tile: int = 0) -> DataFrame:
    """Pieces of df's rows (key, id, vector, maybe extra), without a shuffle: `most` rows and PIECE_CELLS components each at most."""
    cells = PIECE_CELLS

    def piece(t: pa.Table, part: int, k: int) -> pa.RecordBatch:
        v = t.column("vector").combine_chunks()
        n = np.diff(v.offsets.to_numpy())
        width = int(n.max())
        x = np.zeros((len(n), width))
        x[np.arange(width) < n[:, None]] = np.floor(scale * v.flatten().to_numpy().astype(float))
        short = np.abs(x).max(initial=0) < 2**15
        order, begin = tiled(x.astype(np.float32) if short else x, tile) if tile else (np.arange(len(x)), np.zeros(0, np.int64))
        more = t.column(extra).to_numpy().astype(float)[order].tobytes() if extra else b""
        data = [*(t.column(c).to_numpy()[order].tobytes() for c in ("key", "id")), x[order].astype(np.int16 if short else float).tobytes(), more, begin.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()) for i in (part, k, len(x), width)] + [pa.array([d], pa.binary()) for d in data], names=[c.split()[0] for c in PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            width = max(int(np.diff(b.column("vector").offsets.to_numpy()).max()) for b in held)
            rows = max(1, min(most, cells // max(1, width)))
            if sum(map(len, held)) >= rows:
                t = pa.Table.from_batches(held)
                whole = len(t) // rows * rows
                for i in range(0, whole, rows):
                    yield piece(t.slice(i, rows), part, k)
                    k += 1
                held = t.slice(whole).combine_chunks().to_batches() if whole < len(t) else []
        if held:
            yield piece(pa.Table.from_batches(held), part, k)

    return df.mapInArrow(run, PIECE)


def unpacked(vectors: bytes, n: int, width: int) -> np.ndarray:
    """The components of a piece: single precision if they are short, double otherwise."""
    short = len(vectors) == 2 * n * width
    return np.frombuffer(vectors, np.int16 if short else float).reshape(n, width).astype(np.float32 if short else float)


def filled(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.zeros((len(x), width - x.shape[1]), x.dtype)])


def norm(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, in double precision."""
    return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float))


def whole(x: np.ndarray) -> np.ndarray:
    """x as Python integers."""
    return np.frompyfunc(int, 1, 1)(x).astype(object)


class Block:
    """A row block with its tiles, which meets pieces of queries, cut into lists."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lists: int, k: int, look: int):
        self.lists, self.k, self.look, self.multiplied = lists, k, look, 0
        width = max(x.shape[1] for _, x, _ in pieces)
        starts = np.cumsum([0, *(len(i) for i, _, _ in pieces)])
        self.ids = np.concatenate([i for i, _, _ in pieces])
        self.x = np.concatenate([filled(x, width) for _, x, _ in pieces])
        self.begin = np.concatenate([t + s for (_, _, t), s in zip(pieces, starts)])
        self.end = np.append(self.begin[1:], len(self.ids))
        self.longest = norm(self.x).max(initial=0)
        self.shaped = None

    def shape(self, width: int, kind: type) -> None:
        """Lists, bounds and remainders for a width and a precision."""
        if self.shaped == (width, kind):
            return
        self.shaped = (width, kind)
        self.x = filled(self.x, width).astype(kind, copy=False)
        self.cuts = [slice(i * width // self.lists, (i + 1) * width // self.lists) for i in range(self.lists)]
        size = self.end - self.begin
        self.centre = (np.add.reduceat(self.x, self.begin, dtype=float) / size[:, None]).astype(kind) if width else np.zeros((len(size), 0), kind)
        self.radius = np.zeros((self.lists, len(size)), kind)
        for a in range(0, len(size), 256):  # some tiles at a time
            rows = slice(self.begin[a], self.end[min(a + 256, len(size)) - 1])
            apart = self.x[rows] - np.repeat(self.centre[a : a + 256], size[a : a + 256], axis=0)
            for l, c in enumerate(self.cuts):
                self.radius[l, a : a + 256] = np.sqrt(np.maximum.reduceat((apart[:, c] ** 2).sum(1), self.begin[a : a + 256] - rows.start)) * (1 + 1e-4)
        self.half = self.cuts[(self.lists - 1) // 2].stop
        self.rest = (norm(self.x[:, self.half :]) * (1 + 1e-4)).astype(kind)

    def meet(self, y: np.ndarray) -> None:
        """Take a piece of queries; exact: bounds hold, and sums are those of integers."""
        width = max(self.x.shape[1], y.shape[1], 1)
        longest = float(norm(y).max(initial=0))
        most = max(1.0, self.longest) * max(1.0, longest)
        self.exact = bool(most < DOUBLE / 2)
        kind = np.float32 if most < SINGLE / 2 and self.x.dtype == np.float32 and y.dtype == np.float32 else float
        if not self.exact:
            self.x, self.y, self.shaped = filled(self.x, width), filled(y, width), None
            self.cuts = [slice(i * width // self.lists, (i + 1) * width // self.lists) for i in range(self.lists)]
            self.bounds = [np.full((len(self.begin), len(y)), np.inf)] * self.lists
            self.slack = 0.0
            return
        self.shape(width, kind if self.shaped is None or self.shaped[1] == np.float32 else float)  # double precision stays
        kind = self.x.dtype
        self.y = filled(y, width).astype(kind, copy=False)
        self.bounds = [self.centre[:, c] @ self.y[:, c].T + r[:, None] * (norm(self.y[:, c]) * (1 + 1e-4)).astype(kind) for c, r in zip(self.cuts, self.radius)]  # by list: tiles down, queries across
        self.slack = kind.type(1 + 4 * (width + 8) * float(np.finfo(kind).eps) * most)
        self.multiplied += self.centre.size * len(y)

    def partial(self, l: int, rows, queries) -> np.ndarray:
        """Partial scores of list l: rows down, queries across."""
        a, b = self.x[rows, self.cuts[l]], self.y[queries, self.cuts[l]]
        self.multiplied += a.size * len(b)
        return a @ b.T if self.exact else whole(a) @ whole(b).T

    def partial_of(self, c: slice, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Partial scores over some components of single entries."""
        a, b = self.x[rows, c], self.y[queries, c]
        self.multiplied += a.size
        return np.einsum("ij,ij->i", a, b) if self.exact else (whole(a) * whole(b)).sum(1)

    def gathered(self, q_ids: np.ndarray, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phase 1: rows, queries and exact scores of the k best entries of the local lists, of the tiles with the highest bounds."""
        bound = sum(self.bounds).T
        n, look = bound.shape[1], min(self.look, bound.shape[1])
        tiles = np.argpartition(bound, n - look, axis=1)[:, n - look :]
        longest = int((self.end - self.begin).max())
        found = []
        step = max(1, (1 << 21) // (look * longest * max(1, self.x.shape[1])))
        for a in range(0, len(q_ids), step):
            t, q = tiles[a : a + step], np.arange(a, min(a + step, len(q_ids)))
            rows = self.begin[t][:, :, None] + np.arange(longest)
            there = (rows < self.end[t][:, :, None]).reshape(len(q), -1)
            rows = np.minimum(rows.reshape(len(q), -1), len(self.ids) - 1)
            there &= self.ids[rows] != q_ids[q, None]
            x, y = self.x[rows], self.y[q]
            self.multiplied += int(there.sum()) * x.shape[2]
            part = [(x[:, :, c] @ y[:, c, None])[:, :, 0] if self.exact else (whole(x[:, :, c]) * whole(y[:, c])[:, None]).sum(2) for c in self.cuts]
            hit = np.zeros_like(there)
            for p in part:
                if not self.exact:
                    hit |= there
                    break
                p = np.where(there, p, -np.inf)
                best_ = np.argpartition(p, max(0, p.shape[1] - self.k), axis=1)[:, -self.k :]
                np.put_along_axis(hit, best_, True, axis=1)
            hit &= there
            i, j = np.nonzero(hit)
            found.append((rows[i, j], q[i], sum(p[i, j] for p in part)))
        r, q, score = (np.concatenate(v) for v in zip(*found))
        keep = best(q, score, self.ids[r], self.k)
        return r[keep], q[keep], score[keep]

    def resolved(self, q_ids: np.ndarray, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phases 2 and 3: rows, queries and exact scores of the k best entries of at least the cutoff."""
        slack, bounds = self.slack, self.bounds
        least = cutoffs.astype(self.x.dtype if self.exact else float)
        open_ = (sum(bounds) + slack >= least) & np.logical_or.reduce([b + slack >= least / self.lists for b in bounds])
        many = open_.sum(1) * 2 > open_.shape[1]  # tiles that are multiplied together
        found, held = [], 0

        def add(r: np.ndarray, q: np.ndarray, score: np.ndarray) -> None:
            nonlocal found, held
            own = self.ids[r] != q_ids[q]
            found.append((r[own], q[own], score[own]))
            held += len(found[-1][0])
            if held > 64 * self.k * len(q_ids):
                trim()

        def trim() -> None:
            """Keep the k best of each query so far; the k-th best is a cutoff, too."""
            nonlocal found, held
            r, q, score = (np.concatenate(v) for v in zip(*found))
            keep = best(q, score, self.ids[r], self.k)
            found, held = [(r[keep], q[keep], score[keep])], len(keep)
            if self.exact and len(keep):
                q, score = q[keep], score[keep]
                first = np.flatnonzero(np.append(True, np.diff(q) > 0))
                full = np.diff(np.append(first, len(q))) == self.k
                at = q[first[full]]
                least[at] = np.maximum(least[at], np.minimum.reduceat(score, first)[full])

        if self.exact and many.any():
            size = self.end - self.begin
            rows = np.flatnonzero(np.repeat(many, size)) if not many.all() else None
            n, few, tail = len(self.ids) if rows is None else len(rows), None, slice(self.half, self.x.shape[1])
            y_rest = (norm(self.y[:, tail]) * (1 + 1e-4)).astype(self.x.dtype)
            head, queries = self.y[:, : self.half].T, len(self.y)
            for a in range(0, n, STRIP):
                at = slice(a, min(a + STRIP, n)) if rows is None else rows[a : a + STRIP]
                x = self.x[at]
                if few is not False and self.half < self.x.shape[1]:
                    known = x[:, : self.half] @ head
                    left = np.flatnonzero(known + self.rest[at][:, None] * y_rest + slack >= least)
                    self.multiplied += len(x) * self.half * queries
                    few = len(left) < FEW * known.size
                    if few:
                        r, q = np.divmod(left, queries)
                        score, r = known.ravel()[left], r + a if rows is None else rows[r + a]
                        score = score + self.partial_of(tail, r, q)
                        go = score >= least[q]
                        add(r[go], q[go], score[go])
                        continue
                score = x @ self.y.T
                self.multiplied += x.size * queries
                left = np.flatnonzero(score >= least)
                r, q = np.divmod(left, queries)
                add(r + a if rows is None else rows[r + a], q, score.ravel()[left])
        for tile in np.flatnonzero((open_ & ~many[:, None] if self.exact else open_).any(1)):
            queries = np.flatnonzero(open_[tile])
            rows = np.arange(self.begin[tile], self.end[tile])
            rest = [b[tile, queries] for b in bounds]
            total, l = self.partial(0, slice(self.begin[tile], self.end[tile]), queries), 1
            alive = (total + (sum(rest[1:]) + slack) >= least[queries]).astype(bool)
            while l < self.lists and alive.sum() * 4 > alive.size:  # many entries: all of the tile
                total = total + self.partial(l, slice(self.begin[tile], self.end[tile]), queries)
                l += 1
                alive &= (total + (sum(rest[l:]) + slack) >= least[queries]).astype(bool)
            r, q = np.nonzero(alive)
            total = total[r, q]
            while l < self.lists and len(r):
                total = total + self.partial_of(self.cuts[l], rows[r], queries[q])
                l += 1
                go = (total + (sum(rest[l:])[q] if l < self.lists else 0) + slack >= least[queries[q]]).astype(bool)
                r, q, total = r[go], q[go], total[go]
            go = (total >= least[queries[q]]).astype(bool)
            add(rows[r[go]], queries[q[go]], total[go])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        trim()
        return found[0]


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query, by query, ties to smaller ids."""
    if score.dtype == object:
        _, score = np.unique(score, return_inverse=True)
    by = np.lexsort((ids, -score, query))
    q = query[by]
    return by[np.arange(len(q)) - np.searchsorted(q, q) < k]


def met(rows: DataFrame, queries: DataFrame, n: int, phase, lists: int, k: int, counter=None) -> DataFrame:
    """phase over each pair of a row block and a piece of queries: key, id, score.

    A partition gets a block's pieces and then a copy of each piece of queries, which pass by one at a time.
    """
    look = LOOK
    fields = ["block", "n", "width", "keys", "ids", "vectors", "extra", "tiles"]
    x = rows.withColumn("block", F.pmod(F.col("part") + F.col("piece") * 7919, F.lit(n)).cast("int")).select(F.lit(0).alias("side"), *fields)
    y = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.lit(1).alias("side"), *fields)
    both = x.unionByName(y).repartitionById(n, F.col("block")).sortWithinPartitions("block", "side")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            for i in range(len(batch)):
                v = {c: batch.column(c)[i] for c in ("side", *fields)}
                size, width = v["n"].as_py(), v["width"].as_py()
                ids, vectors = np.frombuffer(v["ids"].as_buffer(), np.int64), unpacked(v["vectors"].as_buffer(), size, width)
                if at != v["block"].as_py():
                    at, held, block = v["block"].as_py(), [], None
                if v["side"].as_py() == 0:
                    held.append((ids.copy(), vectors, np.frombuffer(v["tiles"].as_buffer(), np.int64).copy()))
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(held, lists, k, look), []
                block.meet(vectors)
                r, q, score = phase(block, ids, np.frombuffer(v["extra"].as_buffer()))
                score = np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in score], np.int64) if score.dtype == object else score.astype(np.int64)
                if counter is not None:
                    counter.add(int(block.multiplied))
                    block.multiplied = 0
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v["keys"].as_buffer(), np.int64)[q], pa.int64()), pa.array(block.ids[r], pa.int64()), pa.array(score, pa.int64())], names=["key", "id", "score"])

    return both.mapInArrow(each, "key long, id long, score long")


def blocks(rows: int, width: int) -> int:
    """Row blocks of a table: of ROW_BLOCK rows, but not more than BLOCKS, unless a block had more than CELLS components."""
    return max(1, min(-(-rows // ROW_BLOCK), BLOCKS), -(-rows * width // CELLS))


def search(df: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", counter=None) -> DataFrame:
    """query_id, copy, rank (from 1), id, score: the k best rows of df for each row of queries."""
    importable(df.sparkSession)
    asked = usable(queries, id_col, vector_col)
    copy = F.row_number().over(W.partitionBy("id").orderBy("vector")) - 1
    asked = stored(asked.withColumn("copy", copy).withColumn("key", F.monotonically_increasing_id()), "topk_queries")
    rows = usable(df, id_col, vector_col).withColumn("key", F.lit(0).cast("long"))
    pieces = stored(packed(rows, ROW_BLOCK, scale, tile=TILE), "topk_rows")
    size = pieces.agg(F.sum("n"), F.max("width")).first()
    n = blocks(size[0] or 0, size[1] or 0)
    gathered, resolved = lambda b, *v: b.gathered(*v), lambda b, *v: b.resolved(*v)
    ranked = lambda d, *order: d.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), *order))).where(F.col("rank") <= k)
    first = met(pieces, packed(asked, QUERY_BLOCK, scale), n, gathered, lists, k, counter).select("key", "score")
    cutoff = ranked(first).where(F.col("rank") == k).select("key", F.col("score").cast("double").alias("cutoff"))
    told = asked.join(cutoff, "key", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf"))))
    told = stored(packed(told, QUERY_BLOCK, scale, "cutoff"), "topk_cutoffs")
    last = met(pieces, told, n, resolved, lists, k, counter)
    names = asked.select("key", F.col("id").alias("query_id"), "copy")
    return ranked(last, "id").join(names, "key").select("query_id", "copy", "rank", "id", "score")


def op4_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0)).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score", "copy")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY embedding) - 1 AS INTEGER) AS copy FROM v WHERE vec_id % {EVERY} = 0), s AS (
  SELECT q.vec_id AS query_id, q.copy, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score, copy FROM r WHERE "rank" <= {K}
"""
