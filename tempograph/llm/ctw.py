"""Language-model scoring by context-tree weighting over bytes.

The text that is scored is its words, lower-cased (A-Z), joined by single spaces and ended by a newline.  Each byte is
decomposed into eight binary decisions, one binary context tree for each of the 255 prefixes of a byte, whose contexts
are the DEPTH bytes before it.  A node at depth d keeps the counts (n0, n1) of its decision; KT is the
Krichevsky-Trofimov block probability of these counts, and a node's weighted probability is

    Pw = KT                                    at depth DEPTH
    Pw = 1/2 KT + 1/2 * product of children    above

After training, the probability of a bit mixes the KT estimates of all depths along its context: at depth d with the
weight 1/2 KT / Pw, the rest going to the deeper depths.  A node that training never met has counts 0, so that what lies
below it predicts 1/2.  The code length of a text is the sum of its bits' -log2.

The counts of (DEPTH + 1)-byte grams are all that training needs.  Nothing of the corpus is gathered on the driver but
the nodes of depths 0 and 1 (256 * 255 at most):

1. One pass cuts the documents into blocks of BLOCK_BYTES and writes to the shared folder the texts, and for each block
   the sorted distinct grams and word hashes with their training counts, dealt by key into partitions, one for each PART_BYTES of
   text, such that grams with the same three nearest context bytes meet.
2. Each key partition adds up its counts over all blocks and weighs its subtrees down to depth 3.  The nodes of depth 2, whose
   children may be in several partitions, are added up by key and finished row by row, those of depths 1 and 0 on the driver.
3. Each key partition gets its nodes of depth 2 back by a join, and sends to every block the values of just that block's keys;
   each block scores its texts.

So the work, and what is shuffled, grows with the text and with the distinct keys of blocks; a frequent word or gram is one
key in each block, whatever its count.  (Blocks times partitions bounds the number of rows that travel; it stays under the
number of keys, as empty ones aren't sent.)

The base model (add-one word counts) takes the same way with 64-bit hashes of the words; two words of one hash, by chance once
in 2^64 pairs, would be counted together.

The scored text differs from the document's in white space and in the case of A-Z only; n_bytes is its length.

Nulls: a null text is empty (one end token); a null id counts as training (its checksum is that of no bytes).  Empty
tables give empty results; equal rows are scored each and count each; there are no ties to break; a very long text is a block of
its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable
from .common import stored, table
from .textbytes import LOWER, column_bytes, parts, tidy, word_bounds, word_hashes

DEPTH, BLOCK_BYTES, PART_BYTES = 5, 16_000_000, 16_000_000
#: grams that agree in so many nearest context bytes are in one partition
NEAR = 3
END = 0x0A
CHUNK = 1 << 20
#: the largest counting table of ranks; beyond it they are sorted
MOST_CELLS = 1 << 25


def canonical(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' canonical bytes, each after depth newlines: all bytes, each row's first and its length."""
    n = np.diff(before)
    lengths = np.insert(ends - starts, before[:-1][n == 0], 0) if (n == 0).any() else ends - starts
    slots = np.maximum(n, 1)  # a row without words is its end alone
    last = np.cumsum(slots)
    total = np.append(0, np.cumsum(lengths + 1))
    size = total[last] - total[last - slots]
    first = np.cumsum(size + depth) - size
    out = np.full(int(size.sum()) + depth * len(n), END, np.uint8)
    row = np.repeat(np.arange(len(n)), slots)
    at = total[1:] - 1 + depth * (row + 1)  # places of the separators
    letters = np.ones(len(out), bool)
    letters[at] = False
    for k in range(depth):
        letters[first - 1 - k] = False
    out[at] = 0x20
    out[at[last - 1]] = END
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    out[letters] = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return out, first, size


def grams(text: np.ndarray, first: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams (nearest context byte highest, the byte itself lowest), sorted, and the rank among them of each of the rows' bytes.

    Ranks are made dense byte by byte, through counting tables, so nothing is sorted.
    """
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.int32)
    code[used] = np.arange(len(used))
    inside = np.ones(len(text), bool)
    for k in range(depth):
        inside[first - 1 - k] = False

    def places() -> Iterator[tuple[slice, np.ndarray]]:
        """The places of the rows' bytes, and where their ranks are, part by part."""
        done = 0
        for i in range(0, len(text), CHUNK):
            at = np.flatnonzero(inside[i : i + CHUNK]) + i
            yield slice(done, done + len(at)), at
            done += len(at)

    rank = np.zeros(int(size.sum()), np.int32)
    keys = np.zeros(1, np.uint64)
    for back in [*range(1, depth + 1), 0]:
        if len(keys) * len(used) > MOST_CELLS:
            wide = np.empty(len(rank), np.int64)
            for own, at in places():
                wide[own] = rank[own] * np.int64(len(used)) + code[text[at - back]]
            found, rank = np.unique(wide, return_inverse=True)
            rank = rank.astype(np.int32)
        else:
            seen = np.zeros(len(keys) * len(used), bool)
            for own, at in places():
                rank[own] = rank[own] * np.int32(len(used)) + code[text[at - back]]
                seen[rank[own]] = True
            found = np.flatnonzero(seen)
            dense = np.zeros(len(seen), np.int32)
            dense[found] = np.arange(len(found), dtype=np.int32)
            for own, _ in places():
                rank[own] = dense[rank[own]]
        keys = keys[found // len(used)] << np.uint64(8) | used[found % len(used)].astype(np.uint64)
    return keys, rank


def counted(rank: np.ndarray, n: int, use: np.ndarray) -> np.ndarray:
    """How often each rank occurs where use is true."""
    out = np.zeros(n, np.int64)
    for i in range(0, len(rank), CHUNK):
        out += np.bincount(rank[i : i + CHUNK][use[i : i + CHUNK]], minlength=n)
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x > 0."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n0, n1 = n0.astype(float), n1.astype(float)
    return np.where(n0 + n1 > 0, log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi), 0.0)


class Level:
    """Nodes of one depth and one prefix length: sorted keys (context, prefix), counts, weights."""

    def __init__(self, keys, n0, n1, below):
        self.keys, self.n0, self.n1 = keys, n0, n1
        kt = log_kt(n0, n1)
        self.log_pw = kt if below is None else np.logaddexp(kt, below) - math.log(2)
        self.weight = np.ones(len(keys)) if below is None else np.exp(kt - math.log(2) - self.log_pw)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)


def shallower(level: Level, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and children's sums one depth up, and each node's parent."""
    k = np.uint64(bits)
    parent = (level.keys >> np.uint64(8 + bits)) << k | level.keys & np.uint64((1 << bits) - 1)
    keys, at = np.unique(parent, return_inverse=True)
    n = len(keys)
    return keys, np.bincount(at, level.n0, n), np.bincount(at, level.n1, n), np.bincount(at, level.log_pw, n), at


def tree(keys: np.ndarray, n: np.ndarray, bits: int, depth: int, top: int) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray, tuple]:
    """Levels depth down to top of the trees of prefixes of this many bits; parents; each gram's node and bit; what is above."""
    context = keys >> np.uint64(8 - bits)
    bit = (keys >> np.uint64(7 - bits) & np.uint64(1)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    node = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(context))))
    levels, parents = [Level(context[begin], np.add.reduceat(n * (1 - bit), begin), np.add.reduceat(n * bit, begin), None)], []
    for d in range(depth - 1, top - 2, -1):
        up = shallower(levels[-1], bits)
        if d < top:
            return levels, parents, node, bit, up
        levels.append(Level(*up[:4]))
        parents.append(up[4])
    raise AssertionError


def summaries(keys: np.ndarray, n: np.ndarray, depth: int) -> list[tuple]:
    """(bits, keys, n0, n1, sum of children) of the nodes at depth NEAR - 1, from the grams below."""
    return [(b, *tree(keys, n, b, depth, NEAR)[4][:4]) for b in range(8)] if len(keys) else []


def crown(rows: list[tuple]) -> list[tuple[Level, Level, np.ndarray]]:
    """Depths 1 and 0 of all trees from the sums (bits, key, n0, n1, below): for each prefix length both levels and the parents."""
    out = []
    for b in range(8):
        own = sorted(r for r in rows if r[0] == b)
        k, n0, n1, below = (np.array([r[i] for r in own], t) for i, t in ((1, np.uint64), (2, float), (3, float), (4, float)))
        one = Level(k, n0, n1, below)
        up = shallower(one, b)
        out.append((one, Level(*up[:4]), up[4]))
    return out


def log_probabilities(keys: np.ndarray, n: np.ndarray, depth: int, two: list[Level], above: list) -> np.ndarray:
    """log10 of each gram's last byte after its context.  two: for each prefix length the nodes of depth 2, of these grams at least."""
    out = np.zeros(len(keys))
    if not len(keys):
        return out
    for b in range(8):
        levels, parents, node, bit, up = tree(keys, n, b, depth, NEAR)
        p = levels[0].one
        chain = np.arange(len(p))
        for level, parent in zip(levels[1:], parents):
            chain = parent[chain]
            p = level.weight[chain] * level.one[chain] + (1 - level.weight[chain]) * p
        one, zero, root = above[b]
        own = up[0][up[4][chain]]  # the node of depth 2 of each
        k = np.uint64(b)
        at = np.searchsorted(one.keys, (own >> np.uint64(8 + b)) << k | own & np.uint64((1 << b) - 1))
        for level, at in ((two[b], np.searchsorted(two[b].keys, own)), (one, at), (zero, root[at])):
            p = level.weight[at] * level.one[at] + (1 - level.weight[at]) * p
        p = p[node]
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


GRAM, WORD = 0, 1
VALUES = (("block", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("values", pa.binary()))


def squeezed(x: np.ndarray, rising: bool = False) -> bytes:
    """Integers of 64 bits (rising: sorted, kept as steps), byte by byte of all numbers, compressed."""
    x = x.astype(np.uint64)
    steps = np.diff(x, prepend=np.uint64(0)) if rising else x
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def expanded(b: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64) if rising else steps


def dealt(keys: np.ndarray, kind: int, depth: int, n: int) -> np.ndarray:
    """Partition 0 to n-1 of each key; grams by their NEAR nearest context bytes."""
    x = keys >> np.uint64(8 * (depth + 1 - NEAR)) if kind == GRAM else keys
    return ((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def block_keys(texts: pa.Array, depth: int) -> dict:
    """What a block's texts hold: sorted distinct grams and words, the rank of each place and token, and the rows' bounds."""
    data, offsets = column_bytes(texts)
    data = LOWER[data]
    starts, ends, before = word_bounds(data, offsets)
    hashes = word_hashes_in_parts(data, starts, ends)
    words, token = np.unique(hashes, return_inverse=True)
    token = token.astype(np.int32)
    text, first, size = canonical(data, starts, ends, before, depth)
    del data, starts, ends, hashes
    keys, rank = grams(text, first, size, depth)
    return {"grams": keys, "rank": rank, "words": words, "token": token, "before": before, "size": size}


def word_hashes_in_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)) )
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = word_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out | np.uint64(1)  # 0 is free for the end token


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of each row of docs (id, text, train)."""
    spark = importable(docs.sparkSession)
    if depth < NEAR:
        raise ValueError(f"depth must be {NEAR} or more")
    n_parts = -(-max(1, docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]) // PART_BYTES)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0
        empty = lambda n, kind: pa.nulls(n, kind)

        def emit() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, texts, train = (whole.column(c).combine_chunks() for c in (id_col, text_col, train_col))
            n = len(ids)
            names = ["block", "id", "text", "train", "part", "kind", "keys", "counts"]
            for i in range(0, n, 2000):
                m = min(2000, n - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number, np.int64)), ids.slice(i, m), texts.slice(i, m), train.slice(i, m), empty(m, pa.int64()), empty(m, pa.int32()), empty(m, pa.binary()), empty(m, pa.binary())], names=names)
            b, use = block_keys(texts, depth), train.to_numpy(zero_copy_only=False).astype(bool)
            rows = []
            for kind, keys, rank, lengths in ((GRAM, b["grams"], b["rank"], b["size"]), (WORD, b["words"], b["token"], np.diff(b["before"]))):
                counts = counted(rank, len(keys), np.repeat(use, lengths))
                part = dealt(keys, kind, depth, n_parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(n_parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    at = order[edges[p] : edges[p + 1]]
                    rows.append((p, kind, squeezed(keys[at], rising=True), squeezed(counts[at])))
            m = len(rows)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number, np.int64)), empty(m, ids.type), empty(m, texts.type), empty(m, pa.bool_()), *cols], names=names)

        for whole in batches:
            for batch in parts(whole, text_col):
                held.append(batch)
                size += batch.nbytes
                if size >= block_bytes:
                    yield from emit()
                    held.clear()
                    number, size = number + 1, 0
        if held:
            yield from emit()

    base = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col), train_col)
    made = stored(base.mapInArrow(tidy(cut), f"block long, id {id_type}, text string, train boolean, part long, kind int, keys binary, counts binary"), "ctw_blocks")
    keyed, texts = made.where("part IS NOT NULL").select("block", "part", "kind", "keys", "counts"), made.where("part IS NULL").select("block", "id", "text", "train")

    def gathered(t: pa.Table, kind: int) -> tuple:
        """Distinct keys of a partition, their counts over all blocks, and the blocks with their keys."""
        t = t.filter(pa.compute.equal(t.column("kind"), kind))
        own = [expanded(k.as_py(), rising=True) for k in t.column("keys")]
        if not own:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), [], []
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        n = np.bincount(at, np.concatenate([expanded(c.as_py()) for c in t.column("counts")]), len(keys)).astype(np.int64)
        return keys, n, t.column("block").to_pylist(), own

    def summed(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        keys, n, _, _ = gathered(t, GRAM)
        words, c, _, _ = gathered(t, WORD)
        cols = [np.concatenate(x) for x in zip(*[(np.full(len(k), b, np.int32), k.astype(np.int64), *(v.astype(float) for v in rest)) for b, k, *rest in summaries(keys, n, depth)], (np.array([-1], np.int32), np.zeros(1, np.int64), np.array([float(c.sum())]), np.array([float((c > 0).sum())]), np.zeros(1)))]
        return pa.table({"part": pa.array(np.full(len(cols[0]), part, np.int64)), **{k: pa.array(v) for k, v in zip(("bits", "key", "n0", "n1", "below"), cols)}})

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            bits, key, *rest = (t.column(c).to_numpy() for c in ("bits", "key", "n0", "n1", "below"))
            level = Level(key, *rest)
            up = (key >> (8 + bits)) << bits | key & ((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(level.log_pw), pa.array(up)], names=[*t.schema.names, "log_pw", "up"])

    sums = stored(keyed.groupBy("part").applyInArrow(summed, "part long, bits int, key long, n0 double, n1 double, below double"), "ctw_sums")
    nodes = sums.where("bits >= 0").groupBy("bits", "key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    nodes = stored(nodes.mapInArrow(tidy(weighed), "bits int, key long, n0 double, n1 double, below double, log_pw double, up long"), "ctw_nodes")
    top = nodes.groupBy("bits", "up").agg(*[F.sum(c) for c in ("n0", "n1", "log_pw")]).collect()  # 256 * 255 rows at most
    above = crown([tuple(r) for r in top])
    n_ends = texts.where("train").count()
    tokens, distinct = (int(x or 0) for x in sums.where("bits < 0").agg(F.sum("n0"), F.sum("n1")).first())
    tokens, distinct = tokens + n_ends, distinct + (n_ends > 0)

    def answered(t: pa.Table, own_nodes: pa.Table) -> pa.Table:
        out = []
        if not len(t):
            return pa.table({name: pa.array([], kind) for name, kind in VALUES})
        bits, key, *rest = (own_nodes.column(c).to_numpy() for c in ("bits", "key", "n0", "n1", "below"))
        two = []
        for b in range(8):
            at = np.flatnonzero(bits == b)
            at = at[np.argsort(key[at])]
            two.append(Level(key[at].astype(np.uint64), *(v[at] for v in rest)))
        for kind in (GRAM, WORD):
            keys, n, blocks, own = gathered(t, kind)
            value = log_probabilities(keys, n, depth, two, above) if kind == GRAM else n
            out += [(b, t.column("part")[0].as_py(), kind, (value[np.searchsorted(keys, k)].astype(np.float32).tobytes() if kind == GRAM else squeezed(value[np.searchsorted(keys, k)]))) for b, k in zip(blocks, own)]
        return pa.table({name: pa.array(col, kind) for (name, kind), col in zip(VALUES, zip(*out))})

    needed = sums.where("bits >= 0").select("part", "bits", "key").join(nodes.drop("log_pw", "up"), ["bits", "key"]).select("part", "bits", "key", "n0", "n1", "below")
    values = keyed.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(answered, "block long, part long, kind int, values binary")

    def scored(rows: pa.Table, found: pa.Table) -> pa.Table:
        b = block_keys(rows.column("text").combine_chunks(), depth)
        got = {(k, p): v for k, p, v in zip(*(found.column(c).to_pylist() for c in ("kind", "part", "values")))}

        def of(keys: np.ndarray, kind: int) -> np.ndarray:
            part, value = dealt(keys, kind, depth, n_parts), np.zeros(len(keys))
            order = np.argsort(part, kind="stable")
            if len(keys):
                value[order] = np.concatenate([np.frombuffer(got[kind, p], np.float32) if kind == GRAM else expanded(got[kind, p]) for p in np.unique(part)])
            return value

        def sums(value: np.ndarray, rank: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            ends = np.append(0, np.cumsum(lengths))
            return np.array([value[rank[i:j]].sum() for i, j in zip(ends[:-1], ends[1:])])

        count, n = of(b["words"], WORD), np.diff(b["before"])
        log10 = lambda c: np.log10((c + 1) / (tokens + distinct + 1))
        result = {
            "id": rows.column("id"), "held_out": pa.compute.invert(rows.column("train")), "n_tokens": n + 1,
            "n_known": sums((count > 0).astype(np.int64), b["token"], n).astype(np.int64) + (n_ends > 0), "train_tokens": np.full(len(n), tokens, np.int64),
            "base_score": sums(log10(count), b["token"], n) + log10(n_ends), "score": sums(of(b["grams"], GRAM), b["rank"], b["size"]), "n_bytes": b["size"],
        }
        return pa.table(result)

    return texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(scored, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text", train.alias("train")))
    bits = F.round(-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes"), 6)
    return out.withColumnRenamed("id", "doc_id").withColumn("bits_per_byte", bits)
