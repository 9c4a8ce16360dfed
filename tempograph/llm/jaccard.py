"""N-gram Jaccard join by PartEnum signatures: near duplicates and their connected components, exactly.

A document's set is its distinct word n-grams as 64-bit hashes.  Sets of sizes s1 <= s2 are similar if their Jaccard
similarity is at least GAMMA; then s1 >= GAMMA * s2, and they differ in at most (1 - GAMMA) / (1 + GAMMA) * (s1 + s2) elements.

Signatures.  Sizes are cut into bands [l, l / GAMMA]; a set takes part in its own band's instance and in the next one's,
so similar sets share an instance.  An instance whose sets differ in at most k elements deals the feature domain, by hash,
into n > k partitions; k differences spoil at most k of them, so similar sets agree on the whole content of some partition.
One signature is the hash of a partition's content (enumerated subsets of one partition; with more the
signatures multiply and their selectivity, a fixed number of elements each, does not).  Empty partitions give no
signature.  A similar pair is still met if its larger set has more than k partitions with elements: n is chosen so
that this holds by six standard deviations, and the sets for which it does not hold (counted, normally none) are
joined with all others by their single elements.

Candidates.  Signatures travel as compressed files of one partition of signatures each; sets, not documents, are
joined, so copies collapse at once.  A shared signature gives a list of sets; equal lists are merged, and looked through in
tiles of bounded size.  A pair passes if sizes and the bit parities of both sets (a sketch that gives a lower bound of their
difference) allow similarity.  Where too many do, as in a large group of near copies, whose sets share hundreds of lists, some of
the lists send the pairs of their smallest key; after verification and connected components, all such lists that lie in several
components are looked through again with finer sketches, first for pairs that connect what all allowed pairs of different
components connect (a forest), then, with the components that these give, for all allowed pairs that are left.
Every candidate is verified on the sets themselves, so no link between components is missed, and none is wrong.
(Two different words, n-grams or sets of equal 64-bit hash, by chance once in 2^64 pairs, would be taken for equal.)

Ids may be of any type that has an order.  Nulls: null, empty and blank texts have empty sets, linked with nothing; their component is their own id (a null id stays
null).  Repeated rows are copies.  Empty tables give empty results, very long texts are read whole, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable
from .common import kept, scratch, stored, table
from .ctw import expanded, squeezed
from .textbytes import LOWER, column_bytes, mixed, parts, tidy, word_bounds, word_hashes

N, PERCENT = 5, 75
SIGMAS = 6
TILE, MANY, FINE, STAR = 2048, 4, 8, 8
#: times the width of a row of a few numbers, of one with a whole set
WIDE = 20
#: of a signature's 64 bits so many are kept; chance collisions only cost a comparison
SIGNATURE_BITS = 56
#: at most about so many signatures meet in one task (a set has fewer signatures than elements)
SIGNATURES_PER_PART = 4_000_000
_STEP = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(64)]


def shingles(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word n-grams."""
    data, offsets = column_bytes(texts)
    data = LOWER[data]
    starts, ends, before = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        grams += h[i : i + len(grams)] * _STEP[i]
    grams = mixed(grams)
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield mixed((h[a:b] * np.array(_STEP[: b - a])).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield grams[:0]


def set_key(x: np.ndarray) -> np.int64:
    return mixed(mixed(x).sum(keepdims=True) + np.uint64(len(x))).view(np.int64)[0]


def sketch(x: np.ndarray, times: int = 1) -> bytes:
    """Parities of the elements dealt into at least times as many bits, a power of two."""
    bits = 1 << max(6, (times * len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Instances:
    """Bands of sizes and, for each band's instance, its number of partitions."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def band(self, size: int) -> int:
        while self.lows[-1] * 100 // self.percent < size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def most_differences(self, band: int) -> int:
        """Of two similar sets of the instance: the larger is of the band itself."""
        self.band(self.lows[band] * 100 // self.percent if band < len(self.lows) else self.high(band))
        return 2 * self.high(band) * (100 - self.percent) // (100 + self.percent)

    def high(self, band: int) -> int:
        while len(self.lows) <= band:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return self.lows[band] * 100 // self.percent

    @lru_cache(maxsize=None)  # noqa: B019  one object per worker
    def partitions(self, band: int) -> int:
        """0: each element is a partition."""
        high = self.high(band)
        low, k = self.lows[band], self.most_differences(band)
        n = k + 1
        while n < 2 * low:
            empty = math.exp(-low / n)
            if n * (1 - empty) - k >= SIGMAS * math.sqrt(n * empty * (1 - (1 + low / n) * empty)) + 1 and high > 16:
                return n
            n = n + 1 + n // 50
        return 0


_instances: dict[int, Instances] = {}


def instances(percent: int) -> Instances:
    return _instances.setdefault(percent, Instances(percent))


def contents(x: np.ndarray, band: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitions with elements, and hashes of their contents."""
    if not n:
        return x, mixed(x)
    at = (mixed(x ^ _STEP[band % 64]) % np.uint64(n)).astype(np.int64)
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, at, mixed(x + _STEP[1]))
    used = np.flatnonzero(np.bincount(at, minlength=n))
    return used.astype(np.uint64), sums[used]


def signatures(x: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    inst = instances(percent)
    own = inst.band(len(x))
    out = []
    for band in (own, own + 1):
        where, what = contents(x, band, inst.partitions(band))
        out.append(mixed(what + where * _STEP[2] + np.uint64(band * int(_STEP[3]) % (1 << 64))))
    return np.concatenate(out) >> np.uint64(64 - SIGNATURE_BITS)


def falls_short(x: np.ndarray, percent: int = PERCENT) -> bool:
    inst = instances(percent)
    own = inst.band(len(x))
    return len(contents(x, own, inst.partitions(own))[0]) <= inst.most_differences(own)


def set_table(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id, size, key (null for an empty set), sketch, short of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, text_col):
                sets = list(shingles(batch.column(text_col), n))
                cols = [
                    pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) if len(x) else None for x in sets], pa.int64()),
                    pa.array([sketch(x) if len(x) else None for x in sets], pa.binary()), pa.array([len(x) > 0 and falls_short(x, percent) for x in sets], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *cols], names=["id", "size", "key", "sketch", "short"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"id {kind}, size long, key long, sketch binary, short boolean")


def signature_lists(docs: DataFrame, text_col: str, n: int, percent: int, n_parts: int) -> DataFrame:
    """Lists of at least two sets that share a signature: list (hash of the members), members (sorted keys)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, text_col, 8_000_000):
                sets = {}
                for part in parts(batch, text_col):
                    for x in shingles(part.column(text_col), n):
                        if len(x):
                            sets.setdefault(set_key(x), signatures(x, percent))
                if not sets:
                    continue
                keys = np.fromiter(sets, np.int64, len(sets))
                sig = np.concatenate(list(sets.values()))
                own = np.repeat(np.arange(len(keys)), [len(v) for v in sets.values()])
                order = np.argsort(sig)
                sig, own = sig[order], own[order]
                edges = np.searchsorted(sig, (np.arange(n_parts + 1, dtype=object) * (1 << SIGNATURE_BITS) // n_parts).astype(np.uint64))
                rows = []
                for p in np.flatnonzero(np.diff(edges)):
                    at = slice(edges[p], edges[p + 1])
                    used, index = np.unique(own[at], return_inverse=True)
                    rows.append((p, keys[used].tobytes(), squeezed(sig[at], rising=True), squeezed(index)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "keys", "signatures", "own"])

    def meet(t: pa.Table) -> pa.Table:
        sig, key = [], []
        for k, s, o in zip(*(t.column(c) for c in ("keys", "signatures", "own"))):
            sig.append(expanded(s.as_py(), rising=True))
            key.append(np.frombuffer(k.as_py(), np.int64)[expanded(o.as_py()).astype(np.int64)])
        sig, key = np.concatenate(sig), np.concatenate(key)
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        again = np.append(False, sig[1:] == sig[:-1])
        again[:-1] |= again[1:]
        sig, key = sig[again], key[again]
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[new], key[new]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(sig))
        if len(begin):
            name = np.add.reduceat(mixed(key.view(np.uint64)), begin)
            _, first = np.unique(name, return_index=True)
            first = first[(end - begin)[first] > 1]
            name = name.view(np.int64)
            rows = [(name[i], key[begin[i] : end[i]]) for i in first]
        else:
            rows = []
        return pa.table({"list": pa.array([r[0] for r in rows], pa.int64()), "members": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})

    files = docs.select(text_col).mapInArrow(tidy(deal), "part long, keys binary, signatures binary, own binary")
    lists = files.groupBy("part").applyInArrow(meet, "list long, members array<long>")
    return lists.groupBy("list").agg(F.first("members").alias("members"))


def again_from_text(keys: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, column: str, kind: str, make) -> DataFrame:
    """key, size and a column made of the elements, for each of keys: its first document is read again."""
    reps = sets.join(keys, "key", "left_semi").select(F.col("rep").alias("_rep")).distinct()
    texts = docs.join(reps, docs[id_col].eqNullSafe(F.col("_rep")), "left_semi").select(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, text_col):
                found = [x for x in shingles(batch.column(text_col), n) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([make(x) for x in found])], names=["key", "size", column])

    return texts.mapInArrow(tidy(run), f"key long, size long, {column} {kind}").dropDuplicates(["key"])


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of set keys that are similar, found on the sets themselves."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    elements = again_from_text(need, sets, docs, id_col, text_col, n, "elements", "array<long>", lambda x: x.view(np.int64))
    elements = stored(elements, f"{name}_elements", 2 * pairs.count() * WIDE)
    side = lambda c: elements.select(F.col("key").alias(c), F.col("elements").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("_i", F.size(F.array_intersect("_a", "_b")))
    return both.where(100 * F.col("_i") >= percent * (F.size("_a") + F.size("_b") - F.col("_i"))).select("a", "b")


class Candidates:
    """Rows of many tiles (key, component, chunk, size, sketch), and which pairs of rows of different components may be similar."""

    def __init__(self, t: pa.Table, percent: int):
        self.percent = percent
        self.key, self.comp, self.chunk, self.size = (t.column(c).to_numpy() for c in ("key", "component", "chunk", "size"))
        raw = t.column("sketch").to_pylist()
        self.width = np.fromiter(map(len, raw), np.int64, len(raw))
        self.rows = {}  # by width: sketches folded to it
        self.place = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width >= w)
            m = np.empty((len(at), w // 8), np.uint64)
            for v in np.unique(self.width[at]):
                own = np.flatnonzero(self.width[at] == v)
                m[own] = np.bitwise_xor.reduce(np.frombuffer(b"".join([raw[i] for i in at[own]]), np.uint64).reshape(len(own), -1, w // 8), axis=1)
            place = np.full(len(raw), -1, np.int64)
            place[at] = np.arange(len(at))
            self.rows[w], self.place[w] = m, place

    def allowed(self, x, ys: np.ndarray, across: bool) -> np.ndarray:
        """For each of ys whether it may be similar to x (one row, or as many as ys); across: only rows of different chunks."""
        low, high = np.minimum(self.size[x], self.size[ys]), np.maximum(self.size[x], self.size[ys])
        ok = (self.comp[x] != self.comp[ys]) & (100 * low >= self.percent * high)
        if across:
            ok &= self.chunk[x] != self.chunk[ys]
        left = np.flatnonzero(ok)
        least = np.minimum(self.width[x], self.width[ys])[left]
        for w in np.unique(least):
            at = left[least == w]
            place, m = self.place[w], self.rows[w]
            one = m[place[x]] if np.ndim(x) == 0 else m[place[x[at]]]
            apart = np.bitwise_count(one ^ m[place[ys[at]]]).sum(1, dtype=np.int64)
            ok[at] = apart * (100 + self.percent) <= (low[at] + high[at]) * (100 - self.percent)
        return ok

    def pairs(self, rows: np.ndarray, across: bool, most: float) -> np.ndarray | None:
        """All allowed pairs of rows; None as soon as there are more than most."""
        rows = rows[np.argsort(self.size[rows], kind="stable")]
        size = self.size[rows]
        last = np.searchsorted(size, size * 100 // self.percent, "right")
        found, n = [], 0
        for i, x in enumerate(rows):
            ys = rows[i + 1 : last[i]]
            if len(ys):
                ys = ys[self.allowed(x, ys, across)]
                found.append(np.column_stack([np.full(len(ys), x), ys]))
                n += len(ys)
                if n > most:
                    return None
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def cross(self, rows: np.ndarray, across: bool) -> np.ndarray:
        """All allowed pairs of rows, where one component has most of them."""
        names, comp, n = np.unique(self.comp[rows], return_inverse=True, return_counts=True)
        large, small = rows[comp == n.argmax()], rows[comp != n.argmax()]
        found = [np.zeros((0, 2), np.int64)]
        for i, x in enumerate(small):
            ys = np.concatenate([large, small[i + 1 :]])
            ys = ys[self.allowed(x, ys, across)]
            found.append(np.column_stack([np.full(len(ys), x), ys]))
        return np.concatenate(found)

    def star(self, rows: np.ndarray, across: bool) -> np.ndarray:
        """Allowed pairs of the smallest key."""
        hub = rows[self.key[rows].argmin()]
        ys = rows[self.allowed(hub, rows, across)]
        return np.column_stack([np.full(len(ys), hub), ys])

    def forest(self, rows: np.ndarray, across: bool) -> np.ndarray:
        """Allowed pairs that connect the components that all allowed pairs connect; small keys go first, so that lists choose alike."""
        rows = rows[np.argsort(self.key[rows])]
        names, comp = np.unique(self.comp[rows], return_inverse=True)
        member = np.split(np.argsort(comp, kind="stable"), np.cumsum(np.bincount(comp))[:-1])
        left = np.ones(len(names), bool)
        found = []
        for root in range(len(rows)):
            if not left[comp[root]]:
                continue
            left[comp[root]] = False
            front = member[comp[root]]
            while len(front) and left.any():  # a level of the search: the smaller side asks the larger
                out, new = np.flatnonzero(left[comp]), []
                if len(front) <= len(out):
                    for x in front:
                        ys = out[left[comp[out]]]
                        ys = ys[self.allowed(rows[x], rows[ys], across)]
                        for y in ys[np.unique(comp[ys], return_index=True)[1]]:
                            new.append((x, y))
                            left[comp[y]] = False
                else:
                    for y in out:
                        if left[comp[y]]:
                            ok = self.allowed(rows[y], rows[front], across)
                            if ok.any():
                                new.append((front[ok.argmax()], y))
                                left[comp[y]] = False
                found += [(rows[x], rows[y]) for x, y in new]
                front = np.sort(np.concatenate([member[comp[y]] for _, y in new])) if new else front[:0]
        return np.array(found, np.int64).reshape(-1, 2)


def tiled_pairs(tiles: DataFrame, percent: int, how: str) -> DataFrame:
    """Candidates (a, b) in each tile (list, i, j).

    how: `few` (all allowed pairs; where they are more than MANY times the tile's sets a row (again = list) says so, and one list in
    STAR sends those of its smallest key), `forest` (pairs that connect what the allowed ones connect), `all`.
    """
    small = 2 * MANY + 1  # so many sets have no more than MANY pairs each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen = np.zeros(0, np.uint64)  # pairs already sent by this task; forgotten when too many

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal seen
            name = np.column_stack([t.column(c).to_numpy() for c in ("list", "i", "j")])
            rows = Candidates(t, percent)
            begin = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(1)))
            n = np.diff(np.append(begin, len(name)))
            got, again = [np.zeros((0, 2), np.int64)], []
            for size in range(2, small + 1):  # the many small tiles at once
                first = begin[n == size]
                if len(first):
                    x, y = np.triu_indices(size, 1)
                    x, y = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
                    across = name[x, 1] != name[x, 2]
                    for some in (False, True):
                        at = np.flatnonzero(across == some)
                        ok = at[rows.allowed(x[at], y[at], some)]
                        got.append(np.column_stack([x[ok], y[ok]]))
            for b, k in zip(begin[n > small], n[n > small]):
                own, across = np.arange(b, b + k), bool(name[b, 1] != name[b, 2])
                pairs = rows.pairs(own, across, MANY * k) if how == "few" else rows.forest(own, across) if how == "forest" else rows.cross(own, across)
                if pairs is None:
                    again.append(int(name[b, 0]))
                    pairs = rows.star(own, across) if name[b, 0] % STAR == 0 else got[0]
                got.append(pairs)
            got = np.sort(rows.key[np.concatenate(got)], axis=1)
            mark, first = np.unique(mixed(got[:, 0].astype(np.uint64)) + got[:, 1].astype(np.uint64) * _STEP[0], return_index=True)
            new = ~np.isin(mark, seen)
            got, mark = got[first[new]], mark[new]
            seen = np.concatenate([seen, mark]) if len(seen) < 1 << 20 else mark
            none = [None] * len(again)
            return pa.RecordBatch.from_arrays([pa.array([*got[:, 0].tolist(), *none], pa.int64()), pa.array([*got[:, 1].tolist(), *none], pa.int64()), pa.array([None] * len(got) + again, pa.int64())], names=["a", "b", "again"])

        for batch in batches:
            held.append(batch)
            name = np.column_stack([batch.column(c).to_numpy() for c in ("list", "i", "j")])
            same = np.flatnonzero((name != name[-1]).any(1)) if len(name) else []
            first = pa.Table.from_batches(held).slice(0, 1) if len(held) > 1 and len(name) else None
            changed = len(same) or first is not None and any(first.column(c)[0].as_py() != v for c, v in zip(("list", "i", "j"), name[-1].tolist()))
            if changed:  # all but the last tile, which may go on
                t = pa.Table.from_batches(held)
                whole = len(t) - len(name) + (int(same[-1]) + 1 if len(same) else 0)
                yield emit(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held and sum(map(len, held)):
            yield emit(pa.Table.from_batches(held))

    return tiles.select("list", "i", "j", "key", "component", "chunk", "size", "sketch").mapInArrow(tidy(run), "a long, b long, again long")


def tiles_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (list, n, key, component) with sizes and sketches, each in the tiles of its list: pairs of chunks of some TILE sets."""
    rows = members.join(sets.select("key", "size", "sketch"), "key")
    rows = rows.withColumn("_c", F.expr(f"(n + {TILE - 1}) div {TILE}")).withColumn("chunk", F.expr("pmod(xxhash64(key), _c)"))
    rows = rows.withColumn("_o", F.explode(F.expr("sequence(0L, _c - 1)"))).withColumns({"i": F.least("chunk", "_o"), "j": F.greatest("chunk", "_o")})
    return rows.drop("_c", "_o").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")


def in_several(members: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """members (list, n, key) with their components, of the lists that lie in several."""
    rows = members.join(label, F.col("key") == label["node"], "left").select("list", "n", "key", F.coalesce("component", "key").alias("component"))
    several = rows.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("list")
    return stored(rows.join(several, "list", "left_semi"), f"{name}_members")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (its smallest node) of undirected edges (a, b): neighbours' minimum, then pointer jumping."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    n = 2 * edges.count()
    both = stored(both, f"{name}_edges", n)
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}_0", n)
    step = 0
    while True:
        step += 1
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        low = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        up = low.select(F.col("node").alias("_n"), F.col("component").alias("_up"))
        new = stored(low.join(up, low["component"] == up["_n"]).select("node", "_up", "old").withColumnRenamed("_up", "component"), f"{name}_{step}", n)
        changed = new.where("component <> old").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id, size of its set, component (smallest id reachable by links) of each row of docs."""
    spark = importable(docs.sparkSession)
    with scratch(spark):
        return kept(_near_duplicates(spark, docs, id_col, text_col, n, percent), "jaccard")


def _near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    base = stored(set_table(docs, id_col, text_col, n, percent), "jaccard_sets")
    sets = stored(base.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.max("short").alias("short")), "jaccard_keys")
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SIGNATURES_PER_PART)
    lists = stored(signature_lists(docs, text_col, n, percent, n_parts), "jaccard_lists")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        with scratch(spark):
            return kept(similar(pairs, sets, docs, id_col, text_col, n, percent, name), f"{name}_links")

    pairs = lambda found, name: stored(found.where("a IS NOT NULL").select("a", "b").distinct(), name, found.count())

    members = lists.select("list", F.size("members").cast("long").alias("n"), F.explode("members").alias("key"))
    found = stored(tiled_pairs(tiles_of(members.withColumn("component", F.col("key")), sets), percent, "few"), "jaccard_few")
    links = check(pairs(found, "few_pairs"), "few")
    if sets.where("short").limit(1).count():
        links = links.unionByName(check(stored(by_elements(docs, sets, text_col, n), "short_pairs"), "short"))
    again = stored(found.where("again IS NOT NULL").select(F.col("again").alias("list")).distinct(), "jaccard_again", found.count())
    label = components(links, "few")
    rest = members.join(again, "list", "left_semi")
    for how in ("forest", "all"):
        rest = in_several(rest.select("list", "n", "key"), label, how)
        if not rest.limit(1).count():
            break
        if how == "forest":
            fine = again_from_text(rest.select("key").distinct(), sets, docs, id_col, text_col, n, "sketch", "binary", lambda x: sketch(x, FINE))
            fine = stored(fine, "jaccard_fine")
        found = stored(tiled_pairs(tiles_of(rest, fine), percent, how), f"jaccard_{how}")
        links = links.unionByName(check(pairs(found, f"{how}_pairs"), how))
        label = components(links, how)

    docs_of = base.join(label, base["key"] == label["node"], "left").select("id", "size", F.coalesce("component", "key").alias("component"))
    docs_of = stored(docs_of, "jaccard_documents")
    least = docs_of.where("component IS NOT NULL").groupBy(F.col("component").alias("_c")).agg(F.min("id").alias("_least"))
    out = docs_of.join(least, docs_of["component"] == F.col("_c"), "left")
    return out.select("id", F.col("size").alias("n_shingles"), F.coalesce("_least", "id").alias("component_id"))


def by_elements(docs: DataFrame, sets: DataFrame, text_col: str, n: int) -> DataFrame:
    """All pairs of a set that falls short and another one with a common element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, text_col, 1_000_000):
                for x in shingles(batch.column(text_col), n):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), set_key(x))), pa.array(x.view(np.int64))], names=["key", "element"])

    every = stored(docs.select(text_col).mapInArrow(tidy(run), "key long, element long"), "jaccard_every").distinct()
    short = every.join(sets.where("short").select("key"), "key", "left_semi").withColumnRenamed("key", "_s")
    return every.join(short, "element").where("key <> _s").select(F.least("key", "_s").alias("a"), F.greatest("key", "_s").alias("b")).distinct()


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
