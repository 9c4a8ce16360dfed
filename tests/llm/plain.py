"""Plain versions of what the operators compute."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

LOWER = {65 + i: 97 + i for i in range(26)}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs: dict[int, frozenset]) -> dict[int, int]:
    holders = defaultdict(list)
    for k, s in docs.items():
        for x in s:
            holders[x].append(k)
    up = {k: k for k in docs}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {p for v in holders.values() for p in combinations(sorted(v), 2)}:
        n = len(docs[a] & docs[b])
        if 100 * n >= 75 * (len(docs[a]) + len(docs[b]) - n) and root(a) != root(b):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {k: root(k) for k in docs}


def base_scores(texts: dict[int, str], train: set[int]) -> tuple[dict[int, float], int]:
    tokens = {k: [*words((t or "").translate(LOWER)), "\n"] for k, t in texts.items()}
    c = Counter(w for k in train for w in tokens[k])
    n = sum(c.values())
    return {k: sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws) for k, ws in tokens.items()}, n


class ContextTree:
    """Context-tree weighting over bytes, node by node."""

    def __init__(self, texts: list[str], depth: int):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for text in texts:
            for context, node, bit in self.bits(text):
                for d in range(depth + 1):
                    self.n[node, context[:d]][bit] += 1
        self.children = defaultdict(set)
        for node, context in list(self.n):
            if context:
                self.children[node, context[:-1]].add(context)
        self.cache = {}

    def bits(self, text: str):
        data = b"\n" * self.depth + " ".join(words(text.translate(LOWER))).encode() + b"\n"
        for i in range(self.depth, len(data)):
            context, node = bytes(data[i - 1 - k] for k in range(self.depth)), 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield context, node, bit
                node = node * 2 + bit

    def log_kt(self, key) -> float:
        a, b = self.n.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_pw(self, node: int, context: bytes) -> float:
        key = node, context
        if key not in self.cache:
            kt = self.log_kt(key)
            if len(context) < self.depth:
                low = sum(self.log_pw(node, c) for c in self.children.get(key, ()))
                top = max(kt, low)
                kt = top + math.log((math.exp(kt - top) + math.exp(low - top)) / 2)
            self.cache[key] = kt
        return self.cache[key]

    def probability(self, context: bytes, node: int, bit: int) -> float:
        p = None
        for d in range(self.depth, -1, -1):
            key = node, context[:d]
            a, b = self.n.get(key, (0, 0))
            kt = ((b if bit else a) + 0.5) / (a + b + 1)
            w = 1.0 if d == self.depth else math.exp(self.log_kt(key) - math.log(2) - self.log_pw(*key))
            p = kt if p is None else w * kt + (1 - w) * p
        return p

    def log10(self, text: str) -> float:
        return sum(math.log10(self.probability(*x)) for x in self.bits(text))


def water_levels(sizes: list[int], weights: list[int], epochs: int = 3) -> list[float]:
    """Targets by sharing the excess again and again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while free and rest > 1e-9:
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        rest = 0.0
        for i, x in share.items():
            target[i] += x
        for i in list(free):
            if target[i] >= epochs * sizes[i]:
                rest += target[i] - epochs * sizes[i]
                target[i] = float(epochs * sizes[i])
                free.discard(i)
    return target


def minimum_determinant(x, q) -> list[tuple[bool, float]]:
    """(kept, squared distance) of each row of x, as quality.outliers defines it, with NumPy."""
    import numpy as np

    added = np.diag([(f * q.UNIT) ** 2 for f in q.FLOOR])

    def low(values, share):
        values = np.sort(values)
        return values[math.ceil(len(values) * share) - 1]

    def moments(rows, share):
        c = np.cov(rows.T, bias=True) * q.consistency(round(share, 9), 5)
        return rows.mean(0), c + added

    def distances(m, c):
        d = x - m
        return np.maximum(np.round((d @ np.linalg.inv(c) * d).sum(1), 6), 0)

    middle = np.array([low(np.floor(v / 8) * 8 + 4, 0.5) for v in x.T])
    spread = np.array([low(np.floor(np.abs(v - m) / 8) * 8, 0.5) for v, m in zip(x.T, middle)]) * 1.4826
    width = np.sqrt(spread**2 + np.diag(added))
    drawn = np.round(np.tanh((x - middle) / width) * q.UNIT) / q.UNIT
    starts = [(middle, np.diag(spread**2) + added), moments(x, 1.0), (middle + drawn.mean(0) * width, np.cov(drawn.T, bias=True) * np.outer(width, width) + added)]

    def step(m, c, det):
        bins = np.floor(np.log1p(distances(m, c)) * q.BINS)
        inside = bins <= low(bins, q.SUBSET)
        share = inside.mean()
        at = min(max(share, 0.5), 1.0) * 100 - 50
        k = min(math.floor(at), 49)
        factor = q.consistency((50 + k) / 100, 5) * (1 - (at - k)) + q.consistency((51 + k) / 100, 5) * (at - k)
        m2, c2 = x[inside].mean(0), np.cov(x[inside].T, bias=True) * factor + added
        new = np.linalg.slogdet(c2)[1]
        return (m2, c2, new, True) if new < det - 1e-9 else (m, c, det, False)

    found = []
    for m, c in starts:
        det, moved = 1e300, True
        for _ in range(q.SCREENING):
            if moved:
                m, c, det, moved = step(m, c, det)
        found.append((det, len(found), m, c, moved))
    det, _, m, c, moved = min(found, key=lambda f: f[:2])
    while moved:
        m, c, det, moved = step(m, c, det)
    near = x[distances(m, c) <= q.chi2_point(0.975, 5)]
    d2 = distances(*moments(near, 0.975))
    return [(bool(d <= q.chi2_point(q.REJECT, 5)), float(d)) for d in d2]
