"""Vantage-point tree over float vectors (NumPy, in memory, batch queries).

A node holds a vantage vector and the median distance to it.  The distance from a
query to anything on the other side is at least ``|d(q, v) - median|``; a query
crosses only where that bound is at most its slack.  Slack equal to the distance of
its k-th neighbour is exact search; a share of it is the relaxed search.
"""

from __future__ import annotations

import numpy as np

FAR = 4.0


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``q`` to all rows of ``x``."""
    d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)
    return np.sqrt(np.maximum(d, 0.0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The candidate whose distances to a few points spread most.

    Candidates are points of the node and points far outside it along its widest
    directions; a vantage point may lie anywhere, and the farther the spread reaches,
    the fewer queries fall into the slack around the median.
    """
    some = x[rng.choice(len(x), min(len(x), 512), replace=False)].astype(np.float64)
    mean = some.mean(0)
    val, vec = np.linalg.eigh((some - mean).T @ (some - mean) / len(some))
    reach = FAR * np.sqrt(max(val.sum(), 1e-12))
    cand = np.concatenate([some[:4], mean + reach * vec[:, -3:].T]).astype(x.dtype)
    return cand[np.argmax(distances(cand, some.astype(x.dtype)).std(1))]


class Tree:
    """Inner nodes ``(vantage, median, left, right)``; negative children are ``~leaf``."""

    def __init__(self, x: np.ndarray, depth: int, least: int, seed: int = 0):
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.leaves: list[np.ndarray] = []
        self._rng = np.random.default_rng(seed)
        self.root = self._build(x, np.arange(len(x)), depth, least)

    def _leaf(self, idx: np.ndarray) -> int:
        self.leaves.append(idx)
        return ~(len(self.leaves) - 1)

    def _build(self, x: np.ndarray, idx: np.ndarray, depth: int, least: int) -> int:
        if depth == 0 or len(idx) < 2 * least:
            return self._leaf(idx)
        v = _vantage(x[idx], self._rng)
        d = distances(x[idx], v[None])[:, 0]
        m = float(np.median(d))
        inner = d <= m
        if inner.all():
            return self._leaf(idx)
        at = len(self.nodes)
        self.nodes.append((v, m, 0, 0))
        left = self._build(x, idx[inner], depth - 1, least)
        right = self._build(x, idx[~inner], depth - 1, least)
        self.nodes[at] = (v, m, left, right)
        return at

    def visits(self, q: np.ndarray, slack: np.ndarray):
        """Yield ``(leaf, rows of q, is_home)``; every row has exactly one home leaf."""
        stack = [(self.root, np.arange(len(q)), np.ones(len(q), bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows, home
                continue
            v, m, left, right = self.nodes[node]
            gap = distances(q[rows], v[None])[:, 0] - m
            inner, cross = gap <= 0, np.abs(gap) <= slack[rows]
            a, b = inner | cross, ~inner | cross
            stack.append((left, rows[a], (home & inner)[a]))
            stack.append((right, rows[b], (home & ~inner)[b]))


def nearest(x: np.ndarray, q: np.ndarray, k: int, relax: float, hint: float, leaf: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``x`` and exact distances of the k nearest of every query.

    ``hint`` bounds the k-th distance of most queries; those that turn out to have
    a greater one are searched again with the slack their own distance asks for.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, len(x) / leaf)))))
    tree = Tree(x, depth, least=max(8, leaf // 4), seed=len(x))
    keep = min(k + 4, len(x))
    best = np.full((len(q), keep), -1, np.int64)
    dist = np.full((len(q), keep), np.inf, np.float32)

    def run(rows: np.ndarray, slack: np.ndarray) -> None:
        best[rows], dist[rows] = -1, np.inf
        for lf, r, _ in tree.visits(q[rows], slack):
            pts = tree.leaves[lf]
            for at in range(0, len(r), 1024):
                own = rows[r[at : at + 1024]]
                d = distances(q[own], x[pts])
                if d.shape[1] > keep:
                    sel = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                    d = np.take_along_axis(d, sel, 1)
                    ids = pts[sel]
                else:
                    ids = np.broadcast_to(pts, d.shape)
                both = np.concatenate([dist[own], d], 1)
                names = np.concatenate([best[own], ids], 1)
                o = np.argpartition(both, keep - 1, axis=1)[:, :keep]
                dist[own], best[own] = np.take_along_axis(both, o, 1), np.take_along_axis(names, o, 1)

    run(np.arange(len(q)), np.full(len(q), relax * hint, np.float32))
    kth = np.sort(dist, axis=1)[:, min(k, keep) - 1]
    again = np.flatnonzero(kth > hint)
    if len(again) and tree.nodes:
        run(again, np.where(np.isfinite(kth[again]), relax * kth[again], np.inf))
    exact = np.empty(best.shape, np.float64)
    for at in range(0, len(q), 4096):
        b = best[at : at + 4096]
        diff = x[np.maximum(b, 0)].astype(np.float64) - q[at : at + 4096, None, :]
        exact[at : at + 4096] = np.where(b < 0, np.inf, np.sqrt((diff * diff).sum(2)))
    return best, exact
