"""Gradient-boosted trees for binary targets: logistic loss, splits by histograms, a few levels; numpy only.

Features are whole numbers from 0, put into the fixed bins of `CUTS`, so equal rows can be counted instead of kept. Trees grow level by level from
sums over all rows, wherever these lie: `sums` of any parts of the rows add up exactly, as slopes and bends are whole numbers of 1/UNIT."""

from __future__ import annotations

import numpy as np

CUTS = np.array([*range(24), 26, 30, 36, 44, 56, 72, 96], dtype=float)
BINS, UNIT = CUTS.size + 1, float(1 << 20)


def binned(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(CUTS, x, side="left").astype(np.uint8)


def _at(tree: list, x: np.ndarray) -> np.ndarray:
    """The node of each row: a leaf, or one that isn't split yet (None)."""
    out, work = np.zeros(x.shape[0], np.int64), [(0, np.arange(x.shape[0]))]
    while work:
        at, rows = work.pop()
        if tree[at] is None or len(tree[at]) == 1:
            out[rows] = at
        else:
            j, cut, left, right = tree[at]
            goes = x[rows, j] <= cut
            work += [(left, rows[goes]), (right, rows[~goes])]
    return out


class BoostedTrees:
    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.start, self.trees = 0.0, []

    def margin(self, x: np.ndarray, first: int = 0) -> np.ndarray | float:
        """What the trees from `first` on add up to, on binned rows."""
        return sum(np.array([n[0] if len(n) == 1 else 0.0 for n in t])[_at(t, x)] for t in self.trees[first:])

    def sums(self, tree: list, waiting: list[int], x: np.ndarray, y: np.ndarray, n: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """Slopes and bends by waiting node, feature and bin, of binned rows that occur n times."""
        p = 1 / (1 + np.exp(-(self.start + margin)))
        slot = np.full(len(tree), -1)
        slot[waiting] = np.arange(len(waiting))
        slot = slot[_at(tree, x)]
        used = np.flatnonzero(slot >= 0)
        slot, x, p, y, n = slot[used] * BINS, x[used], p[used], y[used], n[used].astype(float)
        both = n * np.rint((y - p) * UNIT), n * np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT)
        out = np.zeros((2, len(waiting), x.shape[1], BINS))
        for j in range(x.shape[1]):
            key = slot + x[:, j]
            for i, weights in enumerate(both):
                out[i, :, j] = np.bincount(key, weights=weights, minlength=len(waiting) * BINS).reshape(-1, BINS)
        return out

    def grow(self, told, positive: int, total: int) -> BoostedTrees:
        """told(tree, waiting): `sums` over all rows."""
        mean = np.clip(positive / total, 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        for _ in range(self.rounds):
            tree, waiting = [None], [0]
            for depth in range(self.depth):
                slopes, bends = told(tree, waiting) / UNIT
                children = []
                for at, g_of, h_of in zip(waiting, slopes, bends, strict=True):
                    g, h = g_of[0].sum(), h_of[0].sum()
                    left_g, left_h = np.cumsum(g_of, axis=1)[:, :-1], np.cumsum(h_of, axis=1)[:, :-1]
                    value = left_g**2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge) - g**2 / (h + self.ridge)
                    value = np.where((left_h >= self.least) & (h - left_h >= self.least), value, 0)
                    j, cut = divmod(int(np.argmax(value)), BINS - 1)
                    if value[j, cut] <= 1e-6:
                        tree[at] = (self._leaf(g, h),)
                        continue
                    tree[at] = (j, cut, len(tree), len(tree) + 1)
                    halves = [(left_g[j, cut], left_h[j, cut]), (g - left_g[j, cut], h - left_h[j, cut])]
                    if depth + 1 < self.depth:
                        children += [len(tree), len(tree) + 1]
                        tree += [None, None]
                    else:
                        tree += [(self._leaf(*x),) for x in halves]
                waiting = children
                if not waiting:
                    break
            self.trees.append(tree)
        return self

    def _leaf(self, g: float, h: float) -> float:
        return float(self.rate * g / (h + self.ridge))

    def fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> BoostedTrees:
        """x: binned rows that occur n times each."""
        margin, known = np.zeros(y.size), 0

        def told(tree, waiting):
            nonlocal margin, known
            margin, known = margin + self.margin(x, known), len(self.trees)
            return self.sums(tree, waiting, x, y, n, margin)

        return self.grow(told, int(n[y == 1].sum()), int(n.sum()))

    def likely(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + self.margin(x))))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.likely(binned(x))
