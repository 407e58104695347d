"""Gradient-boosted trees for two classes on histograms (logistic loss)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Each tree looks at a random part (``share``) of the columns."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0,
                 ridge: float = 1.0, share: float = 1.0, seed: int = 3):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.share, self.seed = share, seed
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        self.edges = [self._edges(x[:, j]) for j in range(f)]
        codes = self._codes(x)
        rng, take = np.random.default_rng(self.seed), max(1, round(self.share * f))
        # columns of two values need one sum each, the others a histogram; columns of one value say nothing
        kinds = np.array([len(e) for e in self.edges])
        flags = codes.astype(np.float32)
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(p0 / (1 - p0)))
        score = np.full(n, self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            cols = np.sort(rng.choice(f, take, replace=False))
            many, two = cols[kinds[cols] > 1], cols[kinds[cols] == 1]
            tree = self._grow(codes, codes[:, many] + np.arange(len(many)) * self.bins, flags[:, two], many, two, grad, hess)
            self.trees.append(tree)
            score += self._leaf_values(tree, codes)
        self._settle()
        return self

    def _settle(self) -> None:
        """Lay the trees out for scoring: only the columns some tree asks about,
        and every tree complete (a leaf above the last level asks nothing and hands its
        value down), so all trees of a row take their steps together."""
        self.used = sorted({int(j) for feature, _, _ in self.trees for j in feature if j >= 0})
        place = {j: i for i, j in enumerate(self.used)}
        inner = 2 ** self.depth - 1
        asks, cuts, ends = [], [], []
        for feature, cut, value in self.trees:
            ask, limit, value = np.zeros(inner, np.int32), np.full(inner, self.bins, np.int32), value.copy()
            for slot in range(inner):
                if feature[slot] >= 0:
                    ask[slot], limit[slot] = place[int(feature[slot])], cut[slot]
                else:
                    feature[2 * slot + 1] = feature[2 * slot + 2] = -1
                    value[2 * slot + 1] = value[2 * slot + 2] = value[slot]
            asks.append(ask)
            cuts.append(limit)
            ends.append(value[inner:])
        self.asks, self.cuts, self.ends = (np.concatenate(v) if v else np.zeros(0) for v in (asks, cuts, ends))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _edges(self, values: np.ndarray) -> np.ndarray:
        """Cut points between distinct values where they are few (rare values
        of a flag count too), else quantiles."""
        distinct = np.unique(values)
        if len(distinct) <= self.bins:
            return (distinct[1:] + distinct[:-1]) / 2
        return np.unique(np.quantile(values, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _grow(self, codes, flat, flags, many, two, grad, hess):
        """Complete tree by levels: feature, bin and value of every slot."""
        n = len(codes)
        slots = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(slots, -1), np.zeros(slots, dtype=int), np.zeros(slots)
        at = np.zeros(n, dtype=int)
        sums = np.stack([grad, hess], axis=1).astype(np.float32)
        for level in range(self.depth + 1):
            for slot in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.nonzero(at == slot)[0]
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[slot] = self.rate * g / (h + self.ridge)
                if level == self.depth or len(rows) < 8:
                    continue

                def gain(left_g, left_h, g=g, h=h):
                    out = (left_g ** 2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge)
                           - g ** 2 / (h + self.ridge))
                    return np.where((left_h < self.least) | (h - left_h < self.least), 0, out)

                where, k = flat[rows].ravel(), len(many)
                hg = np.bincount(where, np.repeat(grad[rows], k), k * self.bins).reshape(k, self.bins).cumsum(1)
                hh = np.bincount(where, np.repeat(hess[rows], k), k * self.bins).reshape(k, self.bins).cumsum(1)
                binned = gain(hg, hh)
                best = int(binned.argmax()) if k else 0
                top, choice = (binned.flat[best], (many[best // self.bins], best % self.bins)) if k else (0.0, None)
                if len(two):
                    set_g, set_h = (flags[rows].T @ sums[rows]).astype(np.float64).T
                    flagged = gain(g - set_g, h - set_h)
                    if flagged.max() > top:
                        top, choice = flagged.max(), (two[int(flagged.argmax())], 0)
                if top <= 1e-6:
                    continue
                feature[slot], cut[slot] = choice
                at[rows] = 2 * slot + 1 + (codes[rows, feature[slot]] > cut[slot])
        return feature, cut, value

    def _leaf_values(self, tree, codes):
        feature, cut, value = tree
        at = np.zeros(len(codes), dtype=int)
        rows = np.arange(len(codes))
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            at = np.where(go, 2 * at + 1 + (codes[rows, np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def log_odds(self, x: np.ndarray, at_once: int = 512) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if not self.used:
            return out + self.ends.reshape(len(self.trees), -1)[:, 0].sum() if self.trees else out
        codes = np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in self.used], axis=1).astype(np.int32)
        width, inner, leaves = len(self.used), 2 ** self.depth - 1, 2 ** self.depth
        tree = np.arange(len(self.trees), dtype=np.int32)
        for lo in range(0, len(x), at_once):
            part = np.ascontiguousarray(codes[lo:lo + at_once]).ravel()
            row = (np.arange(len(part) // width, dtype=np.int32) * width)[:, None]
            at = np.zeros((len(row), len(tree)), dtype=np.int32)
            for _ in range(self.depth):
                slot = tree * inner + at
                at = 2 * at + 1 + (part.take(row + self.asks.take(slot)) > self.cuts.take(slot))
            out[lo:lo + at_once] += self.ends.take(tree * leaves + at - inner).sum(axis=1)
        return out
