"""Gradient-boosted regression trees for a binary label, on histograms; numpy only."""

from __future__ import annotations

BINS = 32


class Boosted:
    """Trees of a fixed depth stored as heaps, so a batch of rows walks down all nodes of a level at once."""

    def __init__(self, x, y, weights=None, trees: int = 40, depth: int = 4, rate: float = 0.2, least: float = 8.0, ridge: float = 1.0) -> None:
        import numpy as np

        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        w = np.ones(len(y)) if weights is None else weights
        mean = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.base)
        self.features, self.cuts, self.leaves = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
            at = np.zeros(len(y), np.int64)
            for level in range(depth):
                first = 2**level - 1
                for node in range(first, 2 * first + 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) >= 2 * least:
                        feature[node], cut[node] = self._split(binned[rows], grad[rows], hess[rows], least, ridge)
                at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**depth - 1)
            g = np.bincount(leaf, grad, 2**depth)
            h = np.bincount(leaf, hess, 2**depth)
            values = -rate * g / (h + ridge)
            raw += values[leaf]
            self.features.append(feature)
            self.cuts.append(cut)
            self.leaves.append(values)

    def _bin(self, x):
        import numpy as np

        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    @staticmethod
    def _split(binned, grad, hess, least, ridge) -> tuple[int, int]:
        import numpy as np

        best, found = 1e-6, (0, 255)
        g, h = grad.sum(), hess.sum()
        for j in range(binned.shape[1]):
            gl = np.cumsum(np.bincount(binned[:, j], grad, BINS))[:-1]
            hl = np.cumsum(np.bincount(binned[:, j], hess, BINS))[:-1]
            nl = np.cumsum(np.bincount(binned[:, j], minlength=BINS))[:-1]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(nl < least) | (len(binned) - nl < least)] = 0
            if gain.max() > best:
                best, found = gain.max(), (j, int(gain.argmax()))
        return found

    def logits(self, x):
        import numpy as np

        binned, raw, rows = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, values in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            raw += values[at - (2**self.depth - 1)]
        return raw
