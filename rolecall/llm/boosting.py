"""Small gradient-boosted trees on binned features, fitted on weighted rows: equal rows may come as one."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Boosted trees with logistic loss; ``probability`` is calibrated on rows that the trees have not seen."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 16
    ridge: float = 1.0
    cuts: list[np.ndarray] = field(default_factory=list)
    #: Per tree and node: feature and bin to go right beyond (feature -1: leaf), value.
    trees: list[np.ndarray] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)
    #: Rows that the trees were fitted on and calibrated with.
    weight: float = 0.0

    def cut(self, feature: np.ndarray, values: np.ndarray, n: np.ndarray) -> None:
        """Bins from ``n`` rows of each value of each feature."""
        points = np.linspace(0, 1, self.bins + 1)[1:-1]
        for f in range(feature.max() + 1):
            own = feature == f
            self.cuts.append(np.unique(np.quantile(values[own], points, weights=n[own], method="inverted_cdf")))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return self._binned(x).astype(np.uint8)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, int)

    def fit(self, b: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray) -> Boosted:
        """Trees from ``n`` rows of each of the ``binned`` rows ``b``; ``held`` ones calibrate."""
        grow = ~held
        self.weight = float(n.sum())
        raw = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw[grow]))
            self.trees.append(self._tree(b[grow], (p - y[grow]) * n[grow], np.maximum(p * (1 - p), 1e-6) * n[grow]))
            raw += self._leaf(self.trees[-1], b)
        # Platt scaling by Newton steps, with one made-up case of each class so that it stays finite.
        s = np.concatenate([raw[held], [raw.max(initial=1.0), raw.min(initial=-1.0)]])
        t = np.concatenate([y[held], [1, 0]])
        m = np.concatenate([n[held], [1, 1]])
        a, c = 1.0, 0.0
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-9) * m
            h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, [((p - t) * s).sum() + 1e-3 * a, (p - t).sum()])
            a, c = a - step[0], c - step[1]
        self.scale = (float(a), float(c))
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        tree = np.zeros((2 ** (self.depth + 1) - 1, 3))
        tree[:, 0] = -1
        node = np.zeros(len(g), int)
        gain_of = lambda gs, hs: gs * gs / (hs + self.ridge)
        for at in range(len(tree)):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            tree[at, 2] = -self.rate * total_g / (total_h + self.ridge)
            if 2 * at + 2 >= len(tree):
                continue
            best = (1e-6, -1, 0)
            for f in range(b.shape[1]):
                gs = np.cumsum(np.bincount(b[rows, f], weights=g[rows], minlength=self.bins))[:-1]
                hs = np.cumsum(np.bincount(b[rows, f], weights=h[rows], minlength=self.bins))[:-1]
                gain = gain_of(gs, hs) + gain_of(total_g - gs, total_h - hs) - gain_of(total_g, total_h)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, k))
            if best[1] >= 0:
                tree[at, :2] = best[1:]
                node[rows] = np.where(b[rows, best[1]] > best[2], 2 * at + 2, 2 * at + 1)
        return tree

    @staticmethod
    def _leaf(tree: np.ndarray, b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), int)
        while (moving := tree[node, 0] >= 0).any():
            f, k = tree[node, 0].astype(int), tree[node, 1]
            right = b[np.arange(len(b)), np.maximum(f, 0)] > k
            node = np.where(moving, 2 * node + 1 + right, node)
        return tree[node, 2]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self._binned(x))

    def chance(self, b: np.ndarray) -> np.ndarray:
        """Probability of ``binned`` rows."""
        raw = sum((self._leaf(t, b) for t in self.trees), np.zeros(len(b)))
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * raw + self.scale[1], -30, 30)))
