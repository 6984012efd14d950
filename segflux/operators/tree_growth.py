"""One regression tree: grown level by level on a bounded sample, walked, and its out-of-bag errors.

All nodes of a level are split at once.  For every tried predictor the rows are sorted by (node, rank of the
value) as packed integers, so a split is a cumulative sum over each node's run of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node arrays.  A leaf has feature -1; the right child of a node follows its left one."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        # For walking, a leaf is its own left child and no value exceeds its threshold.
        leaf = self.feature < 0
        self._feature = np.where(leaf, 0, self.feature).astype(np.int64)
        self._threshold = np.where(leaf, np.inf, self.threshold)
        self._left = np.where(leaf, np.arange(len(leaf)), self.left).astype(np.int64)
        self._leaf = leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(x).ravel()
        end = np.zeros(len(x), dtype=np.int64)
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        base = rows * x.shape[1]
        while len(rows):
            for _ in range(STEPS):
                node = self._left.take(node) + (flat.take(base + self._feature.take(node)) > self._threshold.take(node))
            on = ~self._leaf.take(node)
            end[rows] = node
            rows, node, base = rows[on], node[on], base[on]
        return self.value[end]


STEPS = 3
"""Levels a walk goes down between two looks at which rows have reached a leaf."""
MOST_ROWS = 1 << 16
"""Rows of a sample; node, rank and row are packed into one integer."""


class Sample:
    """Training rows with the ranks of every predictor, shared by all trees of a task."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        if len(y) > MOST_ROWS:
            raise ValueError(f"a sample holds at most {MOST_ROWS} rows")
        self.x, self.y = x, y
        self.ranks = np.empty(x.shape[::-1], dtype=np.int64)
        for j in range(x.shape[1]):
            self.ranks[j] = np.unique(x[:, j], return_inverse=True)[1] << 16

    def bootstrap(self, rng: np.random.Generator) -> np.ndarray:
        """How often each row is drawn when as many are drawn as there are; 0 is out of bag."""
        n = len(self.y)
        return np.bincount(rng.integers(0, n, n), minlength=n).astype(np.float64)

    def grow(self, weight: np.ndarray, rng: np.random.Generator, tries: int, least: int) -> Tree:
        """Nodes of more than ``least`` drawn rows take the best split of ``tries`` random predictors.

        The best split leaves the smallest squared error; its threshold lies half-way between values.
        """
        p = self.x.shape[1]
        tries = min(tries, p)
        drawn_y = weight * self.y
        rows = np.flatnonzero(weight)
        run = np.zeros(len(rows), dtype=np.int64)  # position of each row's node in ``nodes``
        total = weight.sum()
        feature, threshold, left = [-1], [0.0], [0]
        value = [float(drawn_y.sum() / total)] if total else [0.0]
        nodes = np.zeros(1 if total > least else 0, dtype=np.int64)
        while len(nodes):
            m, width = len(rows), len(nodes)
            tried = rng.random((width, p)).argpartition(tries - 1, axis=1)[:, :tries]
            packed = (run << 32) + self.ranks[tried[run].T, rows] + rows
            packed.sort(axis=1)
            here, rank = packed & 0xFFFF, packed >> 16
            sizes = np.bincount(run, minlength=width)
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            run = np.repeat(np.arange(width), sizes)
            n_low, y_low = np.cumsum(weight[here], axis=1), np.cumsum(drawn_y[here], axis=1)
            all_n, all_y = np.diff(n_low[0, ends], prepend=0.0), np.diff(y_low[0, ends], prepend=0.0)
            n_low[:, sizes[0] :] -= n_low[:, ends[:-1]][:, run[sizes[0] :] - 1]
            y_low[:, sizes[0] :] -= y_low[:, ends[:-1]][:, run[sizes[0] :] - 1]
            # A split lies between different ranks of one node; the node is part of the packed rank.
            open_ = np.zeros((tries, m), dtype=bool)
            open_[:, :-1] = rank[:, :-1] != rank[:, 1:]
            open_[:, ends] = False
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = y_low**2 / n_low + (all_y[run] - y_low) ** 2 / (all_n[run] - n_low)
            gain[~open_] = -np.inf
            best = np.maximum.reduceat(gain, starts, axis=1)
            which = best.argmax(axis=0)
            best = best[which, np.arange(width)]
            alone = all_y**2 / all_n
            k = np.flatnonzero(best > alone + 1e-12 * np.maximum(1.0, np.abs(alone)))
            hits = np.flatnonzero(gain[which[run], np.arange(m)] == best[run])
            owner, first = np.unique(run[hits], return_index=True)
            where = np.zeros(width, dtype=np.int64)
            where[owner] = hits[first]
            at, way = where[k], which[k]
            f = tried[k, way]
            low, high = self.x[here[way, at], f], self.x[here[way, np.minimum(at + 1, m - 1)], f]
            middle = low + (high - low) / 2
            middle = np.where(middle < high, middle, low)
            child = len(feature) + 2 * np.arange(len(k))
            for node, *split in zip(nodes[k].tolist(), f.tolist(), middle.tolist(), child.tolist()):
                feature[node], threshold[node], left[node] = split
            n_l, y_l = n_low[way, at], y_low[way, at]
            n_2 = np.stack((n_l, all_n[k] - n_l), axis=1).ravel()
            value += (np.stack((y_l, all_y[k] - y_l), axis=1).ravel() / n_2).tolist()
            feature += [-1] * len(n_2)
            threshold += [0.0] * len(n_2)
            left += [0] * len(n_2)
            # Rows move on to the children that are large enough.
            grows = n_2 > least
            number = np.where(grows, np.cumsum(grows) - 1, -1)
            of, cut, place = (np.zeros(width, dtype=t) for t in (np.int64, np.float64, np.int64))
            of[k], cut[k], place[k] = f, middle, 2 * np.arange(len(k))
            stays = np.zeros(width, dtype=bool)
            stays[k] = True
            rows, run = here[0][stays[run]], run[stays[run]]
            run = number[place[run] + (self.x[rows, of[run]] > cut[run])] if len(k) else run
            rows, run = rows[run >= 0], run[run >= 0]
            nodes = (child[:, None] + [0, 1]).ravel()[grows] if len(k) else nodes[:0]
        return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(value))

    def out_of_bag(self, tree: Tree, weight: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
        """Mean squared error of the rows the tree never saw, and its rise when one predictor is permuted."""
        x, y = self.x[weight == 0], self.y[weight == 0]
        p = self.x.shape[1]
        if not len(y):
            return float("nan"), np.full(p, np.nan)
        base = float(((y - tree.predict(x)) ** 2).mean())
        rise = np.zeros(p)
        used = set(tree.feature.tolist())
        for j in range(p):
            mixed = x[rng.permutation(len(y)), j]
            if j in used:
                other = x.copy()
                other[:, j] = mixed
                rise[j] = ((y - tree.predict(other)) ** 2).mean() - base
        return base, rise
