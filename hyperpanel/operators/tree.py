"""Space-partitioning tree over an embedding, as numpy arrays built level by level.

Points are sorted by the interleaved bits of their coordinates, so every cell
of every level is a run of the sorted points; a cell keeps mass, centre of mass
and half width. Works in any number of dimensions; masses make it weighted.
"""

from __future__ import annotations

import numpy as np


class Tree:
    def __init__(self, y: np.ndarray, weights: np.ndarray | None = None, depth: int = 20):
        n, dims = y.shape
        w = np.ones(n) if weights is None else weights
        self.centre = y.mean(0)
        self.half = np.abs(y - self.centre).max(0) + 1e-5
        depth = min(depth, 60 // dims)
        grid = np.minimum(((y - self.centre + self.half) / (2 * self.half) * (1 << depth)).astype(np.uint64), np.uint64((1 << depth) - 1))
        key = np.zeros(n, np.uint64)
        for b in range(depth - 1, -1, -1):
            for d in range(dims):
                key = key << np.uint64(1) | grid[:, d] >> np.uint64(b) & np.uint64(1)
        self.order = np.argsort(key, kind="stable")
        key, ys, ws = key[self.order], y[self.order], w[self.order]
        mass, moment = np.concatenate([[0], np.cumsum(ws)]), np.concatenate([np.zeros((1, dims)), np.cumsum(ys * ws[:, None], axis=0)])
        #: Levels: starts of cells in the sorted points, and of their children in the next level.
        self.starts: list[np.ndarray] = []
        for level in range(depth + 1):
            cell = key >> np.uint64(dims * (depth - level))
            self.starts.append(np.append(np.flatnonzero(np.diff(cell, prepend=cell[0] + np.uint64(1)) != 0) if n else np.zeros(0, int), n))
            if len(self.starts[-1]) == n + 1:
                break
        self.mass = [mass[s[1:]] - mass[s[:-1]] for s in self.starts]
        self.com = [(moment[s[1:]] - moment[s[:-1]]) / np.maximum(m, 1e-300)[:, None] for s, m in zip(self.starts, self.mass, strict=True)]
        self.children = [np.searchsorted(b, a) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]

    @property
    def depth(self) -> int:
        return len(self.starts)

    def check(self) -> bool:
        """Do the masses of each level agree."""
        return all(np.isclose(m.sum(), self.mass[0].sum()) for m in self.mass)

    def repulsion(self, y: np.ndarray, weights: np.ndarray, theta: float) -> tuple[np.ndarray, float]:
        """(forces, Z): a cell stands for its points if it is a single one, or its half width over the distance is below theta."""
        f, z = self.sums(y, weights, np.arange(len(y)), weights, theta)
        return f, float(z.sum())

    def sums(self, y: np.ndarray, weights: np.ndarray, own: np.ndarray, left_out: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """(forces, z) on points y, each without its ``own`` point of the tree, whose mass ``left_out`` is taken from runs of equal points."""
        n, dims = y.shape
        f, z = np.zeros_like(y), np.zeros(n)
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        place = place[own]
        who, cell = np.arange(n), np.zeros(n, np.int64)
        last = len(self.starts) - 1
        for level, starts in enumerate(self.starts):
            size = starts[cell + 1] - starts[cell]
            gap = y[who] - self.com[level][cell]
            d2 = (gap * gap).sum(1)
            width = self.half.max() / (1 << level)
            inside = (place[who] >= starts[cell]) & (place[who] < starts[cell + 1])
            single = size == 1
            done = single | (~inside & (width * width < theta * theta * d2)) | (level == last)
            use = done & ~(single & inside)
            m = self.mass[level][cell[use]] - np.where(inside[use], left_out[who[use]], 0)  # a run of equal points holds the point itself
            m = m * weights[who[use]]
            q = 1 / (1 + d2[use])
            z += np.bincount(who[use], m * q, n)
            for d in range(dims):
                f[:, d] += np.bincount(who[use], m * q * q * gap[use, d], n)
            if level == last:
                break
            who, cell = who[~done], cell[~done]
            first, count = self.children[level][cell], self.children[level][cell + 1] - self.children[level][cell]
            ends = np.cumsum(count)
            cell = np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
            who = np.repeat(who, count)
        return f, z
