"""Agglomerative clustering of vectors without a matrix of their distances: memory grows with the rows, not their square."""

from __future__ import annotations

import numpy as np

#: Rows of one block of distances, and clusters looked at anew in one go.
ROWS, AGAIN = 256, 8


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


class _Clusters:
    """Clusters in the order of their first rows, with their distances to others from centres or, for complete linkage, from all members."""

    def __init__(self, x: np.ndarray, linkage: str):
        self.linkage = linkage
        self.c = x.astype(float).copy() if linkage == "ward" else unit_rows(x.astype(float))
        self.w = np.ones(len(x))
        self.sq = (self.c**2).sum(1)
        if linkage == "complete":
            self.points, self.slot = self.c, np.arange(len(x))
            self.members = [np.array([i]) for i in range(len(x))]

    def far(self, which: np.ndarray, start: int = 0) -> np.ndarray:
        """Distances of some clusters to those from ``start`` on."""
        if self.linkage == "complete":
            return np.stack([self._complete(self.members[i]) for i in which])[:, start:]
        dot = self.c[which] @ self.c[start:].T
        if self.linkage == "average":
            return 1 - dot
        both = self.w[which][:, None] + self.w[None, start:]
        return np.maximum(self.sq[which][:, None] + self.sq[None, start:] - 2 * dot, 0) * (self.w[which][:, None] * self.w[None, start:] / both)

    def _complete(self, mine: np.ndarray) -> np.ndarray:
        least = np.full(len(self.points), np.inf)
        for s in range(0, len(mine), ROWS):
            np.minimum(least, (self.points[mine[s : s + ROWS]] @ self.points.T).min(0), out=least)
        out = np.full(len(self.w), np.inf)
        np.minimum.at(out, self.slot[self.slot >= 0], least[self.slot >= 0])
        return 1 - out

    def merge(self, i: int, j: int) -> None:
        if self.linkage == "complete":
            self.slot[self.members[j]] = i
            self.members[i], self.members[j] = np.concatenate([self.members[i], self.members[j]]), np.empty(0, int)
        else:
            self.c[i] = (self.w[i] * self.c[i] + self.w[j] * self.c[j]) / (self.w[i] + self.w[j])
            self.sq[i] = self.c[i] @ self.c[i]
        self.w[i] += self.w[j]

    def keep(self, stay: np.ndarray) -> None:
        self.w = self.w[stay]
        if self.linkage == "complete":
            self.members = [self.members[i] for i in np.flatnonzero(stay)]
            place = np.where(stay, np.cumsum(stay) - 1, -1)
            self.slot = np.where(self.slot >= 0, place[self.slot], -1)
        else:
            self.c, self.sq = self.c[stay], self.sq[stay]


def merges_of_vectors(x: np.ndarray, k: int = 1, linkage: str = "average", max_size: int | None = None) -> list[tuple[int, int]]:
    """The merges of ``hac_merges`` over cosine distances (ward: over halved squared ones), without their matrix.

    A cluster keeps its nearest later one.  Merging brings no two clusters nearer, so
    what was known of a cluster whose nearest one has changed is a lower bound; it is
    looked at again only when no other pair is nearer.
    """
    n = len(x)
    state, ids = _Clusters(x, linkage), np.arange(n)
    near, at, stale, dead = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), np.zeros(n, bool)
    merges: list[tuple[int, int]] = []

    def look(which: np.ndarray, start: int) -> None:
        d = state.far(which, start)
        place = np.arange(start, len(near))
        out = (place[None] <= which[:, None]) | dead[None, start:]
        if max_size is not None:
            out |= state.w[which][:, None] + state.w[None, start:] > max_size
        d[out] = np.inf
        best = d.argmin(1)
        near[which], at[which], stale[which] = d[np.arange(len(which)), best], best + start, False

    if linkage == "complete":  # of single rows it is the same as the average
        first, state.linkage = state.linkage, "average"
    for s in range(0, n, ROWS):
        look(np.arange(s, min(s + ROWS, n)), s)
    if linkage == "complete":
        state.linkage = first
    while n - len(merges) > k:
        i = int(near.argmin())
        if not np.isfinite(near[i]):
            break
        if stale[i]:
            sure = near[~stale].min(initial=np.inf)
            again = np.flatnonzero(stale & (near < sure))
            again = np.sort(again[np.argpartition(near[again], AGAIN)[:AGAIN]] if len(again) > AGAIN else again) if near[i] < sure else np.array([i])
            look(again, int(again[0]))
            continue
        j = int(at[i])
        merges.append((int(ids[i]), int(ids[j])))
        state.merge(i, j)
        dead[j], near[j], stale[j] = True, np.inf, False
        stale |= ((at == i) | (at == j)) & ~dead
        stale[i] = True
        if dead.sum() * 4 > len(dead) > ROWS:
            stay = ~dead if max_size is None else ~dead & (state.w < max_size)
            place = np.cumsum(stay) - 1
            at = np.where(stay[np.maximum(at, 0)], place[np.maximum(at, 0)], -1)[stay]
            state.keep(stay)
            near, stale, ids, dead = near[stay], stale[stay], ids[stay], dead[stay]
            if not len(near):
                break
    return merges
