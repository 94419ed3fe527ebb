"""An incomplete factorisation of a graph's Laplacian, as a preconditioner where levels hang together by few others.

Nodes are eliminated in rounds. A round takes nodes of few neighbours, no two of which are neighbours, so its work is on
arrays. A node's elimination joins its neighbours to one another: those of one or two neighbours exactly (so trees, chains and
rings are solved, not approximated), others by one edge drawn for each neighbour but the last, in the order of weights, to a
heavier one with odds as the weights, at a weight which makes the expected Laplacian that of the exact elimination. Edges
therefore never become more. The last few nodes are solved as a dense matrix. Where a round takes but a small share of the nodes, what is
left is so closely knit that its diagonal will do. Draws come from a fixed seed, so results repeat.
"""

from __future__ import annotations

import numpy as np

#: Nodes that are left to a dense matrix.
LAST = 600
#: A round that would take a smaller share of the nodes isn't made.
LEAST_SHARE = 0.04


class LaplacianFactor:
    """An approximate solver of L z = r, L being the Laplacian of n nodes and edges (u, v, w > 0), which may be many components.

    Repeated edges add up. The solver is symmetric and never negative. z is fixed only up to a constant in each component; r is taken to add up to zero in each component.
    """

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n, self.steps = n, []
        some = (u != v) & (w > 0)
        u, v, w = _summed(n, u[some], v[some], w[some])
        while len(u):
            active = np.unique(np.concatenate([u, v]))
            if len(active) <= LAST:
                break
            degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
            low = max(2.0, 1.5 * degree[active].mean())
            # of two neighbours with few others, the one with fewer goes first, then lots decide
            turn = np.where(degree <= low, (degree + rng.random(n)), np.inf)
            first = np.full(n, np.inf)
            np.minimum.at(first, u, turn[v])
            np.minimum.at(first, v, turn[u])
            goes = (degree > 0) & np.isfinite(turn) & (turn < first)
            if goes.sum() < LEAST_SHARE * len(active):
                break
            out_u, out_v = goes[u], goes[v]
            going = np.concatenate([u[out_u], v[out_v]])
            met, weight = np.concatenate([v[out_u], u[out_v]]), np.concatenate([w[out_u], w[out_v]])
            order = np.lexsort((weight, going))
            going, met, weight = going[order], met[order], weight[order]
            nodes, begin, size = np.unique(going, return_index=True, return_counts=True)
            place = np.repeat(np.arange(len(nodes)), size)
            total = np.add.reduceat(weight, begin)
            self.steps.append((nodes, total, place, met, weight / total[place]))
            new = self._joined(rng, met, weight, begin, size, place, total)
            stay = ~(out_u | out_v)
            u, v, w = _summed(n, *(np.concatenate([a[stay], b]) for a, b in zip((u, v, w), new, strict=True)))
        self.last = np.unique(np.concatenate([u, v])) if len(u) else np.zeros(0, np.int64)
        if len(self.last) > LAST:
            total = (np.bincount(u, w, n) + np.bincount(v, w, n))[self.last]
            none = np.zeros(0, np.int64)
            self.steps.append((self.last, total, none, none, np.zeros(0)))
            self.last, u, v, w = none, none, none, np.zeros(0)
        a, b = np.searchsorted(self.last, u), np.searchsorted(self.last, v)
        dense = np.zeros((len(self.last), len(self.last)))
        np.add.at(dense, (np.concatenate([a, b, a, b]), np.concatenate([a, b, b, a])), np.concatenate([w, w, -w, -w]))
        scale = 1 / np.sqrt(np.diag(dense)) if len(dense) else np.zeros(0)
        self.dense = np.linalg.pinv(dense * scale[:, None] * scale, rcond=1e-12, hermitian=True) * scale[:, None] * scale if len(dense) else dense

    @staticmethod
    def _joined(rng, met, weight, begin, size, place, total):
        """Edges among the neighbours of what goes: for each neighbour but a node's last, one to a later (heavier) one."""
        every = np.cumsum(weight)
        end = every[begin + size - 1][place]
        after = end - every
        some = np.arange(len(met)) < (begin + size - 1)[place]
        i = np.flatnonzero(some & (after > 0))
        j = np.searchsorted(every, every[i] + rng.random(len(i)) * after[i], side="right")
        j = np.clip(j, i + 1, (begin + size - 1)[place[i]])
        return met[i], met[j], weight[i] * after[i] / total[place[i]]

    def solve(self, r: np.ndarray) -> np.ndarray:
        y, out = r.astype(float), np.zeros(self.n)
        for nodes, _, place, met, share in self.steps:
            y += np.bincount(met, share * y[nodes][place], self.n)
        out[self.last] = self.dense @ y[self.last]
        for nodes, total, place, met, share in reversed(self.steps):
            out[nodes] = y[nodes] / total + np.bincount(place, share * out[met], len(nodes))
        return out


def _summed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges from the smaller to the greater node, repeated ones added."""
    key = np.minimum(u, v).astype(np.int64) * n + np.maximum(u, v)
    key, place = np.unique(key, return_inverse=True)
    return key // n, key % n, np.bincount(place, w, len(key))
