"""The k best of many products of vectors, exactly: a plain numpy helper for tasks."""

from __future__ import annotations

import numpy as np

EPS = 1e-9
#: Rows and columns of a product that is looked at at once, and pairs that are
#: computed one by one at once.
ROWS, COLUMNS, PAIRS = 1_024, 4_096, 65_536


class Best:
    """The k most similar of the vectors y that each vector of x has met.

    Similarity is dot / (norms + EPS), rounded; ties go to the smaller `place` of
    y. Pairs are first tested in single precision against the k-th best so far,
    less what that may err; the few that pass are computed in double precision.
    Where they aren't few, or norms are so small that EPS counts, all are.
    """

    def __init__(self, x: np.ndarray, x_id: np.ndarray, y: np.ndarray, y_id: np.ndarray, k: int, digits: int) -> None:
        self.x, self.y, self.k, self.digits = x, y, k, digits
        self.nx, self.ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        unit = lambda v, n: (v / np.maximum(n, 1e-300)[:, None]).astype(np.float32)
        self.single = bool(len(x) and len(y) and np.isfinite(self.nx).all() and np.isfinite(self.ny).all() and self.nx.min() * self.ny.min() > 1e-2 * 10.0**digits * EPS)
        self.sx, self.sy = (unit(x, self.nx), unit(y, self.ny)) if self.single else (x, y)
        self.slack = np.float32(2 * 10.0**-digits + 2.4e-7 * (x.shape[1] + 4))
        # ids as numbers, equal where the ids are
        both = np.unique(np.concatenate([x_id, y_id]), return_inverse=True)[1] if len(x) + len(y) else np.zeros(0, np.int64)
        self.x_id, self.place = both[: len(x)], both[len(x) :]
        self.best = np.full((len(x), k), -np.inf)
        self.who = np.full((len(x), k), -1)

    def meet(self, rows: np.ndarray, columns: np.ndarray) -> None:
        """Let these rows of x meet these of y (numbers, each once)."""
        for j in range(0, len(columns), COLUMNS):
            c = columns[j : j + COLUMNS]
            for i in range(0, len(rows), ROWS):
                self._block(rows[i : i + ROWS], c)

    def _block(self, r: np.ndarray, c: np.ndarray) -> None:
        if not self.single:
            return self._all(r, c)
        s = self.sx[r] @ self.sy[c].T
        own = np.argsort(self.place[c], kind="stable")
        low, high = (np.searchsorted(self.place[c], self.x_id[r], side, sorter=own) for side in ("left", "right"))
        for i in np.flatnonzero(low < high):
            s[i, own[low[i] : high[i]]] = -np.inf
        reach = self.best[r, -1]
        fresh = ~np.isfinite(reach)
        if fresh.any():
            m = min(self.k, s.shape[1])
            reach[fresh] = -np.partition(-s[fresh], m - 1, axis=1)[:, m - 1] if m == self.k else -np.inf
        hit = np.flatnonzero(s >= np.maximum(reach - self.slack, np.float64(-3)).astype(np.float32)[:, None])
        if len(hit) > max(s.size // 16, 4 * self.k * len(r)):
            return self._all(r, c)
        a, b = np.divmod(hit, s.shape[1])
        a, b = r[a], c[b]
        sim = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", self.x[a[i : i + PAIRS]], self.y[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)]])
        self._take(a, b, np.round(sim / (self.nx[a] * self.ny[b] + EPS), self.digits) + 0.0)

    def _all(self, r: np.ndarray, c: np.ndarray) -> None:
        c = c[np.argsort(self.place[c], kind="stable")]
        for i in range(0, len(r), 256):
            rows = r[i : i + 256]
            s = np.round((self.x[rows] @ self.y[c].T) / (self.nx[rows][:, None] * self.ny[c][None] + EPS), self.digits) + 0.0
            s[(self.x_id[rows][:, None] == self.place[c][None]) | ~np.isfinite(s)] = -np.inf
            o = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
            self._take(np.repeat(rows, o.shape[1]), c[o].ravel(), np.take_along_axis(s, o, 1).ravel())

    def _take(self, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> None:
        """Pairs (a, b) and what was best before -> the k best of each row."""
        ok = np.isfinite(sim)
        a, b, sim = a[ok], b[ok], sim[ok]
        rows = np.unique(a)
        old = self.who[rows] >= 0
        a = np.concatenate([a, np.repeat(rows, old.sum(1))])
        b, sim = np.concatenate([b, self.who[rows][old]]), np.concatenate([sim, self.best[rows][old]])
        o = np.lexsort((self.place[b], -sim, a))
        a, b, sim = a[o], b[o], sim[o]
        no = np.arange(len(a)) - np.searchsorted(a, a)
        ok = no < self.k
        self.best[a[ok], no[ok]], self.who[a[ok], no[ok]] = sim[ok], b[ok]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x, rows of y, similarities."""
        ok = self.who >= 0
        return np.repeat(np.arange(len(self.x)), ok.sum(1)), self.who[ok], self.best[ok]
