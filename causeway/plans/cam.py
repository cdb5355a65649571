"""Causal additive models: smooth curves of the parents, from one Gram matrix of spline columns.

Every variable has cubic B-splines with knots at its quantiles. One pass over the rows
gives the moments of all spline columns of all variables; penalised regressions, the
greedy search for edges and the tests that prune them are then work on those.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from causeway.functions.tails import f_tail
from causeway.operators.lowrank import batch_totals, numbers
from causeway.plans.base import Graph, Learner, learner


def spline_columns(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic B-splines of the values; beyond the outer knots values count as those."""
    x = np.clip(x, knots[0], knots[-1])
    t = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    b = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
    b[x == knots[-1], len(t) - 5] = 1
    for k in range(1, 4):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(left > 0, (x[:, None] - t[: -k - 1]) / left, 0)
            down = np.where(right > 0, (t[k + 1 :] - x[:, None]) / right, 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


class SplineMoments:
    """Centred moments of the columns and of every one's splines; penalised regressions from them."""

    def __init__(self, df: DataFrame, columns: list[str], knots: int = 8, smooth: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)):
        rows, d = numbers(df, columns), len(columns)
        cuts = rows.approxQuantile(columns, np.linspace(0, 1, knots).tolist(), 0.0 if rows.limit(20_001).count() <= 20_000 else 1e-4)
        self.knots = [np.unique(c) if len(set(c)) > 1 else np.array([0.0, 1.0]) for c in cuts]
        sizes = [len(k) + 2 for k in self.knots]
        edges = d + np.concatenate([[0], np.cumsum(sizes)])
        self.block = [list(range(edges[j], edges[j + 1])) for j in range(d)]
        self.smooth, self.columns = smooth, list(columns)
        total = int(edges[-1])

        def f(x: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), x, *[spline_columns(x[:, j], self.knots[j]) for j in range(d)]])
            return (z.T @ z).ravel()

        sums = batch_totals(rows, f, (1 + total) ** 2).reshape(1 + total, 1 + total)
        self.n = int(round(sums[0, 0]))
        mean = sums[0, 1:] / max(self.n, 1)
        self.cov = sums[1:, 1:] / max(self.n, 1) - np.outer(mean, mean)
        self.bend = [np.diff(np.eye(s), 2, axis=0).T @ np.diff(np.eye(s), 2, axis=0) for s in sizes]
        self._known: dict[tuple, tuple[float, float]] = {}

    def fit(self, y: int, parents) -> tuple[float, float]:
        """(mean square left, degrees of freedom used) of y on curves of its parents, for the smoothness of least generalised cross-validation."""
        key = (y, frozenset(parents))
        if key not in self._known:
            self._known[key] = self._fit(y, sorted(key[1]))
        return self._known[key]

    def _fit(self, y: int, parents: list[int]) -> tuple[float, float]:
        if not parents:
            return float(self.cov[y, y]), 1.0
        at = [k for p in parents for k in self.block[p]]
        gram, b = self.cov[np.ix_(at, at)], self.cov[at, y]
        bend = np.zeros_like(gram)
        for k, p in enumerate(parents):
            size = len(self.block[p])
            first = sum(len(self.block[q]) for q in parents[:k])
            bend[first : first + size, first : first + size] = self.bend[p]
        best = None
        for s in self.smooth:
            # Splines of a variable add up to one, so centred ones are dependent: a small ridge decides among equals.
            way = np.linalg.solve(gram + s * bend + 1e-9 * np.eye(len(at)), np.column_stack([b, gram]))
            w, used = way[:, 0], 1 + float(np.trace(way[:, 1:]))
            left = max(float(self.cov[y, y] - 2 * w @ b + w @ gram @ w), 1e-12)
            score = left / max(1 - used / max(self.n, 1), 1e-6) ** 2
            if best is None or score < best[0]:
                best = score, left, used
        return best[1], best[2]

    def p_value(self, y: int, parents, one: int) -> float:
        """Of the curve of one of the parents, by an F test against the regression without it."""
        (full, used), (less, fewer) = self.fit(y, parents), self.fit(y, set(parents) - {one})
        more = max(used - fewer, 1e-3)
        rest = max(self.n - used, 1.0)
        return f_tail(max(less - full, 0.0) / more / (full / rest), more, rest)


def prune_by_curves(m: SplineMoments, graph: np.ndarray, cutoff: float = 0.001) -> np.ndarray:
    """Edges whose curve is significant among those of all parents."""
    out = np.zeros_like(graph)
    for j in range(len(graph)):
        parents = np.flatnonzero(graph[:, j]).tolist()
        for p in parents:
            out[p, j] = int(m.p_value(j, parents, p) <= cutoff)
    return out


@learner
class CAM(Learner):
    """Add the edge that explains most, as long as no cycle comes of it; then prune.

    neighbours: so many candidates a variable, those whose curves explain it best alone (0: all). least_gain: of the log
    of the variance for an edge to be added. cutoff: of the F test (1: no pruning).
    """

    def __init__(self, knots: int = 8, neighbours: int = 0, least_gain: float = 0.0, cutoff: float = 0.001):
        self.knots, self.neighbours, self.least_gain, self.cutoff = knots, neighbours, least_gain, cutoff

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        m, d = SplineMoments(df, columns, self.knots), len(columns)
        gain = np.full((d, d), -np.inf)
        for j in range(d):
            alone = {i: np.log(m.fit(j, [])[0]) - np.log(m.fit(j, [i])[0]) for i in range(d) if i != j}
            kept = sorted(alone, key=lambda i: -alone[i])[: self.neighbours or d]
            for i in kept:
                gain[i, j] = alone[i]
        graph, reach = np.zeros((d, d), dtype=int), np.eye(d, dtype=bool)
        while d > 1 and gain.max() > self.least_gain:
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            graph[i, j] = 1
            reach |= np.outer(reach[:, i], reach[j])
            gain[i, j] = -np.inf
            gain[reach.T] = -np.inf  # j -> i where i reaches j
            now = np.log(m.fit(j, np.flatnonzero(graph[:, j]).tolist())[0])
            for k in np.flatnonzero(np.isfinite(gain[:, j])):
                gain[k, j] = now - np.log(m.fit(j, [*np.flatnonzero(graph[:, j]).tolist(), int(k)])[0])
        pruned = prune_by_curves(m, graph, self.cutoff) if self.cutoff < 1 else graph
        return Graph(list(columns), pruned, notes={"full": graph, "score": float(sum(np.log(m.fit(j, np.flatnonzero(graph[:, j]).tolist())[0]) for j in range(d)))})
