"""Graphs and solvers of the size of the variables: what searches do between passes over the data."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from itertools import combinations

import numpy as np

from causeway.functions.tails import matrix_exponential


def order_of(a: np.ndarray) -> list[int] | None:
    """A topological order of the graph, or None if it has a cycle."""
    left, out = {j: set(np.flatnonzero(a[:, j]).tolist()) for j in range(len(a))}, []
    while left:
        free = sorted(j for j, pa in left.items() if not pa & left.keys())
        if not free:
            return None
        out += free
        for j in free:
            del left[j]
    return out


def is_acyclic(a: np.ndarray) -> bool:
    return order_of(a) is not None


def cut_to_dag(w: np.ndarray, threshold: float = 0.0) -> np.ndarray:
    """w without entries up to the threshold, then without its smallest ones until no cycle is left."""
    w = np.where(np.abs(w) > threshold, w, 0.0)
    np.fill_diagonal(w, 0)
    sizes = np.unique(np.abs(w[w != 0]))
    low, high = 0, len(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if is_acyclic(np.abs(w) > (sizes[mid - 1] if mid else 0)) else (mid + 1, high)
    return np.where(np.abs(w) > (sizes[low - 1] if low else 0), w, 0.0)


def close_under_meek(g: np.ndarray) -> np.ndarray:
    """Meek's four rules on a matrix in which undirected edges stand in both directions, until none applies."""
    g = g.astype(bool).copy()
    changed = True
    while changed:
        changed = False
        line, arrow, near = g & g.T, g & ~g.T, g | g.T
        for i, j in np.argwhere(line):
            if not (g[i, j] and g[j, i]):
                continue
            into = np.flatnonzero(arrow[:, i])
            one = any(not near[k, j] for k in into if k != j)
            two = bool((arrow[i] & arrow[:, j]).any())
            mids = np.flatnonzero(line[i] & arrow[:, j])
            three = any(not near[k, m] for k, m in combinations(mids, 2))
            four = any(not near[k, j] and bool((arrow[k] & arrow[:, j]).any()) for k in np.flatnonzero(line[i]) if k != j)
            if one or two or three or four:
                g[j, i] = False
                line, arrow = g & g.T, g & ~g.T
                changed = True
    return g.astype(int)


def class_of_dag(dag: np.ndarray) -> np.ndarray:
    """The completed partially directed graph of a DAG's equivalence class."""
    dag = dag.astype(bool)
    near = dag | dag.T
    g = near.copy()
    for k in range(len(dag)):
        for i, j in combinations(np.flatnonzero(dag[:, k]), 2):
            if not near[i, j]:
                g[k, i] = g[k, j] = False
    return close_under_meek(g)


def extend_to_dag(g: np.ndarray) -> np.ndarray | None:
    """A DAG with the same skeleton and colliders as a partially directed graph, or None."""
    g = g.astype(bool).copy()
    out, left = (g & ~g.T).astype(int), set(range(len(g)))
    while left:
        for x in sorted(left):
            if (g[x] & ~g[:, x]).any():
                continue
            near = np.flatnonzero(g[x] | g[:, x])
            lines = np.flatnonzero(g[x] & g[:, x])
            if all(all(v == u or g[u, v] or g[v, u] for v in near) for u in lines):
                out[lines, x] = 1
                g[x] = g[:, x] = False
                left.remove(x)
                break
        else:
            return None
    return out


def acyclicity(w: np.ndarray) -> tuple[float, np.ndarray]:
    """tr(exp(w * w)) - d and its gradient, of the last two axes."""
    e = matrix_exponential(w * w)
    return np.trace(e, axis1=-2, axis2=-1) - w.shape[-1], np.swapaxes(e, -1, -2) * w * 2


def acyclicity_power(w: np.ndarray) -> tuple[float, np.ndarray]:
    """tr((I + w * w / d)^d) - d and its gradient, of the last two axes."""
    d = w.shape[-1]
    e = np.swapaxes(np.linalg.matrix_power(np.eye(d) + w * w / d, d - 1), -1, -2)
    return (e * (np.eye(d) + w * w / d)).sum(axis=(-2, -1)) - d, e * w * 2


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, lower: np.ndarray | float = -np.inf, steps: int = 500, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """Projected limited-memory quasi-Newton descent on x >= lower. f gives value and gradient.

    If f has an attribute many, for a list of points, eight steps of a line search are tried together.
    """
    many, at_once = getattr(f, "many", None), 8
    x = np.maximum(x, lower)
    value, grad = f(x)
    pairs: deque = deque(maxlen=memory)
    for _ in range(steps):
        free = (x > lower) | (grad < 0)
        if np.abs(x - np.maximum(x - grad, lower)).max() < tolerance:
            break
        q = np.where(free, grad, 0.0)
        stack = []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            q = q - a * y
            stack.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(pairs, reversed(stack), strict=True):
            q = q + (a - rho * (y @ q)) * s
        direction = -np.where(free, q, 0.0)
        if direction @ grad >= 0:
            direction = -np.where(free, grad, 0.0)
            pairs.clear()
        step, done = (1.0 if pairs else min(1.0, 1 / max(np.abs(grad).sum(), 1e-12))), True
        for _ in range(40 if many is None else 40 // at_once):
            points = [np.maximum(x + step * 0.5**k * direction, lower) for k in range(1 if many is None else at_once)]
            for new, (new_value, new_grad) in zip(points, [f(points[0])] if many is None else many(points), strict=True):
                if np.isfinite(new_value) and new_value <= value + 1e-4 * (grad @ (new - x)):
                    done = False
                    break
            if not done:
                break
            step *= 0.5 ** len(points)
        if done:
            if not pairs:
                break
            pairs.clear()
            continue
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs.append((s, y, 1 / (s @ y)))
        small = abs(value - new_value) <= 1e-12 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if small:
            break
    return x


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row the column of a least-cost one-to-one assignment, by shortest augmenting paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, came, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while match[at]:
            used[at] = True
            row = match[at]
            slack = np.where(used[1:], np.inf, cost[row - 1] - u[row] - v[1:])
            better = slack < least[1:]
            least[1:][better], came[1:][better] = slack[better], at
            open_least = np.where(used[1:], np.inf, least[1:])
            to = int(open_least.argmin()) + 1
            delta = open_least[to - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            at = to
        while at:
            match[at] = match[came[at]]
            at = came[at]
    out = np.zeros(n, dtype=int)
    out[match[1:] - 1] = np.arange(n)
    return out


def lasso_bic(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, grid: int = 60) -> np.ndarray:
    """Lasso coefficients of the penalty with the least BIC, from population moments, along a path of penalties."""
    d = len(xy)
    best, out, b = np.inf, np.zeros(d), np.zeros(d)
    full = np.linalg.lstsq(xx, xy, rcond=None)[0]
    noise = max(yy - xy @ full, 1e-12 * max(yy, 1e-300))
    top = np.abs(xy).max(initial=0)
    for penalty in [*np.geomspace(top, top * 1e-5, grid), 0.0] if top else []:
        for _ in range(1000):
            old = b.copy()
            for j in range(d):
                if xx[j, j] > 0:
                    r = xy[j] - xx[j] @ b + xx[j, j] * b[j]
                    b[j] = np.sign(r) * max(abs(r) - penalty, 0) / xx[j, j]
            if np.abs(b - old).max() < 1e-9 * max(1.0, np.abs(b).max()):
                break
        rss = yy - 2 * xy @ b + b @ xx @ b
        bic = n * rss / noise + np.log(n) * np.count_nonzero(b)
        if bic < best:
            best, out = bic, b.copy()
    return out
