"""The PC algorithm: skeleton by conditional independence, then orientation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations, islice

import numpy as np
from pyspark.sql import DataFrame

from causeway.operators.independence import POWERS, discrete_test, discrete_tests, fisherz_p
from causeway.operators.moments import moments
from causeway.plans.base import Graph, Learner, learner
from causeway.plans.dense import close_under_meek

Test = Callable[[int, int, list[int]], float | None]
#: Tests that one job answers, about.
BATCH = 64


def find_skeleton(d: int, p_value: Test, alpha: float, variant: str = "stable", apart: set[tuple[int, int]] = frozenset(), start: np.ndarray | None = None, threads: int = 1, p_values: Callable[[list], list] | None = None) -> tuple[np.ndarray, dict]:
    """0/1 skeleton and the separating set of every pair that a test has separated.

    'original' uses removals at once, and 'stable' after each size of conditioning
    sets; both take conditioning sets from the first variable's neighbours.
    'parallel' is stable and takes them from either variable's. Pairs in apart are
    never joined and get no separating set. A test without a p-value keeps its edge.
    p_values answers a list of (i, j, given) together: then all pairs that are not
    yet separated ask their next tests in common rounds, with the same outcome.
    """
    g = (np.ones((d, d), dtype=int) if start is None else (start | start.T).astype(int)) * (1 - np.eye(d, dtype=int))
    for a, b in apart:
        g[a, b] = g[b, a] = 0
    separated: dict[tuple[int, int], list[int]] = {}

    def candidates(i: int, j: int, near: np.ndarray, size: int) -> Iterator[list[int]]:
        seen = set()
        for x, y in ((i, j), (j, i)) if variant == "parallel" else ((i, j),):
            for given in combinations([k for k in np.flatnonzero(near[x]).tolist() if k != y], size):
                if given not in seen:
                    seen.add(given)
                    yield list(given)

    def separating(i: int, j: int, near: np.ndarray, size: int) -> list[int] | None:
        for given in candidates(i, j, near, size):
            p = p_value(i, j, given)
            if p is not None and p >= alpha:
                return given
        return None

    def in_rounds(pairs: list[tuple[int, int]], near: np.ndarray, size: int) -> dict:
        found, live = {}, {e: candidates(*e, near, size) for e in pairs}
        while live:
            each = max(1, BATCH // len(live))
            asked = [(e, given) for e, left in live.items() for given in islice(left, each)]
            for k in range(0, len(asked), BATCH):
                part = asked[k : k + BATCH]
                for (e, given), p in zip(part, p_values([(*e, given) for e, given in part]), strict=True):
                    if p is not None and p >= alpha:
                        found.setdefault(e, given)
            still = {e for e, _ in asked} - set(found)
            live = {e: left for e, left in live.items() if e in still}
        return found

    size = 0
    while any(g[i].sum() - 1 >= size for i, j in np.argwhere(np.triu(g))):
        pairs = [(int(i), int(j)) for i, j in np.argwhere(np.triu(g))]
        if variant == "original":
            for i, j in pairs:
                found = separating(i, j, g, size)
                if found is not None:
                    g[i, j] = g[j, i] = 0
                    separated[i, j] = found
        else:
            near = g.copy()
            if p_values is not None:
                of_pair = in_rounds(pairs, near, size)
            else:
                with ThreadPoolExecutor(threads) as pool:
                    of_pair = {e: f for e, f in zip(pairs, pool.map(lambda e: separating(*e, near, size), pairs), strict=True) if f is not None}
            for (i, j), found in of_pair.items():
                g[i, j] = g[j, i] = 0
                separated[i, j] = found
        size += 1
    return g, separated


def orient(skeleton: np.ndarray, separated: dict[tuple[int, int], list[int]]) -> np.ndarray:
    """Colliders of separated pairs, then Meek's rules."""
    g = skeleton.copy()
    for (i, j), given in sorted(separated.items()):
        for k in np.flatnonzero(skeleton[i] & skeleton[j]):
            if k not in given:
                for end in (i, j):
                    if g[end, k] and g[k, end]:
                        g[k, end] = 0
    return close_under_meek(g)


@learner
class PC(Learner):
    """test: 'fisherz' (one pass over the rows in all), a discrete test of independence.POWERS (one
    aggregation for many tests; one for each with variant 'original'), or a callable (df, x, y, z names) -> p. required, forbidden: pairs of columns."""

    def __init__(self, variant: str = "stable", alpha: float = 0.05, test: str | Callable = "fisherz", required: list = (), forbidden: list = (), threads: int = 4):
        if variant not in ("original", "stable", "parallel"):
            raise ValueError("variant is original, stable or parallel")
        self.variant, self.alpha, self.test, self.required, self.forbidden, self.threads = variant, alpha, test, required, forbidden, threads

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        threads, p_values = self.threads, None
        if self.test in ("fisherz", "fisher"):
            m = moments(df, columns)
            p_value, threads = (lambda i, j, given: fisherz_p(m, i, j, given)), 1
        elif callable(self.test):
            p_value = lambda i, j, given: self.test(df, columns[i], columns[j], [columns[k] for k in given])
        elif self.test in POWERS:
            p_value = lambda i, j, given: discrete_test(df, columns[i], columns[j], [columns[k] for k in given], self.test)[2]
            p_values = lambda tests: [t[2] for t in discrete_tests(df, [(columns[i], columns[j], [columns[k] for k in given]) for i, j, given in tests], self.test)]
        else:
            raise ValueError(f"unknown test {self.test!r}")
        at = {c: i for i, c in enumerate(columns)}
        no = {(at[a], at[b]) for a, b in self.forbidden}
        g, separated = find_skeleton(len(columns), p_value, self.alpha, self.variant, {(a, b) for a, b in no if (b, a) in no}, threads=threads, p_values=p_values)
        g = orient(g, separated)
        for a, b in self.required:
            g[at[a], at[b]] = 1
        for a, b in no:
            g[a, b] = 0
        return Graph(list(columns), g, notes={"separated": separated})
