"""Greedy equivalence search, and searches over orderings, on decomposable scores."""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame

from causeway.operators.moments import moments
from causeway.operators.scores import BIC, BDeu, Score, graph_reward, prune_by_coefficient, reward_bounds
from causeway.plans.base import Graph, Learner, learner
from causeway.plans.dense import class_of_dag, extend_to_dag, is_acyclic


def _subsets(items):
    items = sorted(items)
    return chain.from_iterable(combinations(items, k) for k in range(len(items) + 1))


def _clique(g: np.ndarray, nodes) -> bool:
    return all(g[a, b] or g[b, a] for a, b in combinations(sorted(nodes), 2))


def _blocked(g: np.ndarray, start: int, goal: int, wall: set[int]) -> bool:
    """Every path from start to goal that goes along lines and arrows meets the wall."""
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for y in np.flatnonzero(g[x]).tolist():
            if y == goal:
                return False
            if y not in seen and y not in wall:
                seen.add(y)
                todo.append(y)
    return True


def greedy_equivalence_search(d: int, score: Score) -> tuple[np.ndarray, float]:
    """The class that no insertion and then no deletion improves, and the sum of gains."""
    g, total = np.zeros((d, d), dtype=int), 0.0
    for forward in (True, False):
        while True:
            moves = list(_moves(g, forward))
            score.prepare([(y, p) for y, more, less, _ in moves for p in (more, less)])
            gain, graph = max(((score.of(y, more) - score.of(y, less), new) for y, more, less, new in moves), key=lambda m: m[0], default=(0.0, None))
            if gain <= 1e-9 or graph is None:
                break
            dag = extend_to_dag(graph)
            if dag is None:
                break
            g, total = class_of_dag(dag), total + gain
    return g, total


def _moves(g: np.ndarray, forward: bool):
    """(node, its parents in the score that is gained, in that which is lost, graph) of every valid insertion or deletion."""
    d = len(g)
    line, near = (g & g.T).astype(bool), (g | g.T).astype(bool)
    for y in range(d):
        parents = set(np.flatnonzero(g[:, y] & ~g[y]).tolist())
        lines = set(np.flatnonzero(line[y]).tolist())
        for x in range(d):
            if x == y:
                continue
            shared = {k for k in lines if near[k, x]}
            if forward and not near[x, y]:
                for t in _subsets(lines - shared):
                    base = shared | set(t)
                    if _clique(g, base) and _blocked(g, y, x, base):
                        new = g.copy()
                        new[x, y] = 1
                        for k in t:
                            new[y, k] = 0
                        yield y, parents | base | {x}, parents | base, new
            if not forward and g[x, y]:
                for h in _subsets(shared):
                    rest = shared - set(h)
                    if _clique(g, rest):
                        new = g.copy()
                        new[x, y] = new[y, x] = 0
                        for k in h:
                            new[k, y] = 0
                            if line[x, k]:
                                new[k, x] = 0
                        yield y, (parents | rest) - {x}, parents | rest | {x}, new


@learner
class GES(Learner):
    """criterion: 'bic' (method 'scatter' or 'r2'), 'bdeu' (k, size), or a Score of one's own."""

    def __init__(self, criterion: str | Score = "bic", method: str = "scatter", k: float = 0.001, size: float = 10.0):
        self.criterion, self.method, self.k, self.size = criterion, method, k, size

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        if isinstance(self.criterion, Score):
            score = self.criterion
        elif self.criterion == "bic":
            score = BIC(moments(df, columns), self.method)
        elif self.criterion == "bdeu":
            score = BDeu(df, columns, self.k, self.size)
        else:
            raise ValueError(f"unknown criterion {self.criterion!r}")
        g, gain = greedy_equivalence_search(len(columns), score)
        return Graph(list(columns), g, notes={"gain": gain})


@learner
class OrderSearch(Learner):
    """Policy gradient over orderings: a table of place preferences is moved towards orderings whose complete
    graphs score well; edges of the best ordering are pruned by their regression coefficients.

    All rewards come from one pass of moments.
    """

    def __init__(self, rounds: int = 200, batch: int = 32, rate: float = 0.3, threshold: float = 0.3, seed: int = 0, equal_variances: bool = False):
        self.rounds, self.batch, self.rate, self.threshold, self.seed, self.equal_variances = rounds, batch, rate, threshold, seed, equal_variances

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        m, d, rng = moments(df, columns), len(columns), np.random.default_rng(self.seed)
        low, high = reward_bounds(m, self.equal_variances)
        preference, best, cache = np.zeros(d), (np.inf, list(range(d))), {}
        for _ in range(self.rounds):
            noise = rng.gumbel(size=(self.batch, d))
            orders = np.argsort(-(preference + noise), axis=1)
            rewards = np.array([self._reward(m, tuple(o), cache) for o in orders])
            i = int(rewards.argmin())
            best = min(best, (float(rewards[i]), orders[i].tolist()))
            advantage = -(rewards - rewards.mean()) / (abs(high - low) + 1e-9)
            gradient = np.zeros(d)
            for o, a in zip(orders, advantage, strict=True):
                left = np.exp(preference[o] - preference.max())
                tails = np.cumsum(left[::-1])[::-1]
                for k in range(d):
                    gradient[o[k:]] -= a * left[k:] / tails[k]
                    gradient[o[k]] += a
            preference = preference + self.rate * d * gradient / self.batch
        full = _complete(best[1])
        return Graph(list(columns), prune_by_coefficient(m, full, self.threshold), notes={"order": best[1], "reward": best[0]})

    def _reward(self, m, order: tuple, cache: dict) -> float:
        if order not in cache:
            cache[order] = graph_reward(m, _complete(order), self.equal_variances, edge_penalty=False)
        return cache[order]


def _complete(order) -> np.ndarray:
    g = np.zeros((len(order), len(order)), dtype=int)
    for k, j in enumerate(order):
        g[list(order[:k]), j] = 1
    return g


@learner
class GraphSearch(Learner):
    """Policy gradient over edges: independent edge probabilities are moved towards graphs with a low BIC and no
    cycle; the best acyclic graph is pruned by its regression coefficients."""

    def __init__(self, rounds: int = 300, batch: int = 64, rate: float = 1.0, threshold: float = 0.3, penalty: float = 1.0, seed: int = 0, equal_variances: bool = False):
        self.rounds, self.batch, self.rate, self.threshold, self.penalty, self.seed, self.equal_variances = rounds, batch, rate, threshold, penalty, seed, equal_variances

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        m, d, rng = moments(df, columns), len(columns), np.random.default_rng(self.seed)
        low, high = reward_bounds(m, self.equal_variances)
        logits, off = np.zeros((d, d)) - 1.0, 1 - np.eye(d, dtype=int)
        best, average = (np.inf, np.zeros((d, d), dtype=int)), None
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-logits))
            graphs = (rng.random((self.batch, d, d)) < p).astype(int) * off
            rewards = np.empty(self.batch)
            for i, g in enumerate(graphs):
                fit = (graph_reward(m, g, self.equal_variances) - low) / (abs(high - low) + 1e-9)
                acyclic = is_acyclic(g)
                rewards[i] = fit + (0 if acyclic else self.penalty)
                if acyclic and rewards[i] < best[0]:
                    best = (float(rewards[i]), g)
            average = rewards.mean() if average is None else 0.9 * average + 0.1 * rewards.mean()
            logits -= self.rate * np.tensordot(rewards - average, graphs - p, axes=1) / self.batch * 10
            logits = np.clip(logits, -6, 6)
        return Graph(list(columns), prune_by_coefficient(m, best[1], self.threshold), notes={"reward": best[0]})
