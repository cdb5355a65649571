"""Post-nonlinear models of pairs, trained in the tasks by neural.average_training()."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.independence import hsic_test
from causeway.plans.base import Graph, Learner, learner
from causeway.plans.neural import Step, average_training, dealt, shares


@learner
class PNL(Learner):
    """Post-nonlinear models: y = g(f(x) + noise). For every ordered pair of dependent variables, networks find f and
    the increasing inverse of g that make the noise most likely. All pairs train together.

    decide: each, an edge x -> y stands where the noise is independent of x, the published rule, so both directions or
    neither may; one, of dependent variables that direction is taken whose noise is the more independent (the test's
    statistic in terms of its threshold)."""

    def __init__(self, hidden: int = 6, rounds: int = 30, rate: float = 0.02, batch: int = 64, alpha: float = 0.01, seed: int = 0, decide: str = "each"):
        if decide not in ("each", "one"):
            raise ValueError("decide is each or one")
        self.hidden, self.rounds, self.rate, self.batch, self.alpha, self.seed, self.decide = hidden, rounds, rate, batch, alpha, seed, decide

    def _split(self, x: np.ndarray, pairs: int):
        m = self.hidden
        parts = np.split(x, np.cumsum([pairs * m] * 6 + [pairs]), axis=-1)
        return *(p.reshape(*x.shape[:-1], pairs, m) for p in parts[:6]), parts[6], parts[7]

    def start(self, pairs: int, rng: np.random.Generator) -> np.ndarray:
        size = pairs * self.hidden
        return np.concatenate([rng.normal(0, 1, size), rng.normal(0, 1, size), rng.normal(0, 0.1, size), rng.normal(1, 0.3, size), rng.normal(0, 1, size), rng.normal(0.3, 0.05, size), np.zeros(2 * pairs)])

    def value(self, x: np.ndarray, data: np.ndarray, pairs: list[tuple[int, int]]) -> float:
        """Negative log-likelihood of the noise, less the log-derivative of the inverse, summed over the pairs."""
        e, slope = self._noise(self._split(x, len(pairs)), data, pairs)[:2]
        return float((0.5 * e * e - np.log(slope)).sum()) / len(data)

    @staticmethod
    def _noise(p: tuple, data: np.ndarray, pairs: list[tuple[int, int]]):
        a, b, c, w, u, v = (q[..., None, :, :] for q in p[:6])
        c0, s = (q[..., None, :] for q in p[6:])
        cause, effect = data[..., [i for i, _ in pairs]], data[..., [j for _, j in pairs]]
        one = np.tanh(cause[..., None] * a + b)
        two = np.tanh(effect[..., None] * w**2 + u)
        e = np.exp(s) * effect + (two * v**2).sum(axis=-1) - (one * c).sum(axis=-1) - c0
        slope = np.exp(s) + ((1 - two * two) * v**2 * w**2).sum(axis=-1)
        return e, slope, cause, effect, one, two

    def gradient(self, pairs: list[tuple[int, int]]) -> Step:
        def f(x: np.ndarray, data: np.ndarray, rho: float, alpha: float, share: np.ndarray | None = None) -> np.ndarray:
            p = self._split(x, len(pairs))
            e, slope, cause, effect, one, two = self._noise(p, data, pairs)
            c, w, v = (p[k][..., None, :, :] for k in (2, 3, 5))
            share = np.asarray(shares(data, share))
            g = (e * share)[..., None]
            k = (share / slope)[..., None]
            q, y = 1 - two * two, effect[..., None]
            inner = -g * c * (1 - one * one)
            bent = -2 * two * q  # the derivative of q
            of_units = [
                inner * cause[..., None], inner, -g * one,
                g * v**2 * q * 2 * w * y - k * v**2 * (2 * w * q + w**2 * bent * 2 * w * y),
                g * v**2 * q - k * v**2 * w**2 * bent,
                g * 2 * v * two - k * 2 * v * w**2 * q,
            ]
            of_pairs = [-g[..., 0].sum(axis=-2), np.exp(p[7]) * (g[..., 0] * effect - k[..., 0]).sum(axis=-2)]
            return np.concatenate([*(u.sum(axis=-3).reshape(*x.shape[:-1], -1) for u in of_units), *of_pairs], axis=-1)

        return f

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        d = len(columns)
        matrix = np.zeros((d, d), dtype=int)
        rows, ratio = dealt(df, columns).drop("_u").persist(), np.full((d, d), np.inf)
        try:
            bound = {(i, j) for i in range(d) for j in range(i + 1, d) if not hsic_test(rows, columns[i], columns[j], self.alpha)["independent"]}
            pairs = [(i, j) for i, j in permutations(range(d), 2) if (min(i, j), max(i, j)) in bound]
            if pairs:
                x = self.start(len(pairs), np.random.default_rng(self.seed))
                x = average_training(rows, self.gradient(pairs), x, 0.0, 0.0, self.rounds, self.rate, self.batch, self.seed)
                for k, (i, j) in enumerate(pairs):
                    noise = self._noise_column(x, k, len(pairs), F.col(f"`{columns[i]}`"), F.col(f"`{columns[j]}`"))
                    pair = rows.select(F.col(f"`{columns[i]}`").alias("cause"), noise.alias("noise"))
                    test = hsic_test(pair, "cause", "noise", self.alpha)
                    matrix[i, j], ratio[i, j] = test["independent"], test["statistic"] / max(test["threshold"], 1e-300)
                if self.decide == "one":
                    matrix = np.array([[int(ratio[i, j] < ratio[j, i]) for j in range(d)] for i in range(d)])
        finally:
            rows.unpersist()
        return Graph(list(columns), matrix, notes={"ratio": ratio})

    def _noise_column(self, x: np.ndarray, k: int, pairs: int, cause: Column, effect: Column) -> Column:
        a, b, c, w, u, v, c0, s = (p[k] for p in self._split(x, pairs))
        out = effect * float(np.exp(s)) - float(c0)
        for i in range(self.hidden):
            out = out + F.tanh(effect * float(w[i] ** 2) + float(u[i])) * float(v[i] ** 2) - F.tanh(cause * float(a[i]) + float(b[i])) * float(c[i])
        return out
