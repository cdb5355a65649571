"""Structure learning as continuous optimisation. Where the loss is quadratic the rows are read once, for moments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.moments import moments
from causeway.plans.base import Graph, Learner, learner
from causeway.plans.dense import acyclicity, acyclicity_power, cut_to_dag, minimise
from causeway.plans.lingam import batch_sums

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def augmented_lagrangian(inner: Callable[[float, float, np.ndarray], np.ndarray], h_of: Callable[[np.ndarray], float], x: np.ndarray, rounds: int, h_tol: float, rho_max: float) -> np.ndarray:
    """Multiplier method for h(x) = 0: rho grows tenfold until h falls to a quarter, then the multiplier moves."""
    rho, alpha, h = 1.0, 0.0, np.inf
    for _ in range(rounds):
        while True:
            new = inner(rho, alpha, x)
            h_new = h_of(new)
            if h_new <= 0.25 * h or rho >= rho_max:
                break
            rho *= 10
        x, h = new, h_new
        alpha += rho * h
        if h <= h_tol or rho >= rho_max:
            break
    return x


def sparse_acyclic(loss: Loss, d: int, lambda1: float, rounds: int, h_tol: float, rho_max: float, steps: int = 300) -> np.ndarray:
    """Least loss + lambda1 |w| over acyclic w; positive and negative parts are separate variables >= 0."""
    off = ~np.eye(d, dtype=bool)

    def matrix(x: np.ndarray) -> np.ndarray:
        w = np.zeros((d, d))
        w[off] = x[: d * (d - 1)] - x[d * (d - 1) :]
        return w

    def inner(rho: float, alpha: float, x: np.ndarray) -> np.ndarray:
        def penalised(x: np.ndarray, value: float, grad: np.ndarray) -> tuple[float, np.ndarray]:
            h, grad_h = acyclicity_power(matrix(x))
            smooth = (grad + (rho * h + alpha) * grad_h)[off]
            return value + 0.5 * rho * h * h + alpha * h + lambda1 * x.sum(), np.concatenate([smooth, -smooth]) + lambda1

        def f(x: np.ndarray) -> tuple[float, np.ndarray]:
            return penalised(x, *loss(matrix(x)))

        if hasattr(loss, "many"):
            f.many = lambda points: [penalised(x, *got) for x, got in zip(points, loss.many([matrix(x) for x in points]), strict=True)]
        return minimise(f, x, 0.0, steps)

    return matrix(augmented_lagrangian(inner, lambda x: acyclicity_power(matrix(x))[0], np.zeros(2 * d * (d - 1)), rounds, h_tol, rho_max))


def quadratic_loss(gram: np.ndarray) -> Loss:
    """|X - XW|^2 / 2n from X'X / n."""

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        r = np.eye(len(w)) - w
        return 0.5 * float(np.trace(r.T @ gram @ r)), -gram @ r

    return f


def row_loss(df: DataFrame, columns: list[str], kind: str, n: int) -> Loss:
    """Logistic or Poisson loss and its gradient, summed over the rows by Spark; many() does so at several matrices in one pass."""
    d = len(columns)

    def many(ws: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        def part(x: np.ndarray) -> np.ndarray:
            out = []
            for w in ws:
                z = x @ w
                if kind == "logistic":
                    value, slope = (np.logaddexp(0, z) - x * z).sum(), 1 / (1 + np.exp(-z)) - x
                else:
                    s = np.exp(np.minimum(z, 50))
                    value, slope = (s - x * z).sum(), s - x
                out += [[value], (x.T @ slope).ravel()]
            return np.concatenate(out)

        sums = batch_sums(df, columns, part, len(ws) * (1 + d * d)).reshape(len(ws), -1) / n
        return [(float(s[0]), s[1:].reshape(d, d)) for s in sums]

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        return many([w])[0]

    f.many = many
    return f


@learner
class Notears(Learner):
    """loss: 'l2' (centred; one pass over the rows), 'logistic' or 'poisson' (one pass an evaluation)."""

    def __init__(self, lambda1: float = 0.1, loss: str = "l2", max_iter: int = 100, h_tol: float = 1e-8, rho_max: float = 1e16, threshold: float = 0.3, steps: int = 300):
        if loss not in ("l2", "logistic", "poisson"):
            raise ValueError("loss is l2, logistic or poisson")
        self.lambda1, self.loss, self.max_iter, self.h_tol, self.rho_max, self.threshold, self.steps = lambda1, loss, max_iter, h_tol, rho_max, threshold, steps

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        if self.loss == "l2":
            loss = quadratic_loss(moments(df, columns).cov)
        else:
            rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).na.drop("any").persist()
            loss = row_loss(rows, columns, self.loss, rows.count())
        w = sparse_acyclic(loss, len(columns), self.lambda1, self.max_iter, self.h_tol, self.rho_max, self.steps)
        if self.loss != "l2":
            rows.unpersist()
        w = np.where(np.abs(w) > self.threshold, w, 0.0)
        return Graph(list(columns), (w != 0).astype(int), w)


@learner
class NotearsLowRank(Learner):
    """W = U V' of a given rank; moments are not centred. Restarts from other seeds if a start fails."""

    def __init__(self, rank: int = 3, max_iter: int = 15, h_tol: float = 1e-6, rho_max: float = 1e20, threshold: float = 0.3, seed: int = 0, restarts: int = 5):
        self.rank, self.max_iter, self.h_tol, self.rho_max, self.threshold, self.seed, self.restarts = rank, max_iter, h_tol, rho_max, threshold, seed, restarts

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        gram, d, r = moments(df, columns).raw, len(columns), self.rank
        loss, off = quadratic_loss(gram), 1 - np.eye(len(columns))
        matrix = lambda x: (x[: d * r].reshape(d, r) @ x[d * r :].reshape(d, r).T) * off
        best = None
        for k in range(self.restarts):

            def inner(rho: float, alpha: float, x: np.ndarray) -> np.ndarray:
                def f(x: np.ndarray) -> tuple[float, np.ndarray]:
                    w = matrix(x)
                    value, grad = loss(w)
                    h, grad_h = acyclicity(w)
                    g = (grad + (rho * h + alpha) * grad_h) * off
                    u, v = x[: d * r].reshape(d, r), x[d * r :].reshape(d, r)
                    return value + 0.5 * rho * h * h + alpha * h, np.concatenate([(g @ v).ravel(), (g.T @ u).ravel()])

                return minimise(f, x)

            x = np.random.default_rng(self.seed + k).uniform(-0.5, 0.5, 2 * d * r)
            x = augmented_lagrangian(inner, lambda x: acyclicity(matrix(x))[0], x, self.max_iter, self.h_tol, self.rho_max)
            value = loss(matrix(x))[0]
            if np.isfinite(value) and (best is None or value < best[0]):
                best = (value, matrix(x))
        w = cut_to_dag(best[1], self.threshold)
        return Graph(list(columns), (w != 0).astype(int), w)


@learner
class Golem(Learner):
    """Likelihood with equal or unequal noise variances plus soft sparsity and acyclicity, by Adam on moments."""

    def __init__(self, lambda1: float = 0.02, lambda2: float = 5.0, equal_variances: bool = True, steps: int = 5000, rate: float = 0.005, threshold: float = 0.3):
        self.lambda1, self.lambda2, self.equal_variances, self.steps, self.rate, self.threshold = lambda1, lambda2, equal_variances, steps, rate, threshold

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        m, d = moments(df, columns), len(columns)
        b = self._descend(m.raw, np.zeros((d, d)), True)
        if not self.equal_variances:
            b = self._descend(m.raw, b, False)
        w = cut_to_dag(b, self.threshold)
        return Graph(list(columns), (w != 0).astype(int), w)

    def _descend(self, gram: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        d, off = len(b), 1 - np.eye(len(b))
        one, two = np.zeros_like(b), np.zeros_like(b)
        for t in range(1, self.steps + 1):
            r = np.eye(d) - b
            rss = np.einsum("ij,ik,kj->j", r, gram, r)
            fit = -gram @ r
            fit = d * fit / rss.sum() if equal else fit / rss
            grad = fit + np.linalg.inv(r).T + self.lambda1 * np.sign(b) + self.lambda2 * acyclicity(b)[1]
            grad *= off
            one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad * grad
            b = b - self.rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
        return b


@learner
class NotearsBasis(Learner):
    """Nonlinear additive model: every effect is a sum of sines of growing frequency of the standardised cause.

    The model is linear in the basis, so one pass for the moments of d * k features
    is all the data it needs. An edge's strength is the norm of its coefficients.
    """

    def __init__(self, k: int = 4, lambda1: float = 0.01, lambda2: float = 0.01, max_iter: int = 50, h_tol: float = 1e-8, rho_max: float = 1e12, threshold: float = 0.3):
        self.k, self.lambda1, self.lambda2, self.max_iter, self.h_tol, self.rho_max, self.threshold = k, lambda1, lambda2, max_iter, h_tol, rho_max, threshold

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        base = moments(df, columns)
        d, k = len(columns), self.k
        scale = np.sqrt(np.diag(base.cov))
        u = {c: (F.col(f"`{c}`") - float(base.mean[i])) / float(scale[i] or 1.0) for i, c in enumerate(columns)}
        features = [(F.sin(u[c] / (2 * j - 1) * (j * 1.0)) * (2.0 / (2 * j - 1))).alias(f"f_{i}_{j}") for i, c in enumerate(columns) for j in range(1, k + 1)]
        m = moments(df.select(*[u[c].alias(f"u_{i}") for i, c in enumerate(columns)], *features), [*[f"u_{i}" for i in range(d)], *[f"f_{i}_{j}" for i in range(d) for j in range(1, k + 1)]])
        ff, fu, uu = m.cov[d:, d:], m.cov[d:, :d], np.diag(m.cov)[:d]
        off = np.repeat(1 - np.eye(d), k, axis=0)
        smooth = 1e-6

        def strength(b: np.ndarray) -> np.ndarray:
            return np.sqrt((b.reshape(d, k, d) ** 2).sum(axis=1) + smooth**2)

        def inner(rho: float, alpha: float, x: np.ndarray) -> np.ndarray:
            def f(x: np.ndarray) -> tuple[float, np.ndarray]:
                b = x.reshape(d * k, d) * off
                w = strength(b) * (1 - np.eye(d))
                h, grad_h = acyclicity_power(w)
                fit = 0.5 * (uu.sum() - 2 * (b * fu).sum() + np.einsum("ij,ik,kj->", b, ff, b))
                group = b.reshape(d, k, d) / strength(b)[:, None, :]
                grad = ff @ b - fu + self.lambda2 * b + (((rho * h + alpha) * grad_h + self.lambda1)[:, None, :] * group).reshape(d * k, d)
                return fit + 0.5 * rho * h * h + alpha * h + self.lambda1 * w.sum() + 0.5 * self.lambda2 * (b * b).sum(), (grad * off).ravel()

            return minimise(f, x)

        start = np.random.default_rng(0).normal(0, 0.05, d * k * d)
        x = augmented_lagrangian(inner, lambda x: acyclicity_power(strength(x.reshape(d * k, d) * off) * (1 - np.eye(d)))[0], start, self.max_iter, self.h_tol, self.rho_max)
        w = cut_to_dag(strength(x.reshape(d * k, d) * off) * (1 - np.eye(d)), self.threshold)
        return Graph(list(columns), (w != 0).astype(int), w)


@learner
class MaskedRegression(Learner):
    """A relaxed 0/1 mask over linear effects: w = sigmoid(logit / temperature) * b, acyclic in the mask, least squares by moments.

    lambda2 holds effects down, as a closed mask could else hide behind a large one."""

    def __init__(self, temperature: float = 0.2, lambda1: float = 2e-3, lambda2: float = 0.05, max_iter: int = 25, h_tol: float = 1e-8, rho_max: float = 1e12, threshold: float = 0.5, seed: int = 0):
        self.temperature, self.lambda1, self.lambda2, self.max_iter, self.h_tol, self.rho_max, self.threshold, self.seed = temperature, lambda1, lambda2, max_iter, h_tol, rho_max, threshold, seed

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        m, d = moments(df, columns), len(columns)
        loss, off = quadratic_loss(m.cov), 1 - np.eye(len(columns))

        def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a = x.reshape(2, d, d)
            return off / (1 + np.exp(-np.clip(a[0] / self.temperature, -50, 50))), a[1]

        def inner(rho: float, alpha: float, x: np.ndarray) -> np.ndarray:
            def f(x: np.ndarray) -> tuple[float, np.ndarray]:
                mask, b = split(x)
                value, grad = loss(mask * b)
                h, grad_h = acyclicity(mask)
                to_mask = (grad * b + (rho * h + alpha) * grad_h + self.lambda1) * mask * (1 - mask) / self.temperature * off
                return value + 0.5 * rho * h * h + alpha * h + self.lambda1 * mask.sum() + 0.5 * self.lambda2 * (b * b).sum(), np.concatenate([to_mask.ravel(), (grad * mask + self.lambda2 * b).ravel()])

            return minimise(f, x)

        rng = np.random.default_rng(self.seed)
        effects = np.zeros((d, d))
        for j in range(d):
            others = [i for i in range(d) if i != j]
            effects[others, j] = np.linalg.lstsq(m.cov[np.ix_(others, others)], m.cov[others, j], rcond=None)[0]
        # Effects start from the regressions on all others, and masks by their size: from zero the constraint closes every mask first.
        start = np.concatenate([(self.temperature * 4 * (np.abs(effects) - 0.25) + rng.normal(0, 0.05, (d, d))).ravel(), effects.ravel()])
        x = augmented_lagrangian(inner, lambda x: acyclicity(split(x)[0])[0], start, self.max_iter, self.h_tol, self.rho_max)
        mask, b = split(x)
        w = cut_to_dag(np.where(mask > self.threshold, mask, 0))
        return Graph(list(columns), (w != 0).astype(int), np.where(w != 0, b, 0))
