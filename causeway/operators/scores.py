"""Decomposable scores of a node given its parents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.moments import Moments, moments


class Score:
    """A score of (node, parents), computed once for each; higher is better. Subclass local() for one's own."""

    def __init__(self) -> None:
        self._known: dict[tuple[int, frozenset], float] = {}

    def of(self, y: int, parents) -> float:
        key = (y, frozenset(parents))
        if key not in self._known:
            self._known[key] = self.local(y, sorted(key[1]))
        return self._known[key]

    def local(self, y: int, parents: list[int]) -> float:
        raise NotImplementedError

    def prepare(self, families) -> None:
        """Told which (y, parents) will be asked for next; a score that reads rows may answer them together."""


class BIC(Score):
    """Gaussian BIC from moments: by residual variance ('scatter') or by 1 - r squared ('r2')."""

    def __init__(self, m: Moments, method: str = "scatter"):
        super().__init__()
        self.m, self.method = m, method

    def local(self, y: int, parents: list[int]) -> float:
        variance = max(self.m.residual_variance(y, parents), 1e-300)
        n, k = self.m.n, len(parents)
        if self.method == "scatter":
            return -(n * (1 + math.log(variance)) + (k + 1) * math.log(n))
        return -(n * math.log(variance / self.m.cov[y, y]) + k * math.log(n))


class BDeu(Score):
    """Bayesian Dirichlet score of discrete columns, structure prior k and sample size N.

    All families that a search step asks for are counted by one aggregation; counts of a task are merged before they
    are sent. Levels are told apart by their text.
    """

    def __init__(self, df: DataFrame, columns: list[str], k: float = 0.001, size: float = 10.0):
        super().__init__()
        self.raw, self.columns, self.k, self.size, self.jobs = df.select(*[F.col(f"`{c}`") for c in columns]), columns, k, size, 0
        self.df = self.raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
        row = self.df.agg(*[F.countDistinct(F.col(f"`{c}`")) for c in columns]).first()
        self.levels = list(row)

    def counts(self, y: int, parents: list[int]) -> DataFrame:
        """Rows (n_ijk) of each level of the parents and y that occurs, nulls included, in the columns' own types."""
        return self.raw.groupBy(*[F.col(f"`{self.columns[c]}`") for c in [*parents, y]]).agg(F.count(F.lit(1)).alias("n_ijk"))

    def local(self, y: int, parents: list[int]) -> float:
        self.prepare([(y, parents)])
        return self._known[y, frozenset(parents)]

    def prepare(self, families) -> None:
        new = sorted({(y, tuple(sorted(set(p)))) for y, p in families} - {(y, tuple(sorted(p))) for y, p in self._known})
        for a in range(0, len(new), 500):
            part = new[a : a + 500]
            self.jobs += 1
            asked = [F.struct(F.lit(f).alias("family"), F.array(*[F.col(f"`{self.columns[p]}`") for p in parents]).cast("array<string>").alias("given"), F.col(f"`{self.columns[y]}`").alias("level")) for f, (y, parents) in enumerate(part)]
            cells = self.df.select(F.inline(F.array(*asked))).groupBy("family", "given", "level").agg(F.count(F.lit(1)).alias("n"))
            # Configurations of like counts give like terms, so of each family only the different ones come back.
            shapes = cells.groupBy("family", "given").agg(F.array_sort(F.collect_list("n")).alias("ns")).groupBy("family", "ns").agg(F.count(F.lit(1)).alias("times")).collect()
            for f, (y, parents) in enumerate(part):
                r, q = self.levels[y], math.prod(self.levels[p] for p in parents)
                # Configurations that no row has add nothing: both of their terms are 0.
                out = (r - 1) * q * math.log(self.k)
                for s in (s for s in shapes if s["family"] == f):
                    of_j = math.lgamma(self.size / q) - math.lgamma(sum(s["ns"]) + self.size / q)
                    out += s["times"] * (of_j + sum(math.lgamma(n + self.size / (r * q)) - math.lgamma(self.size / (r * q)) for n in s["ns"]))
                self._known[y, frozenset(parents)] = out


def bic_frame(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    """One row (n, score): BIC by residual variance of y on nothing or one parent, within the plan."""
    cols = [F.col(f"`{y}`").alias("y")] + ([F.col(f"`{x}`").alias("x")] if x else [])
    rows = df.select(*cols).na.drop("any")
    variance = F.var_pop("y") - (F.pow(F.covar_pop("y", "x"), 2) / F.var_pop("x") if x else F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("n"), variance.alias("v")).select("n", (-(F.col("n") * (1 + F.log("v")) + (1 + bool(x)) * F.log(F.col("n").cast("double")))).alias("score"))


def residual_sums(m: Moments, graph: np.ndarray) -> np.ndarray:
    """Sum of squares left of every column after regression on its parents in a 0/1 matrix (i, j) = i -> j."""
    return np.array([m.n * m.residual_variance(j, np.flatnonzero(graph[:, j]).tolist()) for j in range(len(graph))])


def graph_reward(m: Moments, graph: np.ndarray, equal_variances: bool = True, edge_penalty: bool = True) -> float:
    """The BIC of a whole graph per observation, lower is better; edges are penalised or not."""
    rss, d, n = residual_sums(m, graph), len(graph), m.n
    edges = graph.sum() * math.log(n) / n * edge_penalty
    return math.log(rss.sum() / n + 1e-8) + edges / d if equal_variances else float(np.log(rss / n + 1e-8).sum() + edges)


def reward_bounds(m: Moments, equal_variances: bool = True) -> tuple[float, float]:
    """Scores without edges and with all of them: the range that rewards are rescaled by."""
    d = len(m.columns)
    full = 1 - np.eye(d, dtype=int)
    return graph_reward(m, full, equal_variances, False), graph_reward(m, np.zeros((d, d), dtype=int), equal_variances, False)


def prune_by_coefficient(m: Moments, graph: np.ndarray, threshold: float = 0.3) -> np.ndarray:
    """Edges whose regression coefficient is at least threshold in size."""
    out = np.zeros_like(graph)
    for j in range(len(graph)):
        parents = np.flatnonzero(graph[:, j]).tolist()
        if parents:
            out[parents, j] = np.abs(m.coefficients(j, parents)) >= threshold
    return out


def prune_second_order(m: Moments, columns: list[str], graph: np.ndarray, threshold: float = 0.3) -> np.ndarray:
    """Edges whose cause has a coefficient of at least threshold in size, alone or in a product, in the regression on
    all parents and the products of two of them. m: family_moments(df, columns, 2)."""
    out, at = np.zeros_like(graph), {c: i for i, c in enumerate(m.columns)}
    for j in range(len(graph)):
        parents = np.flatnonzero(graph[:, j]).tolist()
        terms = [(p,) for p in parents] + [(p, q) for k, p in enumerate(parents) for q in parents[k:]]
        if parents:
            b = m.coefficients(at[columns[j]], [at["*".join(columns[p] for p in t)] for t in terms])
            for t, size in zip(terms, np.abs(b), strict=True):
                out[list(t), j] |= int(size >= threshold)
    return out


def family_moments(df: DataFrame, columns: list[str], degree: int = 1) -> Moments:
    """Moments of the columns, with all products of two beside them for degree 2."""
    if degree == 1:
        return moments(df, columns)
    products = {f"{a}*{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for i, a in enumerate(columns) for b in columns[i:]}
    return moments(df.withColumns(products), [*columns, *products])


class FamilyFit:
    """Scores of graphs and of variables given parents, for regressions of three kinds, all from one pass over the rows.

    LR: on the parents. QR: on them and the products of two. GPR: a Gaussian process that
    adds a smooth curve for each parent, with observation noise alpha, of standardised columns. Lower is
    better; with equal variances the variables share one.
    """

    def __init__(self, df: DataFrame, columns: list[str], regression: str = "LR", equal_variances: bool = True, penalised: bool = True, alpha: float = 1.0):
        self.columns, self.regression, self.equal, self.penalised, self.alpha = list(columns), regression, equal_variances, penalised, alpha
        if regression == "GPR":
            from causeway.operators.lowrank import curve_moments

            self.m, self.blocks = curve_moments(df, columns)
        else:
            self.m = family_moments(df, columns, 2 if regression == "QR" else 1)
        self._at = {c: i for i, c in enumerate(self.m.columns)}
        self._known: dict[tuple[int, frozenset], float] = {}

    def residual(self, y: int, parents) -> float:
        """Mean square that is left of y."""
        key = (int(y), frozenset(int(p) for p in parents))
        if key not in self._known:
            self._known[key] = max(self._residual(key[0], sorted(key[1])), 1e-12)
        return self._known[key]

    def _residual(self, y: int, parents: list[int]) -> float:
        if not parents:
            return float(self.m.cov[y, y])
        if self.regression == "GPR":
            at = [k for p in parents for k in self.blocks[p]]
            gram, b = self.m.cov[np.ix_(at, at)], self.m.cov[at, y]
            w = np.linalg.solve(gram + self.alpha / self.m.n * np.eye(len(at)), b)
            return float(self.m.cov[y, y] - 2 * w @ b + w @ gram @ w)
        names = [self.columns[p] for p in parents]
        if self.regression == "QR":
            names += [f"{a}*{b}" for k, a in enumerate(names) for b in names[k:]]
        return self.m.residual_variance(y, [self._at[c] for c in names])

    def term(self, y: int, parents) -> float:
        """What a variable adds to the score of a whole ordering."""
        r = self.residual(y, parents)
        return r / np.trace(self.m.cov[: len(self.columns), : len(self.columns)]) if self.equal else math.log(r + 1e-8)

    def parts(self, graphs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each graph what is left of each variable, and the penalty of the edges into it."""
        left = np.array([[self.residual(j, np.flatnonzero(g[:, j])) for j in range(len(g))] for g in graphs])
        edges = graphs.sum(axis=1) * math.log(self.m.n) / self.m.n * self.penalised
        return left, edges / graphs.shape[1] if self.equal else edges

    def total(self, parents: list[tuple], nodes=None) -> float:
        """The score of a graph given as the parents of its nodes."""
        nodes = range(len(parents)) if nodes is None else nodes
        left = np.array([self.residual(y, p) for y, p in zip(nodes, parents, strict=True)])
        edges = sum(len(p) for p in parents) * math.log(self.m.n) / self.m.n * self.penalised
        return math.log(left.sum() + 1e-8) + edges / len(left) if self.equal else float(np.log(left + 1e-8).sum() + edges)

    def graph(self, g: np.ndarray) -> float:
        return self.total([tuple(np.flatnonzero(g[:, j]).tolist()) for j in range(len(g))])

    def bounds(self) -> tuple[float, float]:
        """Unpenalised scores with all edges and with none."""
        d, keep = len(self.columns), self.penalised
        self.penalised = False
        out = self.total([tuple(p for p in range(d) if p != j) for j in range(d)]), self.total([()] * d)
        self.penalised = keep
        return out


def total_effect(m: Moments, source: int, target: int, parents: list[int]) -> float:
    """Coefficient of source in the regression of target on source and its parents."""
    return float(m.coefficients(target, [source, *[p for p in parents if p != source]])[0])
