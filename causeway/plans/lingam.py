"""Linear non-Gaussian models: causal order from entropies or independent components, then sparse coefficients."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.columns import ENTROPY_GAMMA, ENTROPY_K1, ENTROPY_K2
from causeway.operators.frame import poisson_weight, replicates
from causeway.operators.lowrank import batch_totals, kernel_information, numbers
from causeway.operators.moments import Moments, moments
from causeway.operators.scores import total_effect
from causeway.plans.base import Graph, Learner, learner
from causeway.plans.dense import assign, cut_to_dag, lasso_bic, order_of


def batch_sums(df: DataFrame, columns: list[str], f, size: int) -> np.ndarray:
    """Sum over all rows of f(batch matrix) -> vector of this size: one pass, partial sums in the tasks."""
    rows = numbers(df, columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(size), pa.int32()), "v": pa.array(total)})

    out = np.zeros(size)
    for r in rows.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def entropies(df: DataFrame, m: Moments, vectors: np.ndarray) -> np.ndarray:
    """Approximate entropy of each linear combination (a column of vectors), standardised."""
    scale = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", vectors, m.cov, vectors), 1e-300))
    v, k = vectors / scale, vectors.shape[1]

    def f(x: np.ndarray) -> np.ndarray:
        u = (x - m.mean) @ v
        a = np.abs(u)
        return np.concatenate([(a + np.log1p(np.exp(-2 * a)) - np.log(2)).sum(axis=0), (u * np.exp(-u * u / 2)).sum(axis=0)])

    sums = batch_sums(df, m.columns, f, 2 * k) / m.n
    return (1 + np.log(2 * np.pi)) / 2 - ENTROPY_K1 * (sums[:k] - ENTROPY_GAMMA) ** 2 - ENTROPY_K2 * sums[k:] ** 2


def ordering(m: Moments, prior: np.ndarray | None = None, measure: str = "pwling") -> Generator:
    """Repeatedly the variable least dependent on its residuals. Yields what it must know of the rows, and returns the order.

    It asks for the entropies of linear combinations (a matrix), or for the kernel information of some with others (a pair).
    """
    d = len(m.columns)
    maps, left, order = np.eye(d), list(range(d)), []  # column j: variable j less all chosen ones, in terms of the data
    while len(left) > 1:
        pairs = [(i, j) for i in left for j in left if i != j]
        cov = maps.T @ m.cov @ maps
        residuals = np.column_stack([maps[:, i] - cov[i, j] / cov[j, j] * maps[:, j] for i, j in pairs])
        if measure == "kernel":
            information = yield maps[:, left], [residuals[:, [k for k, (_, j) in enumerate(pairs) if j == i]] for i in left]
            gain = {i: -float(v.sum()) for i, v in zip(left, information, strict=True)}
        else:
            h = yield np.column_stack([maps[:, left], residuals])
            single = dict(zip(left, h, strict=False))
            of_pair = dict(zip(pairs, h[len(left) :], strict=True))
            gain = {i: -sum(min(0.0, single[j] + of_pair[i, j] - single[i] - of_pair[j, i]) ** 2 for j in left if j != i) for i in left}
        allowed = [i for i in left if prior is None or not any(prior[j, i] == 1 for j in left)] or left
        root = max(allowed, key=lambda i: gain[i])
        order.append(root)
        left.remove(root)
        for j in left:
            maps[:, j] = maps[:, j] - cov[j, root] / cov[root, root] * maps[:, root]
    return order + left


def answered(orderings: list[Generator], answer: Callable[[dict[int, object]], dict[int, object]]) -> list[list[int]]:
    """Run several orderings side by side: answer gets all their questions of a step, and so takes one pass for all."""
    orders: list = [None] * len(orderings)
    replies: dict[int, object] = dict.fromkeys(range(len(orderings)))
    while replies:
        questions = {}
        for k, reply in replies.items():
            try:
                questions[k] = orderings[k].send(reply)
            except StopIteration as end:
                orders[k] = end.value
        replies = answer(questions) if questions else {}
    return orders


def causal_order(df: DataFrame, m: Moments, prior: np.ndarray | None = None, measure: str = "pwling") -> list[int]:
    """The order of one data set; one pass over the rows a variable, or some for the kernels' factors."""

    def answer(questions: dict) -> dict:
        return {k: kernel_information(df, m, *q) if measure == "kernel" else entropies(df, m, q) for k, q in questions.items()}

    return answered([ordering(m, prior, measure)], answer)[0]


def weighted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The values of rows, and their weights in every replicate, which the last column holds."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
    return x, batch.columns[-1].flatten().to_numpy().reshape(len(x), -1).astype(np.float64)


def replicate_moments(rows: DataFrame, m: Moments, n: int) -> list[Moments]:
    """Moments of n replicates, in one pass. m: of all rows, about whose mean is summed."""
    d = len(m.columns)
    at = np.triu_indices(d)

    def f(data: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        x, w = data[0] - m.mean, data[1]
        return np.concatenate([w.sum(axis=0), (w.T @ x).ravel(), (w.T @ (x[:, at[0]] * x[:, at[1]])).ravel()])

    sums = batch_totals(rows, f, n * (1 + d + len(at[0])), read=weighted)
    out = []
    for r in range(n):
        size = max(sums[r], 1.0)
        mean, cov = sums[n + r * d : n + (r + 1) * d] / size, np.zeros((d, d))
        cov[at] = sums[n + n * d :].reshape(n, -1)[r] / size
        cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
        out.append(Moments(m.columns, int(sums[r]), m.mean + mean, cov))
    return out


def replicate_orders(rows: DataFrame, ms: list[Moments], prior: np.ndarray | None) -> list[list[int]]:
    """The causal orders of all replicates: one pass a variable, however many there are."""

    def answer(questions: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        parts, shift, of = [], [], []
        for r, v in questions.items():
            v = v / np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", v, ms[r].cov, v), 1e-300))
            parts.append(v)
            shift.append(ms[r].mean @ v)
            of += [r] * v.shape[1]
        way, less, of = np.column_stack(parts), np.concatenate(shift), np.array(of)

        def f(data: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
            u, w = data[0] @ way - less, data[1][:, of]
            a = np.abs(u)
            return np.concatenate([((a + np.log1p(np.exp(-2 * a)) - np.log(2)) * w).sum(axis=0), (u * np.exp(-u * u / 2) * w).sum(axis=0)])

        sums = batch_totals(rows, f, 2 * len(of), 512, weighted).reshape(2, -1) / np.array([max(ms[r].n, 1) for r in of])
        h = (1 + np.log(2 * np.pi)) / 2 - ENTROPY_K1 * (sums[0] - ENTROPY_GAMMA) ** 2 - ENTROPY_K2 * sums[1] ** 2
        return {r: h[of == r] for r in questions}

    return answered([ordering(m, prior) for m in ms], answer)


def sparse_coefficients(m: Moments, order: list[int], prior: np.ndarray | None = None) -> np.ndarray:
    """(i, j) = effect of i on j: adaptive lasso of each variable on those before it."""
    d = len(order)
    b = np.zeros((d, d))
    for k, j in enumerate(order):
        before = [i for i in order[:k] if prior is None or prior[i, j] != 0]
        if before:
            weight = np.abs(m.coefficients(j, before))
            xx = m.cov[np.ix_(before, before)] * np.outer(weight, weight)
            b[before, j] = lasso_bic(xx, m.cov[before, j] * weight, m.cov[j, j], m.n) * weight
    return b


@learner
class DirectLiNGAM(Learner):
    """prior: optional matrix with 1 where i -> j is required, 0 where it is ruled out, -1 elsewhere.

    measure: 'pwling' compares approximate entropies, 'kernel' sums the kernel mutual information of a variable and
    the residuals on it.
    """

    def __init__(self, threshold: float = 0.3, prior: np.ndarray | None = None, measure: str = "pwling"):
        if measure not in ("pwling", "kernel"):
            raise ValueError("measure is pwling or kernel")
        self.threshold, self.prior, self.measure = threshold, prior, measure

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        m = moments(df, columns)
        rows = numbers(df, columns).persist()
        try:
            order = causal_order(rows, m, self.prior, self.measure)
        finally:
            rows.unpersist()
        return self._graph(m, order)

    def _graph(self, m: Moments, order: list[int]) -> Graph:
        b = sparse_coefficients(m, order, self.prior)
        return Graph(list(m.columns), (np.abs(b) > self.threshold).astype(int), b, {"order": order, "moments": m})

    def learn_replicates(self, df: DataFrame, columns: list[str], key: list[str], n: int, seed: int, m: Moments) -> list[Graph]:
        """The graphs of n Poisson replicates, from as many passes as one takes."""
        names = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
        weights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: poisson_weight(seed, r, key))
        rows = df.select(*names, weights.alias("_weights")).na.drop("any", subset=[f"`{c}`" for c in columns]).persist()
        try:
            ms = replicate_moments(rows, m, n)
            return [self._graph(mr, order) for mr, order in zip(ms, replicate_orders(rows, ms, self.prior), strict=True)]
        finally:
            rows.unpersist()


@learner
class ICALiNGAM(Learner):
    def __init__(self, max_iter: int = 100, threshold: float = 0.3, tolerance: float = 1e-5, seed: int = 0):
        self.max_iter, self.threshold, self.tolerance, self.seed = max_iter, threshold, tolerance, seed

    def unmixing(self, df: DataFrame, m: Moments) -> np.ndarray:
        """Fixed-point iteration for independent components; one pass over the rows a step."""
        values, vectors = np.linalg.eigh(m.cov)
        d = len(values)
        white = (vectors / np.sqrt(np.maximum(values, 1e-12))).T

        def orthogonal(w: np.ndarray) -> np.ndarray:
            u, _, v = np.linalg.svd(w)
            return u @ v

        w = orthogonal(np.random.default_rng(self.seed).normal(size=(d, d)))
        for _ in range(self.max_iter):

            def f(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                z = (x - m.mean) @ white.T
                g = np.tanh(z @ w.T)
                return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(axis=0)])

            sums = batch_sums(df, m.columns, f, d * d + d) / m.n
            new = orthogonal(sums[: d * d].reshape(d, d) - sums[d * d :, None] * w)
            change = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
            w = new
            if change < self.tolerance:
                break
        return w @ white

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        m = moments(df, columns)
        data = numbers(df, columns).persist()
        try:
            w = self.unmixing(data, m)
        finally:
            data.unpersist()
        rows = assign(1 / np.maximum(np.abs(w), 1e-12).T)  # the component that belongs to each variable
        w = w[rows]
        b = np.eye(len(w)) - w / np.diag(w)[:, None]
        order = order_of(cut_to_dag(b.T) != 0)
        b = sparse_coefficients(m, order)
        return Graph(list(columns), (np.abs(b) > self.threshold).astype(int), b, {"order": order})


def bootstrap(df: DataFrame, columns: list[str], key: list[str], n: int, model: Learner, seed: int = 0, threads: int = 4) -> DataFrame:
    """(replicate, src, dst, weight, effect) of the edges that a learner finds on Poisson replicates of the rows.

    Total effects come from the moments of all rows. DirectLiNGAM with entropies learns all replicates in the same
    passes, in which every row weighs what it weighs in each; of other learners so many replicates
    as threads run their jobs side by side.
    """
    spark, m = df.sparkSession, moments(df, columns)
    graphs = model.learn_replicates(df, columns, key, n, seed, m) if isinstance(model, DirectLiNGAM) and model.measure == "pwling" else _one_by_one(df, columns, key, n, model, seed, threads)
    out = []
    for r, g in enumerate(graphs):
        w = g.matrix if g.weights is None else g.weights
        for i, j in np.argwhere(g.matrix != 0):
            out.append((r, int(i), int(j), float(w[i, j]), total_effect(m, int(i), int(j), np.flatnonzero(g.matrix[:, i]).tolist())))
    return spark.createDataFrame(out, "replicate int, src int, dst int, weight double, effect double")


def _one_by_one(df: DataFrame, columns: list[str], key: list[str], n: int, model: Learner, seed: int, threads: int) -> list[Graph]:
    every = replicates(df, n, key, seed, columns)

    def found(r: int) -> Graph:
        rows = every.filter(F.col("replicate") == r).select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col("weight"))).alias("_copy")).drop("_copy")
        return model.learn(rows, columns)

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(found, range(n)))


def direction_counts(edges: DataFrame, least: float = 0.0, signs: bool = False) -> DataFrame:
    """How many replicates have each edge (of each sign)."""
    rows = edges.filter(F.abs("weight") > least)
    keys = ["src", "dst"] + (["sign"] if signs else [])
    return rows.withColumn("sign", F.signum("weight").cast("int")).groupBy(*keys).agg(F.countDistinct("replicate").alias("n"))


def graph_counts(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """How many replicates have each whole graph, as a sorted array of edges."""
    one = edges.filter(F.abs("weight") > least).groupBy("replicate").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("graph"))
    return one.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


def edge_probabilities(edges: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    return direction_counts(edges, least).select("src", "dst", (F.col("n") / n).alias("probability"))


def median_effects(edges: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """(src, dst, effect, probability): the median total effect of the replicates that have the edge."""
    rows = edges.filter(F.abs("weight") > least)
    return rows.groupBy("src", "dst").agg(F.median("effect").alias("effect"), (F.countDistinct("replicate") / n).alias("probability"))
