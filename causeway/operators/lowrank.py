"""Gaussian kernels of all rows by a bounded number of features: pivoted incomplete Cholesky factors on Spark.

A factor has a row r of features for each data row x with r . r' = k(x, x') up to a
tolerance. Its pivots are data rows: every task finds the rows that the pivots so far
explain least and sends a few of them, well apart from each other, and the driver
joins those to the pivots; this is repeated until no row's residual is over the
tolerance, two to four passes, whatever the number of rows. Features of a row need the
pivots alone, so what is quadratic in rows by its formula becomes sums over rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.moments import Moments, moments

#: Pivots of a factor, and rows that a task proposes for it in a pass.
MOST, PROPOSED = 200, 24


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, of the rows that have them all."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).na.drop("any")


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def batch_totals(rows: DataFrame, f: Callable[..., np.ndarray], size: int, step: int = 2048, read: Callable[[pa.RecordBatch], object] = matrix_of) -> np.ndarray:
    """Sum over all rows of f(matrix of some rows): one vector a task, added up in two levels of groups."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                total += f(read(batch.slice(a, step)))
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for chunk in table.column("v").to_pylist():
            total += np.frombuffer(chunk)
        return pa.table({"v": [total.tobytes()]})

    sums = rows.mapInArrow(partial, "v binary").groupBy(F.spark_partition_id() % 64).applyInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in sums), np.zeros(size))


def kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    gaps = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-np.maximum(gaps, 0) / (2 * width * width))


def pivoted(z: np.ndarray, width: float, tolerance: float, most: int, left: np.ndarray | None = None) -> np.ndarray:
    """Rows of z, the worst explained first, until none has a residual over the tolerance. left: residuals to start from."""
    residual = np.ones(len(z)) if left is None else left.copy()
    factor, chosen = np.zeros((len(z), 0)), []
    while len(chosen) < min(most, len(z)):
        k = int(residual.argmax())
        if residual[k] <= tolerance:
            break
        column = (kernel(z, z[k : k + 1], width)[:, 0] - factor @ factor[k]) / math.sqrt(max(1 - factor[k] @ factor[k], tolerance * tolerance))
        factor = np.column_stack([factor, column])
        residual = np.minimum(residual, np.maximum(1 - (factor * factor).sum(axis=1), 0))
        residual[k] = 0
        chosen.append(k)
    return np.array(chosen, dtype=int)


@dataclass
class Basis:
    """Features of the rows' image (x - shift) @ way under a Gaussian kernel of this width."""

    shift: np.ndarray
    way: np.ndarray
    width: float
    pivots: np.ndarray | None = None
    turn: np.ndarray | None = None

    @property
    def rank(self) -> int:
        return 0 if self.pivots is None else len(self.pivots)

    def image(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) @ self.way

    def set(self, pivots: np.ndarray) -> None:
        """The pivots, and the inverse of their kernel's triangular factor."""
        self.pivots = pivots
        self.turn = np.linalg.inv(np.linalg.cholesky(kernel(pivots, pivots, self.width) + 1e-14 * np.eye(len(pivots)))).T

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.of_image(self.image(x))

    def of_image(self, z: np.ndarray) -> np.ndarray:
        return kernel(z, self.pivots, self.width) @ self.turn

    def residual(self, z: np.ndarray) -> np.ndarray:
        if self.pivots is None:
            return np.ones(len(z))
        f = self.of_image(z)
        return np.maximum(1 - (f * f).sum(axis=1), 0)


def fit_bases(rows: DataFrame, bases: list[Basis], tolerance: float = 1e-9, most: int = MOST, passes: int = 12) -> float:
    """Give every basis its pivots, all in the same passes; returns the largest residual that is left of any row."""
    worst = 0.0
    for _ in range(passes):

        def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = [[] for _ in bases]
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    x = matrix_of(batch.slice(a, 2048))
                    for k, basis in enumerate(bases):
                        z = basis.image(x)
                        left = basis.residual(z)
                        open_ = left > tolerance
                        if open_.any():
                            z = z[open_]
                            held[k].append(z[pivoted(z, basis.width, tolerance, PROPOSED, left[open_])])
            out: dict[str, list] = {"basis": [], "worst": [], "z": []}
            for k, parts in enumerate(held):
                if parts:
                    z = np.concatenate(parts)
                    left = bases[k].residual(z)
                    z = z[pivoted(z, bases[k].width, tolerance, PROPOSED, left)]
                    out["basis"].append(k)
                    out["worst"].append(float(left.max()))
                    out["z"].append(z.tobytes())
            yield pa.RecordBatch.from_pydict({"basis": pa.array(out["basis"], pa.int32()), "worst": pa.array(out["worst"], pa.float64()), "z": pa.array(out["z"], pa.binary())})

        found: list[list[np.ndarray]] = [[] for _ in bases]
        worst, grown = 0.0, False
        for r in rows.mapInArrow(propose, "basis int, worst double, z binary").collect():
            found[r["basis"]].append(np.frombuffer(r["z"]).reshape(-1, bases[r["basis"]].way.shape[1]))
            worst = max(worst, r["worst"])
        for basis, parts in zip(bases, found, strict=True):
            if not parts or basis.rank >= most:
                continue
            z = np.concatenate(([] if basis.pivots is None else [basis.pivots]) + parts)
            z = z[np.lexsort(z.T)]  # the order of tasks does not matter
            z = z[pivoted(z, basis.width, tolerance, most)]
            grown |= len(z) > basis.rank
            basis.set(z)
        if not grown:
            break
    return worst


def line_basis(d: int, at: int, shift: float, scale: float, width: float) -> Basis:
    """A kernel of one column, standardised."""
    way = np.zeros((d, 1))
    way[at, 0] = 1 / scale if scale > 0 else 1.0
    return Basis(np.eye(d)[at] * shift, way, width)


# --- Gaussian processes ----------------------------------------------------


@dataclass
class Process:
    """A fitted Gaussian process: mean of y = centre + spread * features @ weights. noise: relative to the signal's variance."""

    basis: Basis
    weights: np.ndarray
    centre: float
    spread: float
    noise: float
    likelihood: float

    def mean(self, x: np.ndarray) -> np.ndarray:
        return self.centre + self.spread * (self.basis.features(x) @ self.weights)


def _evidence(gram: np.ndarray, b: np.ndarray, yy: float, n: int, noise: float) -> tuple[float, np.ndarray]:
    """Log marginal likelihood with the signal's variance at its best, and the weights of the mean."""
    values, vectors = np.linalg.eigh(gram)
    values, c = np.maximum(values, 0), vectors.T @ b
    square = max((yy - float((c * c / (values + noise)).sum())) / noise, 1e-300)
    logs = float(np.log(values + noise).sum()) + (n - len(values)) * math.log(noise)
    return -0.5 * (n * math.log(square / n) + logs + n * (1 + math.log(2 * math.pi))), vectors @ (c / (values + noise))


def fit_process(df: DataFrame, causes: list[str], effect: str, widths: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0), noise: float | None = None, tolerance: float = 1e-9, most: int = MOST) -> Process:
    """Gaussian-process regression of effect on causes, all standardised, with the length scale and noise of largest marginal likelihood.

    Some passes find the pivots of all length scales together and one more their moments. Needs a row.
    """
    columns = [*causes, effect]
    rows = numbers(df, columns)
    m = moments(rows, columns)
    d, p = len(columns), len(causes)
    scale = np.sqrt(np.maximum(np.diag(m.cov), 0))
    scale[scale == 0] = 1
    bases = [Basis(m.mean, np.eye(d)[:, :p] / scale[:p], w * math.sqrt(p)) for w in widths]
    fit_bases(rows, bases, tolerance, most)
    cuts = np.cumsum([b.rank * (b.rank + 1) for b in bases])

    def f(x: np.ndarray) -> np.ndarray:
        y = (x[:, -1] - m.mean[-1]) / scale[-1]
        parts = []
        for basis in bases:
            phi = basis.features(x)
            parts += [(phi.T @ phi).ravel(), phi.T @ y]
        return np.concatenate(parts)

    sums = np.split(batch_totals(rows, f, int(cuts[-1])), cuts[:-1])
    yy, best = m.n * m.cov[-1, -1] / scale[-1] ** 2, None
    for basis, s in zip(bases, sums, strict=True):
        r = basis.rank
        gram, b = s[: r * r].reshape(r, r), s[r * r :]
        for v in [noise] if noise is not None else np.geomspace(1e-4, 10, 21):
            likelihood, w = _evidence(gram, b, yy, m.n, float(v))
            if best is None or likelihood > best.likelihood:
                best = Process(basis, w, float(m.mean[-1]), float(scale[-1]), float(v), likelihood)
    return best


def process_residual(df: DataFrame, x: str, y: str, **options) -> DataFrame:
    """(x, residual) of a Gaussian-process regression of y on x, both standardised."""
    rows = numbers(df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")), ["x", "y"])
    if rows.isEmpty():
        return rows.select("x", F.col("y").alias("residual"))
    g = fit_process(rows, ["x"], "y", **options)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = matrix_of(batch)
            yield pa.RecordBatch.from_pydict({"x": g.basis.image(data)[:, 0], "residual": (data[:, 1] - g.mean(data)) / g.spread})

    return rows.mapInArrow(left, "x double, residual double")


def curve_moments(df: DataFrame, columns: list[str], width: float = 1.0, tolerance: float = 1e-3, most: int = 24) -> tuple[Moments, list[list[int]]]:
    """Moments of the standardised columns and of the features of each one's kernel, and the places of each column's features."""
    rows, d = numbers(df, columns), len(columns)
    m = moments(rows, columns)
    scale = np.sqrt(np.diag(m.cov))
    bases = [line_basis(d, j, m.mean[j], scale[j], width) for j in range(d)]
    fit_bases(rows, bases, tolerance, most)
    blocks, at = [], d
    for b in bases:
        blocks.append(list(range(at, at + b.rank)))
        at += b.rank

    def f(x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - m.mean) / np.where(scale > 0, scale, 1), *[b.features(x) for b in bases]])
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    sums = batch_totals(rows, f, at + at * at) / max(m.n, 1)
    mean = sums[:at]
    names = [*columns, *(f"{c}~{k}" for c, b in zip(columns, bases, strict=True) for k in range(b.rank))]
    return Moments(names, m.n, mean, sums[at:].reshape(at, at) - np.outer(mean, mean)), blocks


# --- dependence ------------------------------------------------------------


def kernel_information(rows: DataFrame, m: Moments, left: np.ndarray, right: list[np.ndarray], tolerance: float = 1e-6) -> list[np.ndarray]:
    """Kernel mutual information of each linear combination (a column of left) with those of its right matrix.

    All kernels get their factors in the same passes, and one more gives the factors' moments; the information is
    that of the regularised canonical correlations, as of the full kernel matrices.
    """
    #: Fixed values of the method: width and regulariser up to a thousand rows, and beyond.
    width, kappa = (1.0, 2e-2) if m.n <= 1000 else (0.5, 2e-3)

    def scaled(v: np.ndarray) -> np.ndarray:
        return v / np.sqrt(max(float(v @ m.cov @ v), 1e-300))

    bases = [Basis(m.mean, scaled(v)[:, None], width) for k in range(left.shape[1]) for v in (left[:, k], *right[k].T)]
    fit_bases(rows, bases, tolerance)
    groups, at = [], 0
    for r in right:
        groups.append(bases[at : at + 1 + r.shape[1]])
        at += 1 + r.shape[1]

    def f(x: np.ndarray) -> np.ndarray:
        parts = []
        for one, *many in groups:
            a = one.features(x)
            parts.append((a.T @ a).ravel())
            for other in many:
                b = other.features(x)
                parts += [(a.T @ b).ravel(), (b.T @ b).ravel()]
        return np.concatenate(parts)

    size = sum(g[0].rank ** 2 + sum(g[0].rank * b.rank + b.rank**2 for b in g[1:]) for g in groups)
    sums, at, out = batch_totals(rows, f, size), 0, []

    def take(r: int, c: int) -> np.ndarray:
        nonlocal at
        at += r * c
        return sums[at - r * c : at].reshape(r, c)

    def shrunk(g: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(g)
        values = np.maximum(values, 0)
        return vectors * (np.sqrt(values) / (values + m.n * kappa / 2)) @ vectors.T

    for one, *many in groups:
        root, got = shrunk(take(one.rank, one.rank)), []
        for other in many:
            cross, own = take(one.rank, other.rank), take(other.rank, other.rank)
            s = np.linalg.svd(root @ cross @ shrunk(own), compute_uv=False)
            got.append(-0.5 * np.log1p(-(np.minimum(s, 1 - 1e-12) ** 2)).sum())
        out.append(np.array(got))
    return out


def gap_medians(rows: DataFrame, columns: list[str], bins: int = 1 << 15) -> list[float]:
    """Median of the positive squared gaps between the rows, for each column; 1 where there is none.

    Values are counted in bins, two passes. It is exact where each bin holds one value,
    and else off by about a bin's width.
    """
    ends = rows.agg(*[f(F.col(f"`{c}`")) for c in columns for f in (F.min, F.max)]).first()
    cells = []
    for k, c in enumerate(columns):
        low, high = ends[2 * k], ends[2 * k + 1]
        step = (high - low) / bins if high is not None and high > low else 1.0
        cells.append(F.struct(F.lit(k).alias("c"), F.floor((F.col(f"`{c}`") - (low or 0.0)) / step).cast("long").alias("bin"), F.col(f"`{c}`").alias("v")))
    counted = rows.select(F.inline(F.array(*cells))).groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"), (F.min("v") < F.max("v")).alias("mixed")).collect()
    return [_median_gap(*(np.array([r[x] for r in sorted((q for q in counted if q["c"] == k), key=lambda q: q["v"])], dtype=np.float64) for x in ("v", "n", "mixed"))) for k in range(len(columns))]


def _median_gap(v: np.ndarray, n: np.ndarray, mixed: np.ndarray) -> float:
    upto = np.concatenate([[0], np.cumsum(n)])
    inside = float((mixed * n * (n - 1)).sum() / 2)  # pairs of one bin, closer than any two bins

    def within(t: float) -> float:
        return inside + float((n * (upto[np.searchsorted(v, v + t, side="right")] - upto[1:])).sum())

    total = within(np.inf) if len(v) else 0.0
    if total == 0:
        return 1.0
    middles = []
    for rank in ((total - 1) // 2, total // 2):
        low, high = 0.0, float(v[-1] - v[0])
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (low, mid) if within(mid) > rank else (mid, high)
        middles.append(high)
    return (middles[0] ** 2 + middles[1] ** 2) / 2 or 1.0


def hsic_moments(rows: DataFrame, columns: list[str], widths: list[float], tolerance: float = 1e-8) -> tuple[int, float, float, list[float]]:
    """(n, trace of the product of the centred kernels, sum of their squared products off the diagonal, sums of the kernels).

    One pass gives the factors' moments, the other those of the products of the
    two factors' main directions, beyond which less than a hundred-millionth of each kernel lies.
    """
    bases = [line_basis(2, k, 0.0, 1.0, w) for k, w in enumerate(widths)]
    fit_bases(rows, bases, tolerance)
    r, s = (b.rank for b in bases)

    def f(x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), *[b.features(x) for b in bases]])
        return (z.T @ z).ravel()

    sums = batch_totals(rows, f, (1 + r + s) ** 2).reshape(1 + r + s, 1 + r + s)
    n, total = int(round(sums[0, 0])), sums[0, 1:]
    centred = sums[1:, 1:] - np.outer(total, total) / n
    trace = float((centred[:r, r:] ** 2).sum())
    turns, means = [], []
    for part in (slice(0, r), slice(r, r + s)):
        values, vectors = np.linalg.eigh(centred[part, part])
        turns.append(vectors[:, values > 1e-8 * max(values.sum(), 1e-300)])
        means.append(total[part] / n)
    p, q = (t.shape[1] for t in turns)

    def products(x: np.ndarray) -> np.ndarray:
        a, b = ((basis.features(x) - mean) @ turn for basis, mean, turn in zip(bases, means, turns, strict=True))
        z = (a[:, :, None] * b[:, None, :]).reshape(len(x), p * q)
        return np.append((z.T @ z).ravel(), ((z * z).sum(axis=1) ** 2).sum())

    found = batch_totals(rows, products, (p * q) ** 2 + 1, 512)
    squares = float((found[:-1] ** 2).sum() - found[-1])
    return n, trace, squares, [float((total[:r] ** 2).sum()), float((total[r:] ** 2).sum())]
