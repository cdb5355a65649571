"""Incomplete factors, Gaussian processes, kernel information and the linear-time independence test against whole matrices."""

import math

import numpy as np
import pytest

from causeway.functions.tails import gamma_quantile
from causeway.operators import independence, lowrank
from causeway.operators.moments import moments
from causeway.plans import base, pairwise  # noqa: F401


def frame(spark, *columns, parts=3):
    return spark.createDataFrame(np.column_stack(columns).tolist(), ["x", "y", "z"][: len(columns)]).repartition(parts)


def full(z, width):
    z = z.reshape(len(z), -1)
    return np.exp(-((z[:, None] - z[None, :]) ** 2).sum(axis=2) / 2 / width**2)


def test_factor_is_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_t(3, size=(400, 2))
    df = frame(spark, *x.T)
    bases = [lowrank.line_basis(2, 0, 0.0, 1.0, 0.7), lowrank.Basis(np.zeros(2), np.eye(2), 4.0)]
    assert lowrank.fit_bases(df, bases, 1e-7) <= 1e-7
    for basis, z, width in zip(bases, (x[:, :1], x), (0.7, 4.0), strict=True):
        f = basis.features(x)
        assert f.shape[1] < 200 and np.abs(f @ f.T - full(z, width)).max() < 2e-7
    again = [lowrank.Basis(np.zeros(2), np.eye(2), 4.0)]
    lowrank.fit_bases(df, again, 1e-7)
    assert again[0].rank == bases[1].rank


@pytest.mark.parametrize("width", [0.5, 1.5])
def test_process_is_the_dense_one(spark, width):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = np.sin(2 * x) + 0.3 * rng.normal(size=300)
    g = lowrank.fit_process(frame(spark, x, y), ["x"], "y", widths=(width,), noise=0.05)
    u, v = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    k = full(u, width)
    dense = k @ np.linalg.solve(k + 0.05 * np.eye(300), v)
    assert np.abs((g.mean(np.column_stack([x, y])) - y.mean()) / y.std() - dense).max() < 1e-6
    scale = v @ np.linalg.solve(k + 0.05 * np.eye(300), v) / 300
    want = -0.5 * (300 * math.log(scale) + np.linalg.slogdet(k + 0.05 * np.eye(300))[1] + 300 * (1 + math.log(2 * math.pi)))
    assert g.likelihood == pytest.approx(want, abs=1e-4)


def test_process_finds_scale_and_several_causes(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 500))
    z = np.sin(3 * x) + y * y + 0.1 * rng.normal(size=500)
    g = lowrank.fit_process(frame(spark, x, y, z), ["x", "y"], "z", most=150)
    left = z - g.mean(np.column_stack([x, y, z]))
    assert left.std() < 0.2 and 1e-4 <= g.noise < 0.05


def test_kernel_information_is_the_dense_one(spark):
    rng = np.random.default_rng(4)
    for n, (width, kappa) in ((300, (1.0, 2e-2)), (1200, (0.5, 2e-3))):
        x = rng.uniform(-1, 1, n)
        y = x**2 + 0.3 * rng.normal(size=n)
        df = frame(spark, x, y)
        got = lowrank.kernel_information(df, moments(df, ["x", "y"]), np.eye(2)[:, :1], [np.eye(2)[:, 1:]])[0][0]
        a, b = (full((v - v.mean()) / v.std(), width) for v in (x, y))
        c = n * kappa / 2 * np.eye(n)
        inner = np.linalg.solve(a + c, a) @ np.linalg.solve(b + c, b).T
        want = -0.5 * np.log(1 - np.linalg.svd(inner, compute_uv=False) ** 2).sum()
        assert got == pytest.approx(want, rel=1e-2)


def dense_test(x, y, alpha):
    n = len(x)

    def k(v):
        v = (v - v.mean()) / v.std()
        gaps = (v[:, None] - v[None, :]) ** 2
        upper = gaps[np.triu_indices(n, 1)]
        return np.exp(-gaps / 2 / (0.5 * np.median(upper[upper > 0])))

    kx, ky, h = k(x), k(y), np.eye(n) - 1 / n
    both = (h @ kx @ h) * (h @ ky @ h)
    squares = (both**2).sum() - (np.diag(both) ** 2).sum()
    mean = (1 - (kx.sum() - n) / n / (n - 1)) * (1 - (ky.sum() - n) / n / (n - 1)) / n
    var = 2 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3)) * squares / n / (n - 1)
    return both.sum() / n, gamma_quantile(1 - alpha, mean**2 / var, n * var / mean)


def test_linear_test_is_the_quadratic_one(spark):
    outcomes = []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=150) if seed % 3 else rng.integers(0, 5, 150).astype(float)
        y = 0.25 * (seed % 4) * x**2 + rng.standard_t(4, size=150)
        got = independence.hsic_test(frame(spark, x, y, parts=2), "x", "y", 0.05)
        statistic, threshold = dense_test(x, y, 0.05)
        assert got["statistic"] == pytest.approx(statistic, rel=1e-3) and got["threshold"] == pytest.approx(threshold, rel=1e-3)
        assert got["independent"] == int(statistic < threshold)
        outcomes.append(got["independent"])
    assert 0 < sum(outcomes) < 12


def test_median_gap_counts_ties_and_bins(spark):
    rng = np.random.default_rng(5)
    for v in (rng.integers(0, 4, 201).astype(float), rng.normal(size=500), np.zeros(9), np.array([1.0, 2.0])):
        gaps = (v[:, None] - v[None, :])[np.triu_indices(len(v), 1)] ** 2
        want = np.median(gaps[gaps > 0]) if (gaps > 0).any() else 1.0
        df = frame(spark, v, v)
        assert lowrank.gap_medians(df, ["x"])[0] == pytest.approx(want, rel=1e-3)
        assert lowrank.gap_medians(df, ["y"], bins=64)[0] == pytest.approx(want, rel=0.1)


def test_additive_noise_by_processes(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, 400)
    df = frame(spark, x, np.tanh(4 * x) + 0.3 * rng.uniform(-1, 1, 400), rng.uniform(size=400))
    g = base.make("anm", alpha=0.01).learn(df, ["x", "y", "z"])
    assert g.matrix.tolist() == [[0, 1, 0], [0, 0, 0], [0, 0, 0]]
