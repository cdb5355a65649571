"""Conditional-independence tests against known values and against numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from causeway.functions import tails
from causeway.operators import independence, moments

#: Published statistics for z = [], [3], [2, 3] on integers 0..4, seed 23, 2500 rows, x = 0, y = 1.
GOLDEN = {
    "g2": (20.55310657691933, 90.54473365450676, 429.0926603059854),
    "chi2": (20.542792795683862, 90.66096270618675, 401.830906690841),
    "freeman_tukey": (20.586757281527213, 91.06391187965758, math.nan),
    "modify_log_likelihood": (20.639717717727184, 91.97967547179121, math.inf),
    "neyman": (20.804888528281907, 95.07200788651971, math.nan),
    "cressie_read": (20.537851851639562, 90.45257795422611, 404.24753197461905),
}
FISHERZ = (0.011609430716781555, 0.01137523908727811, 0.011448214156529746)
GIVEN = ([], ["x3"], ["x2", "x3"])


@pytest.fixture(scope="module")
def discrete(spark):
    np.random.seed(23)
    return spark.createDataFrame(pd.DataFrame(np.random.randint(0, 5, size=10000).reshape(-1, 4), columns=["x0", "x1", "x2", "x3"])).repartition(3).cache()


@pytest.fixture(scope="module")
def uniform(spark):
    np.random.seed(23)
    return spark.createDataFrame(pd.DataFrame(np.random.rand(2500, 4), columns=["x0", "x1", "x2", "x3"])).repartition(3).cache()


@pytest.mark.parametrize("name", GOLDEN)
def test_power_family(discrete, name):
    for given, want, dof in zip(GIVEN, GOLDEN[name], (16, 80, 400)):
        row = independence.power_divergence(discrete, "x0", "x1", given, name).first()
        assert row["dof"] == dof
        assert row["statistic"] == pytest.approx(want, rel=1e-9, nan_ok=True)


def test_p_values(discrete, uniform):
    assert independence.discrete_test(discrete, "x0", "x1", [], "g2")[2] == pytest.approx(0.19633494733361465, rel=1e-9)
    assert independence.discrete_test(discrete, "x0", "x1", ["x3"], "g2")[2] == pytest.approx(0.1971708971451276, rel=1e-9)
    for given, want in zip(GIVEN, FISHERZ):
        assert independence.fisherz_test(uniform, "x0", "x1", given) == pytest.approx(want, rel=1e-9)


def test_yates_correction_of_two_by_two(spark):
    rows = [(0, 0)] * 49 + [(0, 1)] * 9 + [(1, 0)] * 299 + [(1, 1)] * 42
    df = spark.createDataFrame(rows, "a int, b int")
    row = independence.power_divergence(df, "a", "b", [], "chi2").first()
    assert (row["statistic"], row["dof"]) == (pytest.approx(0.21360888186455865), 1)


def test_degenerate_tables(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 2, 2)], "a int, b int, c int")
    assert independence.discrete_test(df, "a", "b", []) == (0.0, 0, 1.0)
    assert independence.discrete_test(df.limit(0), "a", "b", ["c"]) == (0.0, 0, 1.0)
    assert independence.fisherz_test(df.selectExpr("cast(a as double) a", "cast(b as double) b"), "a", "b") is None


def test_tails():
    assert tails.chi2_tail(20.55310657691933, 16) == pytest.approx(0.19633494733361465, rel=1e-12)
    assert tails.gamma_upper(2.5, tails.gamma_quantile(0.95, 2.5, 1.0)) == pytest.approx(0.05, rel=1e-9)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    a = np.random.default_rng(0).normal(size=(5, 5))
    n = 1 << 20
    assert np.allclose(tails.matrix_exponential(a), np.linalg.matrix_power(np.eye(5) + a / n, n), rtol=1e-3)


def test_moments_agree_however_they_are_taken(spark, uniform):
    x = uniform.toPandas().to_numpy()
    few = moments.moments(uniform, uniform.columns)
    assert np.allclose(few.mean, x.mean(axis=0)) and np.allclose(few.cov, np.cov(x.T, ddof=0))
    old, moments.MOST_EXPRESSIONS = moments.MOST_EXPRESSIONS, 1
    try:
        many = moments.moments(uniform, uniform.columns)
    finally:
        moments.MOST_EXPRESSIONS = old
    assert many.n == few.n and np.allclose(many.cov, few.cov) and np.allclose(many.mean, few.mean)


def test_hsic(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(size=(2, 300))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": 2 * x}))
    free = independence.hsic_test(df, "x", "y", block=100)
    assert free["independent"] == 1
    assert independence.hsic_test(df, "x", "z", block=100)["independent"] == 0
    # The same statistic from whole matrices.
    def kernel(v):
        v = (v - v.mean()) / v.std()
        gaps = (v[:, None] - v[None, :]) ** 2
        upper = gaps[np.triu_indices(len(v), 1)]
        return np.exp(-gaps / 2 / (0.5 * np.median(upper[upper > 0])))
    h = np.eye(300) - 1 / 300
    want = (h @ kernel(x) @ h * (h @ kernel(y) @ h)).sum() / 300
    assert free["statistic"] == pytest.approx(want, rel=1e-6)
