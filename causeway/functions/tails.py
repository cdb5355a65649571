"""Tail probabilities and small dense numerics for results that are already a few numbers."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * out


def chi2_tail(statistic: float, dof: int) -> float:
    """P(chi-squared of dof >= statistic); 1 for dof 0, nan for nan."""
    if dof == 0:
        return 1.0
    return statistic if math.isnan(statistic) else gamma_upper(dof / 2, statistic / 2)


def gamma_quantile(p: float, shape: float, scale: float) -> float:
    """x with P(Gamma(shape, scale) <= x) = p, by bisection."""
    low, high = 0.0, max(shape, 1.0)
    while gamma_upper(shape, high) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_upper(shape, mid) > 1 - p else (low, mid)
    return scale * (low + high) / 2


def matrix_exponential(a: np.ndarray) -> np.ndarray:
    """Scaling and squaring with a Taylor series, of the last two axes."""
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(axis=-2).max(initial=0), 1e-16)))) + 2)
    a = a / 2**squarings
    out = term = np.eye(a.shape[-1])
    for k in range(1, 18):
        term = term @ a / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def f_tail(f: float, one: float, two: float) -> float:
    """Probability that an F variable with these degrees of freedom is over f."""
    return 1.0 if f <= 0 else beta_lower(two / 2, one / 2, two / (two + one * f))
