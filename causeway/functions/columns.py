"""Column expressions: scalar and array functions that causal operators are made of."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the maximum-entropy approximation.
ENTROPY_K1, ENTROPY_K2, ENTROPY_GAMMA = 79.047, 7.4129, 0.37457


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_cosh(x: Column) -> Column:
    """ln(cosh(x)) without overflow."""
    return F.abs(x) + F.log1p(F.exp(F.lit(-2.0) * F.abs(x))) - math.log(2.0)


def entropy_of(mean_log_cosh: Column, mean_x_gauss: Column) -> Column:
    """Differential entropy of a standardised variable from avg(log_cosh(u)) and avg(u * exp(-u^2 / 2))."""
    return (1 + math.log(2 * math.pi)) / 2 - ENTROPY_K1 * F.pow(mean_log_cosh - ENTROPY_GAMMA, 2) - ENTROPY_K2 * F.pow(mean_x_gauss, 2)


def x_gauss(x: Column) -> Column:
    return x * F.exp(-x * x / 2)


def fisher_z(r: Column, n: Column, k: int | Column) -> Column:
    """Fisher-z statistic of a partial correlation given k variables; null where n is too small."""
    spare = n - k - 3
    bounded = F.greatest(F.lit(-0.99999), F.least(F.lit(0.99999), r))
    return F.when(spare > 0, F.sqrt(spare) * 0.5 * F.log((1 + bounded) / (1 - bounded)))


def partial_correlation_1(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y given one variable, from the three correlations."""
    return (xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))


def mixed_index_model(a: Column, b: Column, c: Column, noise: Column) -> Column:
    """The multiple-index structural equation: tanh + cos + sin of three linear indexes."""
    return F.tanh(a) + F.cos(b) + F.sin(c) + noise


def norm2(xs: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in xs), F.lit(0.0)))


def degree_two(columns: list[str]) -> list[Column]:
    """Intercept, columns and all their products of two, as named columns."""
    out = [F.lit(1.0).alias("one"), *[F.col(c) for c in columns]]
    return out + [(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]


def bits_to_number(bits: Column) -> Column:
    """The number whose binary digits are the array's 0/1 entries, first entry highest (up to 63)."""
    return F.conv(F.concat_ws("", F.transform(bits, lambda x: x.cast("string"))), 2, 10).cast("long")


def number_to_bits(number: Column, width: int) -> Column:
    return F.transform(F.split(F.lpad(F.bin(number), width, "0"), ""), lambda x: x.cast("int"))


def sparsemax(scores: Column) -> Column:
    """Euclidean projection of an array of numbers onto the probability simplex."""
    down = F.reverse(F.array_sort(scores))
    sums = F.transform(F.sequence(F.lit(1), F.size(scores)), lambda k: F.aggregate(F.slice(down, 1, k), F.lit(0.0), lambda a, x: a + x))
    # The last k with 1 + k * x_k > sum of the first k.
    support = F.array_max(F.transform(F.sequence(F.lit(1), F.size(scores)), lambda k: F.when(1 + k * F.element_at(down, k) > F.element_at(sums, k), k)))
    cut = (F.element_at(sums, support) - 1) / support
    return F.transform(scores, lambda x: F.greatest(x - cut, F.lit(0.0)))


def tuple_of_ints(text: Column) -> Column:
    """The whole numbers of a tuple written as text, such as '(6, 51)'."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), 0), lambda x: x.cast("int"))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, as double (session time zone UTC)."""
    return ts.cast("timestamp").cast("double")
