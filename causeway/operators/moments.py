"""First and second moments of columns: the statistics that most learners need, in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many columns the pairs are aggregated as expressions, beyond that as matrices of batches.
MOST_EXPRESSIONS = 24


@dataclass(frozen=True)
class Moments:
    """n rows; mean and population covariance of the columns."""

    columns: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def corr(self) -> np.ndarray:
        s = np.sqrt(np.diag(self.cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.cov / np.outer(s, s)

    @property
    def raw(self) -> np.ndarray:
        """X'X / n without centring."""
        return self.cov + np.outer(self.mean, self.mean)

    def residual_variance(self, y: int, parents: list[int]) -> float:
        """Population variance of column y after regression on the parents and a constant."""
        if not parents:
            return float(self.cov[y, y])
        b = np.linalg.lstsq(self.cov[np.ix_(parents, parents)], self.cov[parents, y], rcond=None)[0]
        return float(self.cov[y, y] - self.cov[y, parents] @ b)

    def coefficients(self, y: int, parents: list[int]) -> np.ndarray:
        return np.linalg.lstsq(self.cov[np.ix_(parents, parents)], self.cov[parents, y], rcond=None)[0]


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Moments of the rows that have no null in the columns."""
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).na.drop("any")
    d = len(columns)
    if d <= MOST_EXPRESSIONS:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = rows.agg(F.count(F.lit(1)), *[F.avg(f"`{c}`") for c in columns], *[F.covar_pop(F.col(f"`{columns[i]}`"), F.col(f"`{columns[j]}`")) for i, j in pairs]).first()
        cov = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[1 + d :], strict=True):
            cov[i, j] = cov[j, i] = v if v is not None else np.nan
        return Moments(list(columns), int(row[0]), np.array([x if x is not None else np.nan for x in row[1 : 1 + d]]), cov)
    parts = rows.mapInArrow(_partial(d), "n long, mean binary, m2 binary").groupBy(F.spark_partition_id() % 64).applyInArrow(_merge, "n long, mean binary, m2 binary").collect()
    n, mean, m2 = _combine([(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"])) for r in parts], d)
    return Moments(list(columns), n, mean, m2.reshape(d, d) / max(n, 1))


def _combine(parts: list[tuple[int, np.ndarray, np.ndarray]], d: int) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, m2 = 0, np.zeros(d), np.zeros(d * d)
    for k, m, s in parts:
        if k:
            gap = m - mean
            m2 = m2 + s + np.outer(gap, gap).ravel() * (n * k / (n + k))
            mean = mean + gap * (k / (n + k))
            n += k
    return n, mean, m2


def _partial(d: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                mean = x.mean(axis=0)
                parts.append((len(x), mean, ((x - mean).T @ (x - mean)).ravel()))
        n, mean, m2 = _combine(parts, d)
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tobytes()], "m2": [m2.tobytes()]})

    return partial


def _merge(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    d = len(rows[0]["mean"]) // 8
    n, mean, m2 = _combine([(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"])) for r in rows], d)
    return pa.table({"n": [n], "mean": [mean.tobytes()], "m2": [m2.tobytes()]})


def matrix_long(df: DataFrame, columns: list[str], kind: str = "covar_pop") -> DataFrame:
    """(a, b, value) of a matrix of pairwise aggregates: corr, covar_pop or covar_samp; one pass over df."""
    f = getattr(F, kind)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), f(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("value")) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
