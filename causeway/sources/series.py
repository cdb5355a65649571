"""Time series from random structural causal models, one model a series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVATIONS = {
    "linear": lambda x: x,
    "relu": lambda x: np.maximum(x, 0),
    "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60))),
    "sin": np.sin,
    "tanh": np.tanh,
    "softplus": lambda x: np.logaddexp(0, x),
    "gaussian": lambda x: np.exp(-x * x),
    "remainder": lambda x: np.mod(x, 1.0),
}


def _kernel(rng: np.random.Generator, t: np.ndarray) -> np.ndarray:
    gap = t[:, None] - t[None, :]
    kind = rng.integers(5)
    if kind == 0:
        return np.exp(-(gap**2) / 2 / rng.choice([0.05, 0.1, 0.5]) ** 2)
    if kind == 1:
        return np.exp(-2 * np.sin(np.pi * np.abs(gap) * rng.choice([2, 4, 8, 16])) ** 2)
    if kind == 2:
        return 1 + np.outer(t, t)
    if kind == 3:
        return (1 + gap**2 / 2 / rng.choice([0.1, 1.0])) ** -1.0
    return np.eye(len(t)) * 0.1 + 0.01


def _root(rng: np.random.Generator, t: np.ndarray) -> np.ndarray:
    """A draw of a Gaussian process whose kernel is a sum or product of two, around a random mean."""
    a, b = _kernel(rng, t), _kernel(rng, t)
    k = a + b if rng.random() < 0.5 else a * b
    mean = [np.zeros_like(t), rng.normal() * t, np.exp(rng.uniform(-1, 1) * t) - 1, np.where(rng.random(len(t)) < 0.02, rng.normal(0, 3, len(t)), 0.0)][rng.integers(4)]
    values, vectors = np.linalg.eigh(k + 1e-6 * np.eye(len(t)))
    return mean + vectors @ (np.sqrt(np.maximum(values, 0)) * rng.normal(size=len(t)))


def one_series(seed: int, length: int, nodes: int, parents: int) -> np.ndarray:
    """The last node of a random model: roots are Gaussian processes, others mix activations of their parents."""
    rng, t = np.random.default_rng(seed), np.linspace(0, 1, length)
    made: list[np.ndarray] = []
    n_roots = max(1, nodes // 4)
    for j in range(nodes):
        if j < n_roots:
            made.append(_root(rng, t))
            continue
        chosen = rng.choice(j, min(j, int(rng.integers(1, parents + 1))), replace=False)
        total = rng.normal()
        for i in chosen:
            f = ACTIVATIONS[list(ACTIVATIONS)[rng.integers(len(ACTIVATIONS))]]
            total = total + rng.normal() * f(made[i])
        made.append(total)
    return np.nan_to_num(made[-1]).astype(np.float32)


def causal_series(spark: SparkSession, n: int, length: int = 512, nodes: int = 18, parents: int = 6, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(series_id, start, target array<float>); a series depends on its number and the seed alone."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([one_series(seed * 1_000_003 + i, length, nodes, parents)], pa.list_(pa.float32()))], ["series_id", "target"])

    rows = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(draw, "series_id long, target array<float>")
    return rows.select("series_id", F.to_timestamp(F.lit("2000-01-01 00:00:00")).alias("start"), "target")


def normalise_series(df: DataFrame, column: str) -> DataFrame:
    """Every feature of an array<array<double>> column (features x times) over all rows and times to mean 0, deviation 1."""
    long = df.select(F.posexplode(F.col(f"`{column}`")).alias("f", "xs")).select("f", F.explode("xs").alias("x"))
    stats = long.groupBy("f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).agg(F.array_sort(F.collect_list(F.struct("f", "m", "s"))).alias("stats")).withColumn("_one", F.lit(1))
    scale: Column = F.zip_with(F.col(f"`{column}`"), F.col("stats"), lambda xs, s: F.transform(xs, lambda x: (x - s["m"]) / F.when(s["s"] > 0, s["s"]).otherwise(1.0)))
    return df.join(F.broadcast(stats), F.lit(1) == F.col("_one")).withColumn(column, scale).drop("stats", "_one")
