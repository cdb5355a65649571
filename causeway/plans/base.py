"""What every learner gives back, and the names they are found by."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Graph:
    """A learned graph over named variables. matrix[i, j] <> 0 is an edge i -> j; an undirected edge stands twice."""

    columns: list[str]
    matrix: np.ndarray
    weights: np.ndarray | None = None
    notes: dict = field(default_factory=dict)

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.columns)), "node int, name string")

    def edges(self, spark: SparkSession) -> DataFrame:
        """(src, dst, src_name, dst_name, weight)."""
        w = self.matrix if self.weights is None else self.weights
        rows = [(int(i), int(j), self.columns[i], self.columns[j], float(w[i, j])) for i, j in np.argwhere(self.matrix != 0)]
        return spark.createDataFrame(rows, "src int, dst int, src_name string, dst_name string, weight double")


class Learner:
    """learn(df, columns) gives a Graph. Options are the constructor's arguments."""

    def learn(self, df: DataFrame, columns: list[str]) -> Graph:
        raise NotImplementedError


LEARNERS: dict[str, type[Learner]] = {}


def learner(cls: type[Learner]) -> type[Learner]:
    LEARNERS[cls.__name__.lower()] = cls
    return cls


def make(name: str, **options) -> Learner:
    """A learner by name; unknown names and options are refused."""
    if name.lower() not in LEARNERS:
        raise ValueError(f"unknown learner {name!r}; there are {', '.join(sorted(LEARNERS))}")
    cls = LEARNERS[name.lower()]
    if unknown := set(options) - set(parameters(name)):
        raise ValueError(f"{name} has no option {sorted(unknown)}")
    return cls(**options)


def parameters(name: str) -> dict[str, object]:
    """Options of a learner and their defaults."""
    found = inspect.signature(LEARNERS[name.lower()].__init__).parameters
    return {k: p.default for k, p in found.items() if k != "self"}
